import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tidemark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def by_library(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes(), tok.decode(ids, skip_special_tokens=False).encode()


def odd_texts():
    rng = random.Random(8)
    atoms = ["a", "B", "don't", "I'LL", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", "́", "é", "É", "Ω", "ß", "İ", "日本", "🙂", "12", "###", "<|endoftext|>", "<|startoftext|>", "'s", " ", "\u0085", "Σ", "ς"]
    texts = [None, "", " ", "\n\n", "x" * 30_000, "é" * 9000, "<|endoftext|>" * 400]
    texts += ["".join(rng.choice(atoms) for _ in range(rng.choice([3, 40, 4000]))) for _ in range(60)]
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    return [*texts, long, long[5000:], "new start " + long]


def test_agrees_with_library_exactly(library):
    texts = odd_texts()
    c = bpe.ChunkCoder(PATH)
    raw = [(t or "").encode() for t in texts]
    for got in (c.encode_batch(raw), c.encode_batch(raw)):
        assert [(ids, c.decode(ids)) for ids in got] == [by_library(library, t) for t in texts]
    assert c.reused > c.encoded and c.whole == 0


def test_small_stores_give_the_same(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(bpe, "WORD_BYTES", 2000)
    texts = odd_texts()[-12:]
    c = bpe.ChunkCoder(PATH)
    for t in texts * 2:
        assert c.encode_batch([t.encode()]) == [by_library(library, t)[0]]


def test_joins_are_widened_until_they_agree(library, monkeypatch):
    text = odd_texts()[-1].encode()
    want = by_library(library, text.decode())[0]
    for steps, edge in enumerate((None, ("last",), ("last", "all"))):
        c = bpe.ChunkCoder(PATH)
        real = c._edge
        if edge:  # an edge that cannot agree at the narrower windows

            def wrong(chunk, step, side, real=real, edge=edge):
                words, ids = real(chunk, step, side)
                return (words, b"\xff\xff\xff\xff" + ids) if step in edge else (words, ids)

            monkeypatch.setattr(c, "_edge", wrong)
        assert c.encode_batch([text]) == [want]
        assert (c.widened > 0) == (steps > 0) and c.whole == (steps == 2)


def test_passages_in_other_surroundings_reuse_chunks():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(12_000))
    c = bpe.ChunkCoder(PATH)
    c.encode_batch([passage.encode()])
    before = c.encoded
    c.encode_batch([(" ".join(word() for _ in range(50)) + passage + "x " + word()).encode()])
    assert c.encoded - before <= 4 < before


def test_tokens_that_hold_white_space_are_refused():
    with pytest.raises(ValueError):
        bpe.ChunkCoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_table(spark, sf_dir, library):
    from tidemark.llm.queries import queries

    got = {r.doc_id: r for r in queries()["op2_bpe_chunks"](spark, sf_dir).collect()}
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    for d, t in docs:
        ids, text = by_library(library, t)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest())


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b", 1, 5), (1, None, 2, 5), (1, None, 2, 5), (2, "", 3, 5), (2**53 + 1, "c", 4, 5)], "doc_id long, text string, n_tokens int, ids int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, bytes(r.ids)) for r in bpe.encode(df, PATH).collect())
    assert [g[1:3] for g in got] == [(1, 0), (1, 0), (2, 0), (2**53 + 1, 1), (0, 2)] and got[0][3] == b""
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_a_worker_keeps_no_store_when_its_task_ends():
    """Workers are used again by other stages, whose memory the stores would take."""
    import public_tokenizers

    c = bpe.coder(public_tokenizers.path("word_bpe_49k.json"))
    before = c.encode_batch([b"some words, and some more"])
    assert c.words.new and c.chunks.new
    bpe._forget()
    assert not (c.words.new or c.words.old or c.chunks.new or c.chunks.old)
    assert c.encode_batch([b"some words, and some more"]) == before
