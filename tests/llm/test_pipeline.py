from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from tests_support import brute_components, naive_fingerprint, spans_by_hand
from tidemark.llm import langid, linededup


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "12 34 %%", "en", "s", 8), (10_003, "the same of that and with this here", None, None, 5)], docs.schema)
    table = docs.unionByName(extra)
    rows = {r.doc_id: r for r in table.collect()}
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5

    named = corpus_pipeline.language_id(spark, table, sf_dir)
    assert named.columns == table.columns
    kept = {r.doc_id for r in named.collect()}
    assert kept == {d for d, r in rows.items() if langid.has_letter(r.text)}

    texts = {d: rows[d].text for d in kept}
    comp = brute_components(list(texts), [naive_fingerprint(t) for t in texts.values()])
    single = corpus_pipeline.near_duplicates(spark, named, sf_dir)
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(comp))

    left = {d: texts[d] for d in set(comp)}
    spans = spans_by_hand(list(left.items()))
    want = {d: linededup.cut_spans(t, *zip(*spans[d, t])) if (d, t) in spans else t for d, t in left.items()}
    cut = corpus_pipeline.repeated_passages(spark, single, sf_dir)
    got = {r.doc_id: r for r in cut.collect()}
    assert {d: r.text for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())

    mixed = corpus_pipeline.mix_sources(spark, cut, sf_dir).collect()
    size = {d: len(t.encode().split()) for d, t in want.items()}
    copies = Counter(r.doc_id for r in mixed)
    taken, of = defaultdict(int), defaultdict(list)
    for d in want:
        of[rows[d].source].append(d)
        taken[rows[d].source] += copies[d] * size[d]
    assert all(copies[d] <= 2 for d in want) and all(r.text == want[r.doc_id] for r in mixed)
    total = sum(size.values())
    for s, ids in of.items():
        assert taken[s] <= 2 * sum(size[d] for d in ids)
    assert abs(sum(taken.values()) - 1.5 * total) <= sum(max(size[d] for d in ids) for ids in of.values()) or sum(taken.values()) < 1.5 * total

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = corpus_pipeline.tokenize(spark, cut, sf_dir).collect()
    assert {r.doc_id: bytes(r.ids) for r in coded} == {d: np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for d, t in want.items()}


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 100


def test_stages_take_null_ids_repeated_rows_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = docs.collect()
    odd = [(None, rows[0].text, "en", None, 5), (None, None, None, None, None), tuple(rows[1]), tuple(rows[1]), (rows[2].doc_id, rows[3].text, "de", "s", 1), (10**12, "", "en", "s", 0), (10**12 + 1, "ein wort " * 30_000, "de", "s", None)]
    table = docs.unionByName(spark.createDataFrame(odd, docs.schema).selectExpr(*docs.columns))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf_dir)
        n = out.count()
        assert 0 < n <= 2 * table.count(), name
        assert stage(spark, table.limit(0), sf_dir).count() == 0, name
        if name != "bpe":
            assert out.columns == docs.columns, name
    single = [r.text for r in corpus_pipeline.near_duplicates(spark, table, sf_dir).collect()]
    assert single.count(rows[1].text) <= 1 and sum(not t for t in single) <= 1
