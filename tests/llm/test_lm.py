import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tidemark.llm import lm
from tidemark.llm.queries import queries

END = b"\n"


def tokens(t):
    return [*((t or "").encode().lower().split()), END]


def brute(docs):
    train = Counter()
    for d, t in docs:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    for d, t in docs:
        w = tokens(t)
        yield d, d is not None and zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(x in train for x in w), n, sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)


EVERYWHERE = [1 << 30, 0]


@pytest.mark.parametrize("broadcast", EVERYWHERE)
def test_base_agrees_with_brute_force(spark, sf_dir, broadcast):
    docs = [(r[0], r[1]) for r in duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()]
    docs += [(None, "a b A"), (None, "a b A"), (7, None), (8, ""), (10**12, " \n "), (11, "\u00c4\u00c4 \u4e2d\u6587 x\u00a0y\x1fz"), (2**53 + 1, "one")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, bucket int")
    got = sorted(lm.score(df, broadcast_bytes=broadcast).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.base_score))
    want = sorted(brute(docs), key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert math.isclose(g.base_score, w[5], rel_tol=1e-9)
        assert g.score < 0


def model_by_hand(docs):
    """Pair model with a Dirichlet prior from counts on the same scale of levels, without a filter."""
    low, value = lm.levels()
    scale = lambda n: value[np.searchsorted(low, n, side="right")]
    one, two = Counter(), Counter()
    for d, t in docs:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            w = tokens(t)
            one.update(w)
            two.update(zip([None, *w], w))
    n, v = sum(one.values()), len(one)
    for d, t in docs:
        w = tokens(t)
        total = 0.0
        for h, x in zip([None, *w], w):
            pair = scale(two[h, x])
            p = (scale(one[x]) + 0.1) / (n + 0.1 * (v + 1))
            total += math.log10((pair + lm.PRIOR * p) / (max(scale(one[END if h is None else h]), pair) + lm.PRIOR))
        yield total


def test_score_agrees_with_the_model_by_hand(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got, other = ([r.score for r in lm.score(df, broadcast_bytes=b).orderBy("doc_id").collect()] for b in EVERYWHERE)
    assert np.allclose(got, other, rtol=1e-12)  # both ways give the same
    want = list(model_by_hand(docs))
    n = [len(tokens(t)) for _, t in docs]
    # a false positive raises a count by a step or makes an unseen pair one that was seen once
    off = (np.array(got) - want) / n
    # (a text that repeats few words hangs on one of them)
    assert np.quantile(np.abs(off), 0.9) < 0.03 and np.abs(off).mean() < 0.02
    assert np.corrcoef(np.array(got) / n, np.array(want) / n)[0, 1] > 0.99


def test_pairs_seen_once_count(spark):
    rows = [(i, "x%d y%d" % (i, i)) for i in range(1, 400)] + [(None, "x%d y%d" % (i, i + 7)) for i in range(1, 200)]
    trained = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id}
    known = [got[i] for i, t in trained if i]
    other = [got[i] for i, _ in rows if i and zlib.crc32(str(i).encode()) % 10 == 0]
    assert np.mean(known) > np.mean(other)


def test_frequent_keys_cost_one_entry_a_task(spark):
    df = spark.createDataFrame([("the the the of",)] * 3000, "text string").repartition(3)
    rows = lm.count_ngrams(df, 1).collect()
    assert len(rows) == 6 and all(len(r["keys"]) <= 8 * 6 for r in rows)


def test_texts_that_span_pieces(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(n))) for i, n in enumerate([200_000, 1, 0, 150_000, 3])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for b in EVERYWHERE:
        got = sorted(lm.score(df, broadcast_bytes=b).collect(), key=lambda r: r.doc_id)
        for g, w in zip(got, brute(docs)):
            assert (g.n_tokens, g.n_known, g.train_tokens) == w[2:5] and math.isclose(g.base_score, w[5], rel_tol=1e-9)


def test_model_beats_base_on_held_out(spark):
    got = queries()["op7_lm_scores"](spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_filter_reads_counts_back():
    rng = np.random.default_rng(1)
    low, value = lm.levels()
    assert value[1] == 1 and value[2] == 2 and (np.diff(value[1:-1]) > 0).all()
    key = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2))
    level = rng.integers(1, 12, len(key))
    buckets = 5
    of = lm.bucket_of(key, buckets)
    assert (np.diff(of) >= 0).all() and set(of) == set(range(buckets))
    rows = [{"bucket": b, "buckets": buckets, "filter": lm.fill(key[of == b], level[of == b]).tobytes(), "words": key[of == b].tobytes(), "counts": level[of == b].astype("<i8").tobytes()} for b in range(buckets) if b != 2]
    there = of != 2
    for f in (lm.Part(rows), lm._joined(iter([lm.Part(rows[:2]), lm.Part(rows[2:])]), sum(len(r["filter"]) for r in rows) // 8, sum(len(r["words"]) for r in rows) // 8)):
        back = f.level(key)
        assert (back[there] >= level[there]).all() and (back == level)[there].mean() > 0.9
        assert not back[~there].any()  # a bucket without n-grams knows none
        assert (f.exact(key)[there] == level[there]).all() and not f.exact(key)[~there].any()
        other = f.level(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
        assert (other == 0).mean() > 0.9


def test_rows_of_megabytes_lie_in_small_row_groups(spark, monkeypatch):
    """Parquet looks at a row group's size after a hundred rows by default, which would be hundreds of megabytes in writers and readers."""
    rng = np.random.default_rng(2)
    written = []
    real = lm.durable
    monkeypatch.setattr(lm, "durable", lambda df, **kw: written.append((out := real(df, **kw), kw)) or out)
    docs = [(i, bytes(rng.integers(97, 123, 3_000_000, dtype=np.uint8)).decode()) for i in range(12)]  # a word each; a text fills a chunk
    assert lm.score(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), broadcast_bytes=-1).count() == 12
    chunks = [d for d, _ in written if "z" in d.columns]
    assert len(chunks) == 1 and len(written) == 2
    files = [pq.ParquetFile(f.removeprefix("file:").replace("//", "/")) for d in chunks for f in d.inputFiles()]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 12 and max(g.num_rows for g in groups) < 12 and all(g.total_byte_size < 16 << 20 for g in groups)


def test_tokens_by_pieces():
    texts = ["Ab " * 90_000, None, "", "x" * 300_000, "a b", b"A b"]
    one, other = lm.Tokens(texts), lm.Tokens.by_pieces(texts)
    assert (one.hash == other.hash).all() and (one.count == other.count).all() and (one.at == other.at).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df).count() == 0
    assert lm.score(df, broadcast_bytes=-1).count() == 0
    none = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert [lm.score(none, broadcast_bytes=b).count() for b in EVERYWHERE] == [2, 2]


def test_probabilities_after_a_history_add_up(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(40)]
    docs = [" ".join(rng.choices(words, weights=range(1, 41), k=50)) for i in range(200)]
    rows = lm.build_model(spark.createDataFrame([(t,) for t in docs], "text string")).collect()
    part = lm.Part(rows)
    s = lm.Scorer(sum(r["total"] for r in rows), sum(r["distinct"] for r in rows))

    def p(text):
        t = lm.Tokens([text])
        word, which = np.unique(t.hash, return_inverse=True)
        return 10 ** s.rows(t, which, part.exact(word), part.level(word), part.level(t.pairs()))["score"][0]

    for left in ("w3", "w39"):
        ends = {w: p(f"{w}") for w in words}
        # P(left right end) / P(right's own end after it), summed over right, is P(left) but for ends
        t = lm.Tokens([left])
        total = 0.0
        for right in words:
            two = lm.Tokens([f"{left} {right}"])
            word, which = np.unique(two.hash, return_inverse=True)
            lv, pl = part.level(word), part.level(two.pairs())
            value = lm.levels()[1]
            pr = ((value[lv] + 0.1) / s.floor)[which][1]
            total += (value[pl[1]] + lm.PRIOR * pr) / (max(value[lv][which][0], value[pl[1]]) + lm.PRIOR)
        word, which = np.unique(t.hash, return_inverse=True)
        lv, pl = part.level(word), part.level(t.pairs())
        total += (value[pl[1]] + lm.PRIOR * ((value[lv] + 0.1) / s.floor)[which][1]) / (max(value[lv][which][0], value[pl[1]]) + lm.PRIOR)
        assert 0.9 < total < 1.1 and all(v > 0 for v in ends.values())
