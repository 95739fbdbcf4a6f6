import hashlib
import random

import numpy as np
import pytest
from tidemark.llm import substrings, suffixes
from tidemark.llm.queries import queries


def brute(rows, length=50):
    """Spans and rest of each row: every string of ``length`` bytes, with the least id that holds it."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - length + 1):
                w = t[p : p + length]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        if i is not None:
            for p in range(len(t) - length + 1):
                if least[t[p : p + length]] < i:
                    gone[p : p + length] = [True] * length
        spans = [[p, p] for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1])]
        for s in spans:
            while s[1] < len(t) and gone[s[1]]:
                s[1] += 1
        out.append((i, len(t), [tuple(s) for s in spans], bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def invented(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeäöñ嗨 ", k=rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(6, 40))) for _ in range(12)]
    rows = []
    for i in rng.sample(range(1000), n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(20)) for _ in range(rng.randrange(0, 7))]
        rows.append((i, "".join(parts)))
    rows += [(2000 + k, rows[k % 4][1]) for k in range(40)]
    rows += [(3000, None), (3001, ""), (3002, "x" * 49), (3003, "x" * 50), (3004, "x" * 51), (3005, "x" * 1000), (3006, "ab" * 400 + "x" * 70), (3007, "ba" * 300), (None, rows[0][1]), (None, None), rows[1], (rows[2][0], passages[0] * 2), (-5, passages[1] + "\0" + passages[2]), (2**62, passages[3][5:])]
    rng.shuffle(rows)
    return rows


def run(spark, rows, length=50):
    df = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], "doc_id long, text string, kept string, spans int, `a.b` int").repartition(3)
    return sorted([(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in substrings.repeated_bytes(df, length=length).collect()], key=str)


@pytest.mark.parametrize("chunk,slice_,shard", [(8 << 20, 1 << 19, 3 << 20), (2000, 701, 500)])
def test_agrees_with_brute_force(spark, monkeypatch, chunk, slice_, shard):
    for name, v in (("CHUNK", chunk), ("SLICE", slice_), ("SHARD", shard), ("BUCKET", 300)):
        monkeypatch.setattr(substrings, name, v)
    rows = invented(1)
    got = run(spark, rows)
    assert got == brute(rows) and sum(len(r[2]) for r in got) > 100


def test_other_lengths(spark):
    rows = invented(2, 60)
    assert run(spark, rows, 31) == brute(rows, 31)
    with pytest.raises(ValueError):
        substrings.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), length=30)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, [], b"")]
    assert run(spark, [(None, "a" * 60)]) == [(None, 60, [], b"a" * 60)]


def test_query(spark, tmp_path):
    rows = invented(3)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries()["op11_substring_dedup"](spark, f"file://{tmp_path}")
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(rows)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("induced_to", [0, 6, 1024])
def test_suffix_arrays_and_common_prefixes(monkeypatch, induced_to):
    monkeypatch.setattr(suffixes, "SMALL_ALPHABET", induced_to)
    rng = random.Random(4)
    for k in range(300):
        letters = rng.choice([1, 2, 3, 30])
        s = [rng.randrange(1, letters + 1) for _ in range(rng.randrange(80))] + [0]
        order = suffixes.suffix_array(np.array(s, np.int32), letters + 1).tolist()
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        shared = suffixes.permuted_common_prefixes(np.array(s), np.array(order), 1)
        for i, j in zip(order[1:], order):
            n = 0
            while s[i + n] == s[j + n] != 1:
                n += 1
            assert shared[i] == n
