import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import negatives
from tidemark.llm.queries import oracle_sql, queries


def brute(rows, anchor, positives=5, take=10):
    """Every row against every anchor, in Python's integers."""
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({r[0] for r in good if anchor(r[0])}):
        _, own, q = min(r for r in good if r[0] == a)
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, lab) for i, lab, v in good if i != a and len(v) == len(q))
        for s, p, _ in [r for r in scored if r[2] == own][:positives]:
            fits = [r for r in scored if r[2] != own and 30 * -s <= 100 * -r[0] <= 90 * -s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits[:take])]
    return sorted(out)


def cloud(n, dims, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((8, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x = base[rng.integers(8, size=n)] + rng.standard_normal((n, dims)) * 0.15
    return [(int(i), int(rng.integers(4)), v.tolist()) for i, v in enumerate(x)]


def run(spark, rows, mod=10):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id long, label int, embedding array<double>, q string, `a.b` int")
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % mod == 0).collect()))


@pytest.fixture
def small(monkeypatch):
    for name, v in (("BLOCK_ROWS", 90), ("BLOCK_ANCHORS", 16), ("LEAF", 8), ("TOGETHER", 5)):
        monkeypatch.setattr(negatives, name, v)


def test_agrees_with_every_pair(spark, small):
    rows = cloud(400, 12, 1)
    rows += [(1000 + k, rows[20][1] if k % 2 else 3, rows[20][2]) for k in range(130)]  # one vector a quarter of all rows
    rows += [(2000, None, rows[0][2]), (2010, 1, None), (2020, 1, []), (2030, 1, [None] + [1.0] * 11), (2040, 1, [float("nan")] * 12), (2050, 1, [float("-inf")] * 12), (None, 1, rows[5][2]), (2060, 2, [0.5] * 7), (2070, 2, [0.4] * 7), (2071, 1, [0.2] * 7), (30, 2, rows[31][2]), rows[40], rows[41], (2080, 1, [0.0] * 12), (2090, 77, rows[7][2]), (2100, 1, [-3.0] * 12), (2101, 1, [2.0] * 12)]
    random.Random(1).shuffle(rows)
    got = run(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 1000


def test_large_components_stay_whole_numbers(spark):
    rows = [(i, i % 3, [float(2**20 + 3 * i * i + j) for j in range(6)]) for i in range(60)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_nodes_outside_the_annulus_are_left_alone(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 16)
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.concatenate([rng.standard_normal((64, 3)) * 0.02 + c for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0])])).astype(np.int64)
    square = (x.astype(float) ** 2).sum(axis=1)
    tree = negatives.vantage_tree(np.column_stack([x, np.sqrt(square.max() - square)]), np.arange(len(x)))
    seen = []
    monkeypatch.setattr(negatives, "_dot", lambda a, b, f=negatives._dot: seen.append(len(b)) or f(a, b))
    big = np.array([1 << 40])
    q, _, ids = negatives.search(tree, x, np.arange(len(x)), np.zeros(len(x), int), square.max(), x[:1], np.array([-1]), np.zeros(1, int), np.zeros(1, int), -big, big, 5, True)
    assert len(ids) == 5 and sum(n for n in seen if n > 1) < len(x) / 2


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, None)]) == run(spark, [(0, 1, [1.0])]) == run(spark, [(0, 1, [1.0]), (1, 2, [1.0])]) == []


def test_query_and_sql_twin(spark, tmp_path):
    rows = [(i, int(lab), [float(x) for x in v]) for i, lab, v in duckdb.sql("select vec_id, label, embedding from '/root/testdata/sf0.01/embeddings.parquet'").fetchall()]
    rows += [(1000 + k, rows[k % 3][1], rows[100 * (k % 3)][2]) for k in range(60)] + [(2000, None, rows[0][2]), (2001, 3, None), (2002, 3, [float("nan")] * 64)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, queries()["op12_hard_negatives"](spark, f"file://{tmp_path}").collect()))
    moved = [(i, (lab + 1) % 10 if lab is not None and i % 7 == 0 else lab, v) for i, lab, v in rows]
    assert got == brute(moved, lambda i: i % 100 == 0) == sorted(con.sql(oracle_sql()["op12_hard_negatives"]).fetchall()) and got
