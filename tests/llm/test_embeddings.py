import random

import duckdb
import numpy as np
from tidemark.llm import embeddings
from tidemark.llm.queries import oracle_sql, queries


def brute(rows):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for d in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == d]
        x = np.array([rows[i][1] for i in own], dtype=float)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(x @ x.T >= 0.9)
        for p, q in zip(a, b):
            if p != q:
                links[own[p]].add(own[q])
    comp = {}
    for i in range(len(rows)):
        if i not in comp:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            for j in seen:
                comp[j] = min(ids) if ids else None
    return [(r[0], len(links[i]), comp[i], r[0] is not None and r[0] == comp[i]) for i, r in enumerate(rows)]


def key(r):
    return tuple(map(str, r))


def cloud(n, dims, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dims))
    out = []
    for i in range(n):
        v = base[rng.integers(len(base))] + rng.standard_normal(dims) * rng.choice([0, 0.1, 0.3, 0.45])
        out.append((i * 3 % (n + 1), (v * 10.0 ** rng.integers(-3, 3)).tolist()))
    return out


def run(spark, rows, kind="double"):
    df = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding array<{kind}>, kept int")
    return sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=key)


def test_agrees_with_brute_force(spark):
    rows = cloud(400, 64, 1) + cloud(60, 7, 2) + [(5000 + i, [x]) for i, x in enumerate((1.0, -2.0, 3.0))]
    rows += [(6000, None), (6001, []), (6002, [0.0] * 64), (6003, [None] + [1.0] * 63), (6004, [float("nan")] * 64), (6005, [float("inf")] + [0.0] * 63), (None, rows[0][1]), (None, [7.0, 8.0]), rows[3], rows[3], (6006, [1e300] * 64), (6007, [1e-300] * 64)]
    assert run(spark, rows) == sorted(brute(rows), key=key)


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SIDE_ROWS", 20)
    monkeypatch.setattr(embeddings, "_TILE", 16)
    rng = random.Random(3)
    rows = cloud(300, 16, 4)
    center = [rng.gauss(0, 1) for _ in range(16)]
    rows += [(10_000 + i, [c + rng.gauss(0, 0.05) for c in center]) for i in range(250)]
    assert run(spark, rows) == sorted(brute(rows), key=key)


def test_vectors_are_sent_once_per_part(spark, monkeypatch):
    """Not once per cell, neighbour and split, whose number grows with the vectors."""
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(embeddings, "SIDE_ROWS", 20)
    sent = []
    for name in ("applyInArrow", "applyInPandas"):
        real = getattr(GroupedData, name)
        monkeypatch.setattr(GroupedData, name, lambda self, *a, real=real: sent.append(self._df.count()) or real(self, *a))
    rows = cloud(600, 16, 5)
    assert run(spark, rows) == sorted(brute(rows), key=key)
    assert 0 < sum(sent) <= 6 * 600


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_whole_small_table(spark, tmp_path):
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    rng = random.Random(4)
    n = 1 + max(i for i, _ in rows)
    for k in range(60):  # near and exact copies of some vectors, in groups
        rows.append((n + k, [x + rng.gauss(0, 0.02) * (k % 3) * max(map(abs, rows[k % 9][1])) for x in rows[k % 9][1]]))
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries()["op9_embedding_dups"](spark, f"file://{tmp_path}").select("vec_id", "n_links", "component_id", "kept").collect()), key=key)
    assert got == sorted(brute(rows), key=key) and any(r[1] for r in got)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.sql(oracle_sql()["op9_embedding_dups"]).fetchall(), key=key) == got
