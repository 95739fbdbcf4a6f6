import math
import random
import re

from tidemark.llm import mixing


def brute_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]]
        if not over:
            for s in free:
                target[s] = left * w[s] / total
            break
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


def test_targets_and_taken(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        src = rng.choice(["a", "a", "a", "b", "Z", "é", None, "empty"])
        n = 0 if src == "empty" else rng.choice([0, 1, 7, 60])
        rows.append((i if i % 90 else None, " \t".join("w x" for _ in range(n)) if n or rng.random() < 0.5 else None, src, 1))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        assert r.position is None or 0 <= r.position <= 1
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(df.limit(0)).count() == 0


def test_positions_follow_the_schedule(spark):
    rows = [(i, "a b c", "s") for i in range(400)] + [(1000 + i, "a b c", "t") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.in_training_order(mixing.mix(df, share=1.0, weights=(1.0, 1.0), schedules=((1.5, 0.5), (0.5, 1.5)))).collect()
    early = [r.source for r in got if r.position is not None and r.position < 0.5]
    assert [r.position for r in got] == sorted(r.position for r in got)
    # a schedule that falls from 1.5 to 0.5 has spent 1.25 / 2 of its integral by half time
    assert abs(early.count("s") - 250) <= 1 and abs(early.count("t") - 150) <= 1


def test_copies_follow_the_schedule(spark):
    rows = [(i, "a b c", "s") for i in range(400)] + [(1000 + i, "a b c", "t") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"share": 1.5, "weights": (1.0, 1.0), "schedules": ((1.5, 0.5), (0.5, 1.5))}
    got = mixing.mix(df, **options).collect()
    for r in got:
        assert len(r.positions) == r.copies and r.positions[0] == r.position and r.positions == sorted(set(r.positions))
    for source, a, b in (("s", 1.5, 0.5), ("t", 0.5, 1.5)):
        at = sorted(p for r in got if r.source == source for p in r.positions)
        assert len(at) == 600
        for x in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99):  # copies before a time, by the schedule's integral
            assert abs(sum(p < x for p in at) - 600 * (a * x + (b - a) * x * x / 2)) <= 1
    order = [r.doc_id for r in mixing.repeat_in_order(df, **options).collect()]
    assert len(order) == 1200 and abs(sum(d < 1000 for d in order[:600]) - 375) <= 2
    assert all(d != e for d, e in zip(order, order[1:]))


def test_sql_agrees_on_the_table(spark):
    import duckdb
    from tidemark.llm.queries import oracle_sql, queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(oracle_sql()["op4_mixing"])
    got = queries()["op4_mixing"](spark, sf).select(*rel.columns).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, rel.fetchall())) and any("," in (r.positions_ppm or "") for r in got)


def test_dotted_names_pass_through(spark):
    rows = [(k, "word " * (k + 1), "s", k) for k in range(20)] + [(None, None, None, 99)]
    got = mixing.repeat_in_order(spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int"))
    assert got.columns == ["doc_id", "text", "source", "a.b"] and {r["a.b"] for r in got.collect()} <= {*range(20), 99}
