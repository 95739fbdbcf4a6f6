import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import detect, machines, profile
from tidemark.sources import export


def test_profiles_and_their_rollup(spark):
    rng = random.Random(1)
    times = {(d, s): sorted(rng.sample(range(10**6), n)) for d in "ab" for s, n in (("x", 400), ("y", 37), ("one", 1))}
    rows = [(d, s, t) for (d, s), ts in times.items() for t in ts] + [("a", "x", None)]
    samples = spark.createDataFrame(rows, "d string, s string, t long").repartition(5)
    fine = profile.gap_profile(samples, ["d", "s"], "t", k=2000, width=50_000)
    got = {(r.d, r.s): r for r in profile.summary(fine).collect()}
    exact = lambda g, r: sorted(g)[max(0, -(-int(r * 1000) * len(g) // 1000) - 1)]
    for key, ts in times.items():
        g = [b - a for a, b in zip(ts, ts[1:])]
        r = got[key]
        assert (r.samples, r.gaps) == (len(ts), len(g))
        if g:
            mean = sum(g) / len(g)
            assert (r.gap_min, r.gap_max) == (min(g), max(g)) and abs(r.gap_mean - mean) < 1e-6
            assert abs(r.jitter - (sum((x - mean) ** 2 for x in g) / len(g)) ** 0.5) < 1e-3
            assert [r.gap_p50, r["gap_p90"], r["gap_p99"]] == [exact(g, q) for q in (0.5, 0.9, 0.99)]
        else:
            assert (r.gap_p50, r.gap_mean, r.jitter) == (None, None, 0.0) or r.gap_p50 is None
    for r in profile.summary(profile.roll_up(fine, ["d"])).collect():
        g = [b - a for (d, _), ts in times.items() if d == r.d for a, b in zip(ts, ts[1:])]
        assert (r.samples, r.gaps, r.gap_p50) == (sum(len(ts) for (d, _), ts in times.items() if d == r.d), len(g), exact(g, 0.5))
    assert profile.gap_profile(samples.limit(0), ["d"], "t").count() == 0


def test_small_sketches_keep_their_error(spark):
    rng = random.Random(2)
    t, ts = 0, []
    for _ in range(30_000):
        t += rng.randrange(1, 10**6)
        ts.append((t,))
    r = profile.summary(profile.gap_profile(spark.createDataFrame(ts, "t long").withColumn("k", F.lit(1)), ["k"], "t", k=200)).first()
    g = sorted(b[0] - a[0] for a, b in zip(ts, ts[1:]))
    for q, v in ((0.5, r.gap_p50), (0.9, r.gap_p90), (0.99, r.gap_p99)):
        assert abs(sum(x <= v for x in g) / len(g) - q) <= 2 * profile.rank_error(200)


def test_gap_quantiles_agree_with_sql_beyond_a_sketch(spark, tmp_path):
    import duckdb
    from tidemark.queries import reference

    t = "timestampadd(MICROSECOND, id * 1000000 + id * id * 7919 % 999983, timestamp_ntz'2024-01-01 00:00:00')"
    spark.range(150_000).selectExpr("id as event_id", "id % 2 as user_id", "'view' as event_type", "1.0D as value", f"{t} as ts").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = reference.QUERIES["gap_profile"](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(f"select {', '.join(got.columns)} from ({reference.SQL['gap_profile']})").fetchall()
    assert [tuple(r) for r in got.collect()] == want


def test_exact_quantiles(spark):
    rng = random.Random(3)
    values = {"a": [rng.randrange(10 ** rng.randrange(1, 14)) for _ in range(900)], "b": [0], "c": [7] * 50 + [10**12], "d": [1, 2]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)], "k string, gap long").repartition(6)
    got = {r.k: tuple(r)[1:] for r in profile.exact_quantiles(df, ["k"]).collect()}
    assert got == {k: tuple(sorted(vs)[max(0, -(-q * len(vs) // 100) - 1)] for q in (50, 90, 99)) for k, vs in values.items()}


def events_by_hand(machine, rows):
    """Events of one signal: (where it began, time of its first largest value)."""
    out, state, run = [], 0, None
    for pos, t, v in sorted(rows):
        state = machine.step(state, v)
        if state in machine.active:
            run = run or [pos, None, None]
            good = v is not None and v == v
            if run[2] is None or good and (run[1] is None or v > run[1]):
                run[1:] = [v if good else None, t]
        elif run:
            out.append((run[0], run[2]))
            run = None
    return out + ([(run[0], run[2])] if run else [])


def third():
    """A machine of more states, which goes on while every third value or so is positive; a class of the test's own travels by value."""

    class Third(machines.Machine):
        states, active = 4, frozenset({1, 2, 3})

        def step(self, state, value):
            if value is not None and value > 0:
                return 1
            return 0 if state in (0, 3) else state + 1

    return Third()


@pytest.mark.parametrize("width", [4, 17, 10_000])
@pytest.mark.parametrize("machine", [machines.Hysteresis(-0.5, 0.8), third()])
def test_events_do_not_depend_on_the_buckets(spark, width, machine):
    rng = random.Random(5)
    signals = {k: [(p, 100 + 7 * p, rng.choice([None, float("nan"), *[rng.gauss(0, 1) for _ in range(8)], 2.0])) for p in range(n)] for k, n in (("a", 150), ("b", 40), ("c", 1))}
    signals["d"] = [(p, p, 5.0) for p in range(60)]  # one event over many buckets
    df = spark.createDataFrame([(k, *r) for k, rs in signals.items() for r in rs] + [(None, 1, 1, 9.0)], "k string, pos long, t_us long, signal double").repartition(3)
    got = sorted(map(tuple, machines.find_events(df, ["k"], machine, width=width).collect()))
    assert got == sorted((k, *e) for k, rs in signals.items() for e in events_by_hand(machine, rs))


def test_a_machine_as_a_registered_detector(spark):
    detect.register_detector("hysteresis", machines.detector(machines.Hysteresis(0.2, 0.5)))
    df = spark.createDataFrame([("x", p, 10 * p, v) for p, v in enumerate([0.1, 0.6, 0.9, 0.3, 0.6, 0.1, 0.4, 0.7])], "k string, pos long, t_us long, signal double")
    assert sorted(map(tuple, detect.get_detector("hysteresis")(df, ["k"]).collect())) == [("x", 20), ("x", 70)]
    assert machines.rows_of(machines.Hysteresis(0.2, 0.5), [0.6, None, 0.3, 0.1]) == [1, 1, 1, 0]
    with pytest.raises(ValueError):
        machines.Hysteresis(2, 1)


def test_exports_come_back_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, d, "x", i, i * 900_000_000, rng.random() < 0.7) for s, n in (("one", 30), ("two", 9)) for d in "ab" for i in range(n)]
    aligned = spark.createDataFrame(rows, "session_id string, device_id string, stream_id string, grid_idx long, t_us long, valid boolean").repartition(4)
    path = f"file://{tmp_path}/out"
    record = {r.session_id: r for r in export.export_timeline(aligned, path, shard_rows=5, shards=3, consumer_hint="trainer").collect()}
    for s, n in (("one", 30), ("two", 9)):
        r = record[s]
        assert (r.format, r.frame_count, r.sample_count, r.consumer_hint) == ("parquet", n, sum(x[5] for x in rows if x[0] == s), "trainer") and r.uri.endswith(f"session={s}")
    back = export.read_timeline(spark, path)
    assert sorted(map(tuple, back.select(*aligned.columns).collect())) == sorted(rows)
    for folder in (tmp_path / "out" / "data").glob("session=*/hour=*"):
        files = sorted(folder.glob("*.parquet"))
        parts = [[(r.t_us, r.device_id) for r in spark.read.parquet(f"file://{f}").collect()] for f in files]
        assert all(len(p) <= 5 for p in parts) and sum(parts, []) == sorted(sum(parts, []))
    nested = export.exports_of(export.export_timeline(aligned, f"file://{tmp_path}/again"))
    assert {r.session_id: r.exports[0].frame_count for r in nested.collect()} == {"one": 30, "two": 9}
    assert export.export_timeline(aligned.limit(0), f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="exist"):
        export.export_timeline(aligned, path)
