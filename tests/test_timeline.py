import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import confidence, timeline


def frames(spark, grid, samples):
    g = spark.createDataFrame([("k", i, t) for i, t in enumerate(grid)], "k string, grid_idx long, t_us long")
    s = spark.createDataFrame([("k", t) for t in samples], "k string, t_ref_us long")
    return g, s


def run(spark, grid, samples, tol, kernel, **kw):
    g, s = frames(spark, grid, samples)
    return sorted(timeline.asof_join(g, s, ["k"], tol, kernel, **kw).collect(), key=lambda r: r.grid_idx)


def brute(grid, samples, tol, kernel):
    s = sorted(samples)
    for i, g in enumerate(grid):
        n = sum(x <= g for x in s)
        prev, nxt = (s[n - 1] if n else None), (s[n] if n < len(s) else None)
        back, ahead = (g - prev if n else None), (nxt - g if n < len(s) else None)
        gap = back if kernel == "hold" else min([x for x in (back, ahead) if x is not None], default=None)
        valid = gap is not None and gap <= tol
        both = kernel == "continuous" and n and n < len(s)
        yield i, n - 1, (n if kernel == "continuous" and n < len(s) else -1), ((g - prev) / (nxt - prev) if both else 0.0), valid, (max(0.0, 1 - gap / tol) if valid else 0.0)


def test_hold(spark):
    got = run(spark, [0, 100, 250, 1000], [0, 200], 150, "hold")
    assert [r.source_index for r in got] == [0, 0, 1, 1]
    assert [r.valid for r in got] == [True, True, True, False]
    assert got[0].interp_confidence == 1 and got[3].interp_confidence == 0
    assert [r.valid for r in run(spark, [0, 50], [40], 100, "hold")] == [False, True]


def test_continuous(spark):
    (r,) = run(spark, [500], [0, 1000], 2000, "continuous")
    assert (r.source_index, r.next_index, r.weight, r.valid) == (0, 1, 0.5, True)
    assert [r.valid for r in run(spark, [0, 100], [], 10, "continuous")] == [False, False]
    early = run(spark, [0], [40], 100, "continuous")[0]
    assert (early.source_index, early.next_index, early.weight, early.valid) == (-1, 0, 0.0, True)


@pytest.mark.parametrize("kernel", ["hold", "continuous"])
def test_cut_into_buckets_changes_nothing(spark, kernel):
    rng = random.Random(1)
    samples = [rng.randrange(-5000, 9000) for _ in range(150)] + [77] * 5
    grid = sorted(rng.randrange(-8000, 12_000) for _ in range(200)) + [77]
    want = list(brute(grid, samples, 90, kernel))
    for bucket in (50, 1000, 10**9):
        got = run(spark, grid, samples, 90, kernel, bucket_us=bucket)
        for r, w in zip(got, want, strict=True):
            assert (r.grid_idx, r.source_index, r.next_index, r.valid) == (*w[:3], w[4])
            assert abs(r.weight - w[3]) < 1e-12 and abs(r.interp_confidence - w[5]) < 1e-12


def test_grid(spark):
    s = spark.createDataFrame([("k", t) for t in (0, 1000, 2000)], "k string, t_ref_us long")
    assert [r.t_us for r in timeline.grid(s, ["k"], 1000.0).orderBy("grid_idx").collect()] == [0, 1000, 2000]
    s = spark.createDataFrame([("k", 5), ("k", 300_000_005)], "k string, t_ref_us long")
    got = [r.t_us for r in timeline.grid(s, ["k"], 30.0).orderBy("grid_idx").collect()]
    assert got == (5 + np.rint(np.arange(9001) * (1e6 / 30))).astype(int).tolist()


def test_subframes(spark):
    assert timeline.slots_per_frame(1600, 30) == 54 and timeline.slots_per_frame(1000, 100) == 10

    def buckets(anchors, samples, slots):
        g = spark.createDataFrame([("k", t) for t in anchors], "k string, t_us long")
        s = spark.createDataFrame([("k", t) for t in samples], "k string, t_ref_us long")
        return timeline.subframe_buckets(g, s, ["k"], slots, bucket_us=64).orderBy("frame_idx").collect()

    got = buckets([0, 100, 200], [10, 20, 110], 3)
    assert [(r["index"], r.m_k) for r in got] == [([0, 1, 1], 2), ([2, 2, 2], 1)]
    got = buckets([0, 100, 200], [10], 2)
    assert [(r["index"], r.m_k, r.valid) for r in got] == [([0, 0], 1, True), ([0, 0], 0, False)]
    assert [(r["index"], r.m_k) for r in buckets([0, 100], [0, 1, 2, 99, 100], 2)] == [([0, 1], 2)]


def test_confidence(spark):
    g, s = frames(spark, [0, 100, 99_000], [0, 100, 200])
    a = timeline.asof_join(g, s, ["k"], 150)
    models = spark.createDataFrame([("k", 0.8)], "k string, clock_confidence double")
    flat = confidence.build_confidence(a, models, ["k"]).orderBy("grid_idx").collect()
    assert [(r.source, r.clock) for r in flat] == [(1.0, 0.8), (1.0, 0.8), (0.0, 0.0)]
    wide = timeline.asof_join(g, s, ["k"], 200_000)
    at = spark.createDataFrame([("k", 0)], "k string, t_ref_us long")
    r = confidence.build_confidence(wide, models, ["k"], at, 10_000.0).orderBy("grid_idx").collect()
    assert r[0].clock == 0.8 and r[2].clock < 0.01 * 0.8
    own = spark.createDataFrame([("k", 0, 0.5), ("k", 1, 0.25)], "k string, source_index long, confidence double")
    r = confidence.build_confidence(a, models, ["k"], source=own).orderBy("grid_idx").collect()
    assert [x.source for x in r] == [0.5, 0.25, 0.0]


@pytest.mark.parametrize("kernel", ["hold", "continuous"])
@pytest.mark.parametrize("bucket", [50, 10**9])
def test_rated_samples_by_hand(spark, kernel, bucket):
    """Samples that are not usable, ties of both kinds, confidences, and a stream of unusable samples alone."""
    from pyspark.sql import functions as F

    rng = random.Random(7)
    points = [(k, i, 7 * i - 20) for k in ("a", "b", "c") for i in range(60)]
    samples = [("a", rng.randrange(350), rng.choice([True, False, None]), rng.choice([None, 0.25, 0.5, 0.75])) for _ in range(50)] + [("b", t, False, 0.5) for t in (5, 80)]
    samples += [("a", 40, True, 0.25), ("a", 40, False, 0.5), ("a", 40, True, 0.5), ("a", None, True, 0.1)]
    g = spark.createDataFrame(points, "k string, grid_idx long, t_us long")
    s = spark.createDataFrame(samples, "k string, t_ref_us long, valid boolean, confidence double").repartition(3)
    got = timeline.asof_join_rated(g, s, ["k"], 12, kernel, F.col("valid"), "confidence", bucket)
    want = []
    for k, i, t in points:
        whole = sorted((x[1], x[2] is not False, 1.0 if x[3] is None else x[3]) for x in samples if x[0] == k and x[1] is not None)
        use = [(p, x) for p, x in enumerate(whole) if x[1]]
        prev = [(j, p, x) for j, (p, x) in enumerate(use) if x[0] <= t][-1:]
        nxt = [(j, p, x) for j, (p, x) in enumerate(use) if x[0] > t][:1]
        gaps = [t - prev[0][2][0]] if prev else []
        if kernel == "continuous":
            gaps += [nxt[0][2][0] - t] if nxt else []
        gap = min(gaps, default=None)
        valid = gap is not None and gap <= 12
        both = kernel == "continuous" and bool(nxt)
        weight = (t - prev[0][2][0]) / (nxt[0][2][0] - prev[0][2][0]) if both and prev else 0.0
        want.append((k, i, t, prev[0][1] if prev else -1, nxt[0][1] if both else -1, weight, valid, max(0.0, 1 - gap / 12) if valid else 0.0, prev[0][0] if prev else -1, prev[0][2][2] if prev else 0.0))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plain = timeline.asof_join(g, s.where("k = 'a'"), ["k"], 12, kernel, bucket)
    rated = timeline.asof_join_rated(g, s.where("k = 'a'"), ["k"], 12, kernel, bucket_us=bucket)
    assert sorted(map(tuple, rated.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_points_of_stretches_are_those_of_the_asof_joins(spark):
    """Ties, streams without samples, samples that are not usable, rates whose points share microseconds or fall on halves."""
    rng = random.Random(8)
    rows = [(g, d, t, rng.random() < 0.7, rng.choice([None, 0.25, 0.5])) for g in (1, 2) for d in "ab" for t in sorted(rng.choices(range(50, 400), k=60))] + [(1, "a", None, True, 1.0), (2, "b", 430, False, 1.0)]
    samples = spark.createDataFrame(rows, "g int, d string, t_ref_us long, ok boolean, c double")
    streams = spark.createDataFrame([(g, d, k) for g in (1, 2) for d, k in (("a", "hold"), ("b", "continuous"), ("none", "continuous"))], "g int, d string, kernel string")
    for rate, usable, own in ((400_000.0, F.col("ok"), "c"), (1_700_000.0, F.col("ok"), "c"), (57_143.0, None, None)):
        rows = timeline.stretches(samples, streams, ["g"], ["g", "d"], rate, usable, own, bucket_us=90)
        got = timeline.aligned(rows, ["g", "d"], 9, rate, own is not None).collect()
        points = streams.join(timeline.grid(samples, ["g"], rate), "g")
        want = []
        for kernel in ("hold", "continuous"):
            mine, theirs = points.where(F.col("kernel") == kernel).select("g", "d", "grid_idx", "t_us"), samples.join(streams.where(F.col("kernel") == kernel), ["g", "d"], "left_semi")
            join = timeline.asof_join_rated(mine, theirs, ["g", "d"], 9, kernel, usable, own, 90) if own else timeline.asof_join(mine, theirs, ["g", "d"], 9, kernel, 90)
            want += [(*r, kernel) for r in join.collect()]
        assert len(got) > 60 and sorted(map(tuple, got)) == sorted(want)
