import heapq
import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from tidemark.operators import associate, corrupt, detect, fit, graph, metrics, transforms, validate

OBS = "s int, event_id int, device_id string, t_local_us long"


def one(df):
    (r,) = df.collect()
    return r


def points(spark, xy):
    return spark.createDataFrame([("g", int(x), int(y)) for x, y in xy], "g string, t_local_us long, t_ref_us long")


def test_fits(spark):
    r = one(fit.fit(points(spark, [(t, t + 20_000) for t in range(0, 5000, 500)]), ["g"], method="offset"))
    assert (r.alpha, r.beta_us, r.residual_us) == (1.0, 20_000.0, 0.0)
    line = points(spark, [(t * 40_000_000, round(1.000025 * t * 40_000_000) + 300) for t in range(20)])
    for m in ("ols", "tls"):
        r = one(fit.fit(line, ["g"], method=m))
        assert abs(r.alpha - 1.000025) < 1e-12 and abs(r.beta_us - 300) < 1e-3
    r = one(fit.fit(points(spark, [(1000, 3000)]), ["g"], method="ols"))
    assert (r.alpha, r.beta_us) == (1.0, 2000.0)


@pytest.mark.parametrize("method", ["offset", "ols", "tls"])
def test_fits_of_large_times_are_exact(spark, method):
    """Against fractions; sums of the times themselves leave an offset some hundredths of a microsecond out."""
    rng = random.Random(3)
    xs = [rng.randrange(3 * 10**13) for _ in range(20_000)]
    xy = [(x, x + 20_000 + x // 1_000_000 * 7 + rng.randrange(-300, 301)) for x in xs]
    n, mx, mz = len(xy), Fraction(sum(xs), len(xy)), Fraction(sum(y - x for x, y in xy), len(xy))
    sxx, sxz, szz = sum(x * x for x in xs) - n * mx * mx, sum(x * (y - x) for x, y in xy) - n * mx * mz, sum((y - x) ** 2 for x, y in xy) - n * mz * mz
    q = (2 * sxz + szz) / (2 * (sxx + sxz))
    over = {"offset": Fraction(0), "ols": sxz / sxx, "tls": q + q * q / 2}[method]  # of the root only what is above 10^-20
    df = spark.createDataFrame([("g", x, y) for x, y in xy], "g string, t_local_us long, t_ref_us long")
    assert abs(one(fit.fit(df, ["g"], method=method)).beta_us - float(mz - over * mx)) < 1e-5


def test_robust_fits(spark):
    rng = random.Random(1)
    xy = [(t * 10_000, t * 10_000 + 500 + rng.randrange(-50, 51)) for t in range(100)]
    bad = points(spark, [(x, y + (4_000_000 if i % 25 == 0 else 0)) for i, (x, y) in enumerate(xy)])
    assert abs(one(fit.fit(bad, ["g"], robust=True)).beta_us - 500) < abs(one(fit.fit(bad, ["g"])).beta_us - 500)
    many = points(spark, [(x, y + (rng.randrange(10**6, 10**7) if i % 3 == 0 else 0)) for i, (x, y) in enumerate(xy)])
    r = one(fit.ransac(many, ["g"], 500.0))
    assert abs(r.alpha - 1) < 1e-3 and abs(r.beta_us - 500) < 100 and 60 < r.n_events < 72
    two = one(fit.ransac(points(spark, [(0, 5), (10, 15)]), ["g"]))
    assert (two.alpha, two.beta_us, two.n_events) == (1.0, 5.0, 2)


def test_piecewise(spark):
    xy = [(t, t if t < 1_000_000 else 2 * t - 1_000_000) for t in range(0, 2_000_000, 20_000)]
    seg = fit.fit_piecewise(points(spark, xy), ["g"], 2)
    r = seg.orderBy("segment").collect()
    assert [round(x.alpha, 6) for x in r] == [1.0, 2.0] and r[0].t_lo_us == -1e18 and r[1].t_hi_us == 1e18 and r[0].t_hi_us == r[1].t_lo_us == 990_000.0
    mapped = points(spark, xy).join(fit.as_models(seg, ["g"]), "g").withColumn("m", transforms.to_reference("t_local_us"))
    assert mapped.where("abs(m - t_ref_us) > 1").count() == 0
    assert fit.fit_piecewise(points(spark, [(0, 0), (1, 1), (2, 2)]), ["g"], 5).count() == 1


def test_piecewise_runs_by_brute_force(spark):
    """Runs that begin inside a bucket, at its edge and among rows that are the same, against a sort; groups of no and of few rows to cut."""
    rng = random.Random(3)
    rows = [(g, rng.randrange(-40, 40) * (5 if g == "a" else 1), rng.randrange(3)) for g, n in (("a", 401), ("b", 90), ("c", 7), ("d", 1)) for _ in range(n)] + [("e", 5, 5)] * 30 + [("f", i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, t_local_us long, t_ref_us long").repartition(3)
    got = {(r.g, r.segment): (r.t_lo_us, r.t_hi_us, r.n_events) for r in fit.fit_piecewise(df, ["g"], 4, width=10).collect()}
    want = {}
    for g in "abcdef":
        xs = sorted((x, y) for h, x, y in rows if h == g)
        k = max(1, min(4, len(xs) // 2))
        cuts = [math.floor(i * (len(xs) / k)) for i in range(k)] + [len(xs)]
        runs = [xs[a:b] for a, b in zip(cuts, cuts[1:])]
        for i, run in enumerate(runs):
            want[g, i] = ((runs[i - 1][-1][0] + run[0][0]) / 2 if i else -1e18, (run[-1][0] + runs[i + 1][0][0]) / 2 if i + 1 < k else 1e18, len(run))
    assert got == want


def test_rows_of_few_groups_are_not_sorted(spark):
    """Few lines are broadcast to the rows, also where the rows' groups leave most partitions of an exchange empty."""
    df = points(spark, [(i * 1000, i * 1000 + i % 7) for i in range(200)])
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        for got in (fit.fit(df, ["g"], robust=True), fit.rate_piecewise(df, fit.fit_piecewise(df, ["g"], 4), ["g"])):
            got.collect()
            assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_transforms(spark):
    df = spark.createDataFrame([(500,), (2000,), (5000,)], "t long").withColumn("alpha", F.lit(1.0)).withColumn("beta_us", F.lit(0.0))
    seg = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("t_lo_us", "t_hi_us", "alpha", "beta_us"), x)]) for x in ((-1e18, 1000.0, 1.0, 0.0), (1000.0, 3000.0, 2.0, 100.0))])
    assert [r.x for r in df.withColumn("segments", seg).select(transforms.to_reference("t").alias("x")).collect()] == [500, 4100, 10_100]
    q = spark.createDataFrame([(0,), (1234,), (1999,)], "t long").select(transforms.quantize("t", 1000).alias("q"))
    assert [r.q for r in q.collect()] == [0, 1000, 2000]
    half = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (2.5,)], "t double").select(transforms.to_long("t").alias("q"))
    assert [r.q for r in half.collect()] == [0, 2, 0, 2]
    m = spark.createDataFrame(list(enumerate([0, 100, 100, 90, 300])), "i int, t int").withColumn("k", F.lit(1))
    got = [r.t_mono for r in transforms.enforce_monotonic(m, ["k"], "i", "t").orderBy("i").collect()]
    assert got == [0, 100, 102, 103, 300]
    with pytest.raises(ValueError):
        transforms.quantize("t", 0)


def test_peaks_and_matching(spark):
    sig = [0, 0, 9, 8, 0, 0, 7, 6, 0, 0, float("nan"), 1, 3, 3]
    df = spark.createDataFrame([("a", i, float(v), i) for i, v in enumerate(sig)], "d string, t_us long, signal double, pos long")
    assert sorted(r.t_local_us for r in detect.find_peaks(df, ["d"]).collect()) == [2, 6, 12]
    assert detect.registered_detectors()[:2] == ["tactile_tap", "visual_flash"]
    with pytest.raises(KeyError):
        detect.get_detector("none")
    det = spark.createDataFrame([(1, "a", 3), (1, "a", 1), (1, "b", 20), (1, "b", 10), (2, "a", 1), (2, "b", 1), (2, "b", 2), (3, "a", 1)], "s int, device_id string, t_local_us long")
    got = sorted((r.event_no, r.device_id, r.t_local_us) for r in associate.match_by_order(det, ["s"]).collect())
    assert got == [(0, "a", 1), (0, "b", 10), (1, "a", 3), (1, "b", 20)]
    assert sorted(r.s for r in associate.unmatchable(det, ["s"]).collect()) == [2, 3]


def scan(rows, tol, least):
    clusters = []
    for ct, dev, t in sorted(rows):
        if clusters:
            c = clusters[-1]
            centre = c["s"] / c["n"]
            if abs(ct - centre) <= tol:
                if dev not in c["m"]:
                    c["m"][dev] = (ct, t)
                    c["s"] += ct
                    c["n"] += 1
                elif abs(ct - centre) < abs(c["m"][dev][0] - centre):
                    c["m"][dev] = (ct, t)
                continue
        clusters.append({"m": {dev: (ct, t)}, "s": ct, "n": 1})
    return [{d: t for d, (_, t) in c["m"].items()} for c in clusters if len(c["m"]) >= least]


def test_association_agrees_with_a_scan(spark):
    rng = random.Random(2)
    rows = [(s, rng.choice("abcd"), rng.randrange(60_000)) for s in range(25) for _ in range(120)]
    df = spark.createDataFrame(rows, "s int, device_id string, t_local_us long")
    coarse = spark.createDataFrame([("b", 1.0, -500.0)], "device_id string, alpha double, beta_us double")
    got = {}
    for r in associate.associate(df.repartition(5), ["s"], 300.0, coarse).collect():
        got.setdefault((r.s, r.event_no), {})[r.device_id] = r.t_local_us
    for s in range(25):
        want = scan([(t - (500.0 if d == "b" else 0.0), d, t) for k, d, t in rows if k == s], 300, 2)
        assert [got[s, i] for i in range(len(want))] == want and (s, len(want)) not in got


def dijkstra(edges, ref):
    adj = {}
    for a, b, k in edges:
        adj.setdefault(a, []).append((b, k))
        adj.setdefault(b, []).append((a, k))
    dist, parent, done, heap = {ref: 0.0}, {}, set(), [(0.0, ref)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        for v, k in adj.get(u, []):
            if v not in done and d - math.log(max(k, 1e-9)) < dist.get(v, math.inf):
                dist[v], parent[v] = d - math.log(max(k, 1e-9)), u
                heapq.heappush(heap, (dist[v], v))
    paths = {}
    for d in dist:
        p = [d]
        while p[-1] in parent:
            p.append(parent[p[-1]])
        paths[d] = p[::-1]
    return dist, paths


def test_reconcile_agrees_with_dijkstra(spark):
    rng = random.Random(3)
    names, rows, devs = "abcdef", [], []
    for s in range(12):
        devs += [(s, n, n == "a") for n in names]
        rows += [(s, x, y, 1.0 + rng.random() * 1e-5, rng.random() * 1000, rng.choice([0.5, 0.25, 0.9, 0.81])) for x, y in itertools.combinations(names, 2) if rng.random() < 0.45]
    edges = spark.createDataFrame(rows, "s int, a string, b string, alpha double, beta_us double, confidence double")
    got = {(r.s, r.device_id): r for r in graph.reconcile(edges, spark.createDataFrame(devs, "s int, device_id string, is_reference boolean"), ["s"]).collect()}
    assert len(got) == len(devs)
    for s in range(12):
        dist, paths = dijkstra([(a, b, k) for q, a, b, _, _, k in rows if q == s], "a")
        for n in names:
            r = got[s, n]
            assert r.reachable == (n in dist)
            if n in dist:
                assert abs(r.cost - dist[n]) < 1e-9 and r.path == paths[n] and r.hops == len(paths[n]) - 1
            else:
                assert (r.alpha, r.beta_us, r.clock_confidence) == (1.0, 0.0, 0.0)


def test_edges_and_transitive_models(spark):
    rows = []
    for e in range(12):
        t = e * 1_000_000
        rows += [(1, e, "A", t), (1, e, "B", t - 500)] if e < 6 else [(1, e, "B", t - 500), (1, e, "C", t + 900)]
    rows += [(1, 99, "D", 5)]
    obs = spark.createDataFrame(rows, OBS)
    edges = graph.build_edges(obs, ["s"])
    assert sorted((r.a, r.b, round(r.beta_us), r.n_events) for r in edges.collect()) == [("A", "B", 500, 6), ("B", "C", -1400, 6)]
    devs = spark.createDataFrame([(1, d, d == "A") for d in "ABCD"], "s int, device_id string, is_reference boolean")
    got = {r.device_id: r for r in graph.reconcile(edges, devs, ["s"]).collect()}
    assert got["C"].path == ["A", "B", "C"] and abs(got["C"].beta_us + 900) < 1e-3 and not got["D"].reachable
    assert graph.build_edges(obs, ["s"], min_events=7).count() == 0
    models = graph.reconcile(edges, devs, ["s"]).join(devs, ["s", "device_id"])
    assert metrics.reconciliation_residual(obs, models, ["s"]).first().sync_resid_us == 0.0


def test_gate(spark):
    rows = [(200.0, 1.0, 0.0), (1200.0, 1.0, 0.0), (6000.0, 1.0, 0.0), (200.0, 0.5, 0.0), (200.0, 1.0, 0.2)]
    df = spark.createDataFrame(rows, "r double, c double, d double").select(metrics.gate("r", "c", "d").alias("v"))
    assert [r.v for r in df.collect()] == ["certified", "release", "blocked", "needs_review", "needs_review"]
    with pytest.raises(ValueError):
        metrics.Gates(certified_resid_us=3000)


def test_bursts_agree_with_the_chain(spark):
    df = spark.range(4000).withColumn("k", F.lit(1))
    u = [r.u for r in df.orderBy("id").select(corrupt.chance("id", 20).alias("u")).collect()]
    bad, keep = False, []
    for i, x in enumerate(u):
        lost = bad or x < 0.05
        if not lost:
            keep.append(i)
        if bad:
            bad = x >= 0.3
        else:
            bad = x < 0.05
    got = sorted(r.id for r in corrupt.drop_bursts(df, ["k"], "id", "id", 0.05, 0.3).collect())
    assert got == keep
    rate = corrupt.drop_random(df, "id", 0.1).count() / 4000
    assert 0.08 < rate - 0.8 < 0.12


def test_bursts_take_rows_of_one_time_together(spark):
    """Every time occurs three times: sums over the rows of a time, then the state before for the first of them."""
    df = spark.range(3000).selectExpr("id", "1 as k", "id % 1000 as t")
    rows = [(r.t, r.id, r.u) for r in df.select("t", "id", corrupt.chance("id", 20).alias("u")).orderBy("t", "id").collect()]
    flips, bad, keep = 0, False, []
    for t in range(1000):
        here = [(i, u) for x, i, u in rows[3 * t : 3 * t + 3]]
        flips = (0 if any(0.05 <= u < 0.3 for _, u in here) else flips) + sum(u < 0.05 for _, u in here)
        for i, u in here:
            if not bad and u >= 0.05:
                keep.append(i)
            bad = flips % 2 == 1
    got = sorted(r.id for r in corrupt.drop_bursts(df.repartition(7), ["k"], "t", "id", 0.05, 0.3).collect())
    assert got == sorted(keep)


def test_validation(spark):
    s = spark.createDataFrame([("r", None, 1, 0, 0.5), ("r", "i", -1, 0, 1.5), (None, None, 1, -1, None)], "payload_ref string, payload_inline string, t_device_us long, seq long, confidence double")
    assert sorted(r.reason for r in validate.sample_violations(s).collect()) == ["confidence", "payload", "payload", "seq", "t_device_us"]
    m = spark.createDataFrame([(0, 5, 1), (1, 5, 2), (2, 5, 2), (3, 4, 3)], "o int, t long, q int").withColumn("k", F.lit(1))
    assert sorted(r.o for r in validate.monotonic_violations(m, ["k"], "o", "t", "q").collect()) == [2, 3]
    c = spark.createDataFrame([(1.0, None, 0.5), (-1.0, -2.0, 2.0)], "alpha double, fit_residual_us double, clock_confidence double")
    assert sorted(r.reason for r in validate.model_violations(c).collect()) == ["alpha", "clock_confidence", "fit_residual_us"]
