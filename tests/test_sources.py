import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tidemark.functions import scalars
from tidemark.operators import metrics, validate
from tidemark.plans import engine, lifecycle
from tidemark.sources import readers, sessions
from tidemark.streaming import online


def test_timestamps_and_topology(spark, tmp_path):
    table = pa.table({"t_master_us": [i * 625 for i in range(8)], "other": ["x"] * 8})
    meta = {b"sim_meta": json.dumps({"descriptor_version": "1.2", "descriptor_hash": "abc"}).encode(), b"bad": b"{"}
    path = str(tmp_path / "e.parquet")
    pq.write_table(table.replace_schema_metadata(meta), path)
    assert readers.topology_of(path) == {"topology_ref": "1.2", "topology_hash": "abc"}
    df = readers.timestamps_from_parquet(spark, path, "glove", ["a", "b"], base="memory://glove")
    rows = df.where("stream_id = 'b'").orderBy("seq").collect()
    assert [(r.t_device_us, r.seq) for r in rows] == [(i * 625, i) for i in range(8)]
    assert rows[3].payload_ref == "memory://glove#stream=b&row=3"
    assert readers.limit_per_stream(df, ["stream_id"], 3).count() == 6
    assert readers.ingest([df, df.drop("payload_ref")]).count() == 32
    scan = df.groupBy("stream_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "other" not in scan


def test_bundle_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    readers.save_bundle({"t": df, "u": df.where("x = 1")}, f"file://{tmp_path}/b", {"session": "s1"})
    tables, info = readers.load_bundle(spark, f"file://{tmp_path}/b")
    assert sorted(map(tuple, tables["t"].collect())) == [(1, "a"), (2, None)] and info == {"session": "s1"}
    readers.save_mapping({"policy": "designated_anchor", "gates": {"min_coverage": 0.5}}, str(tmp_path / "c.json"))
    c = readers.ReferenceConfig.load(str(tmp_path / "c.json"))
    assert c.gates.min_coverage == 0.5 and readers.config_dict(c)["grid_rate_hz"] == 1600.0
    for bad in ({"policy": "vote"}, {"grid_rate_hz": 0}):
        with pytest.raises(ValueError):
            readers.ReferenceConfig(**bad)
    with pytest.raises(ValueError):
        readers.save_mapping({}, str(tmp_path / "c.txt"))
    with pytest.raises(FileNotFoundError):
        readers.load_mapping(str(tmp_path / "none.json"))


def test_scalars(spark):
    rows = [("file://b/k#row=1",), ("x://y",), ("plain",), ("memory://a#",), (None,), ("file://",), ("1.2.3-rc.1+b",), ("2.0.0",), ("1.x",), ("1.2.3.4",), ("1.2",)]
    df = spark.createDataFrame(rows, "v string").select(scalars.parse_uri("v").alias("u"), scalars.is_payload_uri("v").alias("k"), scalars.semver("v").alias("s"), scalars.contract_version_supported("v").alias("ok"))
    got = df.collect()
    assert tuple(got[0].u) == ("file", "b/k", "row=1") and got[0].k
    assert got[1].u is None and not got[1].k  # a scheme that is not registered
    assert got[2].u is None and tuple(got[3].u) == ("memory", "a", None) and got[4].u is None and not got[4].k
    assert got[5].u is None and got[5].k  # the cheap look takes an address without a location
    assert got[6].s == [1, 2, 3] and [r.ok for r in got[6:]] == [True, False, False, True, False]
    for bad in ("", "a b", "c/d", None):
        with pytest.raises(ValueError):
            scalars.register_scheme(bad)
    assert scalars.allowed_schemes() == ["file", "mcap", "memory", "parquet"]
    scalars.register_scheme("x")
    assert "x" in scalars.allowed_schemes()
    r = spark.range(1).select(scalars.build_uri(F.lit("x"), F.lit("b"), F.lit("c")).alias("x"), scalars.build_uri(F.lit("x"), F.lit("b"), F.lit("")).alias("y"), scalars.build_uri(F.lit("zz"), F.lit("b")).alias("z")).first()
    assert tuple(r) == ("x://b#c", "x://b", None)


def test_select_reference(spark):
    rows = [("1", "glove", True, ["shared_event"], 400.0), ("1", "cam", False, ["shared_event"], 900.0), ("2", "glove", True, ["shared_event"], 400.0), ("2", "tracker", False, ["hardware_ptp"], 90.0), ("3", "zzz", True, ["wall_clock"], 5.0), ("3", "aaa", True, ["wall_clock"], 5.0)]
    df = spark.createDataFrame(rows, "session_id string, device_id string, reference_candidate boolean, evidence_tiers array<string>, max_rate_hz double")
    assert {r.session_id: r.device_id for r in engine.select_reference(df).collect()} == {"1": "glove", "2": "tracker", "3": "aaa"}


def test_engine_recovers_injected_clocks(spark):
    rng = random.Random(1)
    truth = {"a": (1.0, 0.0), "b": (1.000025, 20_000.0), "c": (0.999990, -7000.0)}
    devices = [(s, d, d == "a") for s in (1, 2) for d in (*truth, "rogue")]
    samples, obs = [], []
    for s in (1, 2):
        for d, (al, be) in truth.items():
            samples += [(s, d, "x", round((t - be) / al)) for t in range(0, 8_000_000, 40_000)]
            obs += [(s, e, d, round((t - be) / al) + rng.randrange(-2, 3), "shared_event") for e, t in enumerate(range(0, 8_000_000, 100_000)) if (e % 3 or d != "c")]
        samples.append((s, "rogue", "x", 5))
    streams = [(s, d, "x", "continuous" if d == "b" else "hold") for s, d, _ in devices]
    r = engine.synchronize(
        spark.createDataFrame(devices, "session_id int, device_id string, is_reference boolean"),
        spark.createDataFrame(streams, "session_id int, device_id string, stream_id string, kernel string"),
        spark.createDataFrame(samples, "session_id int, device_id string, stream_id string, t_device_us long"),
        spark.createDataFrame(obs, "session_id int, event_id int, device_id string, t_local_us long, tier string"),
        100.0,
        60_000,
        truth=spark.createDataFrame([(s, d, *x) for s in (1, 2) for d, x in truth.items()], "session_id int, device_id string, alpha double, beta_us double"),
        confidence_decay_tau_us=1e6,
    )
    for x in r.roundtrip.collect():
        assert x.alpha_err < 1e-5 and x.beta_err_us < 20 and x.alignment_rmse_us < 20
    report = r.report.collect()
    assert len(report) == 2 and all(x.sync_resid_us < 20 and x.sync_method == "shared_event" and x.no_fabricated_gaps == "pass" for x in report)
    cover = {(x.device_id): x.coverage for x in r.coverage.where("session_id = 1").collect()}
    assert cover["a"] > 0.98 and cover["b"] > 0.98 and cover["rogue"] < 0.1
    assert r.confidence.where("valid and device_id = 'b' and (clock <= 0 or clock > 1)").count() == 0
    assert r.confidence.where("device_id = 'rogue' and clock > 0").count() == 0


def test_engine_writes_no_row_for_a_point(spark):
    """Points may be many thousand times the samples, so none of the tables that are written holds them."""
    seen = [(d, k, d, 500_000_000 * k, "shared_event") for d in ("a", "b") for k in range(4)]
    obs = spark.createDataFrame([(1, k, d, t, tier) for d, k, _, t, tier in seen], "session_id int, event_id int, device_id string, t_local_us long, tier string")
    devices = spark.createDataFrame([(1, "a", True), (1, "b", False)], "session_id int, device_id string, is_reference boolean")
    streams = spark.createDataFrame([(1, "a", "x", "hold"), (1, "b", "x", "continuous")], "session_id int, device_id string, stream_id string, kernel string")
    samples = obs.select("session_id", "device_id", F.lit("x").alias("stream_id"), F.col("t_local_us").alias("t_device_us"))
    sizes = []
    real = {n: getattr(engine, n) for n in ("checkpointed", "stored") if hasattr(engine, n)}
    try:
        for n, write in real.items():
            setattr(engine, n, lambda d, write=write: sizes.append((out := write(d)).count()) or out)
        r = engine.synchronize(devices, streams, samples, obs, 1.0, 2_000_000)
    finally:
        for n, write in real.items():
            setattr(engine, n, write)
    assert max(sizes) <= 10 and r.confidence.count() == 3002


def test_lifecycle_and_devices(spark):
    m = lifecycle.SessionManager("s1")
    with pytest.raises(lifecycle.TransitionError):
        m.finalize_registration()
    m.start().register_device("a", reference=True).register_device("b")
    with pytest.raises(ValueError):
        m.register_device("a")
    assert m.finalize_registration().state == lifecycle.DEVICES_REGISTERED
    with pytest.raises(NotImplementedError):
        m.advance("synchronized")
    df = spark.createDataFrame([("1", "a", True), ("1", "b", True), ("2", "a", True)], "session_id string, device_id string, is_reference boolean")
    assert [r.session_id for r in validate.session_violations(df).collect()] == ["1"]


def test_streams(spark, tmp_path):
    rows = [("a", i * 1000, 2 * i * 1000 + 7, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(1500)]
    df = spark.createDataFrame(rows, "device_id string, t_local_us long, t_ref_us long, at string").withColumn("at", F.to_timestamp("at"))
    df.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = online.online_fit(stream, ["device_id"], "at").writeStream.format("memory").queryName("fits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from fits").collect()
    assert got and all(abs(r.alpha - 2) < 1e-9 and abs(r.beta_us - 7) < 1e-3 for r in got)


def test_residual_without_events(spark):
    m = spark.createDataFrame([(1, "a", True, 1.0, 0.0, 1.0)], "s int, device_id string, is_reference boolean, alpha double, beta_us double, clock_confidence double")
    o = spark.createDataFrame([], "s int, event_id int, device_id string, t_local_us long")
    assert metrics.reconciliation_residual(o, m, ["s"]).first().sync_resid_us == 0.0


def test_samples_from_times(spark):
    times = spark.createDataFrame([("g", "t", 5 * i, 100 - i) for i in range(70_000)] + [("g", "u", 1, 7)], "device_id string, stream_id string, pos long, t_device_us long")
    streams = spark.createDataFrame([("g", "t"), ("g", "u"), ("g", "none")], "device_id string, stream_id string")
    got = readers.samples_from_times(times, streams, "file://x/y").where("seq in (0, 1, 69999)").orderBy("stream_id", "seq").collect()
    assert [(r.stream_id, r.t_device_us, r.seq, r.payload_ref) for r in got] == [("t", 100, 0, "file://x/y#stream=t&row=0"), ("t", 99, 1, "file://x/y#stream=t&row=1"), ("t", 100 - 69_999, 69_999, "file://x/y#stream=t&row=69999"), ("u", 7, 0, "file://x/y#stream=u&row=0")]
    for bad in ("x/y", "ftp://x", "file://", "file://x#a"):
        with pytest.raises(ValueError):
            readers.samples_from_times(times, streams, bad)
    with pytest.raises(ValueError, match="not declared"):
        readers.samples_from_times(times, streams.where("stream_id <> 'u'"), "file://x")


def test_observers_summary_and_exports(spark):
    import tidemark
    from tidemark.operators import associate, timeline

    seen = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 2, "a")], "s int, event_id int, device_id string")
    assert sorted(map(tuple, associate.observers(seen, ["s"]).collect())) == [(1, 1, ["a", "b"], True), (1, 2, ["a"], False)]
    points = spark.createDataFrame([(1, 0, 5), (1, 1, 9)], "s int, grid_idx long, t_us long")
    got = timeline.summary(points, spark.createDataFrame([(1,), (2,)], "s int"), ["s"])
    assert sorted(map(tuple, got.collect())) == [(1, 2, 5, 9), (2, 0, 0, 0)]
    assert all(getattr(tidemark, n) is not None for n in tidemark.__all__)
    with pytest.raises(AttributeError):
        tidemark.nothing


def test_a_save_that_breaks_leaves_the_last_version(spark, tmp_path):
    """Versions are whole or not there; a table may be made from the version before; sessions stay with the result."""
    path = f"file://{tmp_path}/b"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string")
    docs = spark.createDataFrame([(json.dumps({"metadata": {"session_id": "one", "origin": "real", "producers": ["p"]}, "devices": []}),)], "value string")
    kept = sessions.from_json(docs)
    with pytest.raises(ValueError, match="no bundle"):
        readers.load_bundle(spark, path)
    assert readers.save_bundle({"t": df}, path, {"n": 1}, kept) == 1
    torn = df.withColumn("z", F.when(F.col("x") == 2, F.raise_error(F.lit("torn"))).otherwise(F.lit(0)))
    with pytest.raises(Exception, match="torn"):
        readers.save_bundle({"s": df, "t": torn}, path, {"n": 2})
    tables, info = readers.load_bundle(spark, path)
    assert info == {"n": 1} and set(tables) == {"t"} and tables["t"].count() == 2
    assert [tuple(r) for r in sessions.to_json(readers.load_bundle_sessions(spark, path)).collect()] == [tuple(r) for r in sessions.to_json(kept).collect()]
    assert readers.save_bundle({"t": tables["t"].unionByName(df)}, path, {"n": 3}) == 2  # made from the version before
    assert readers.load_bundle(spark, path)[0]["t"].count() == 4 and readers.load_bundle_sessions(spark, path) is None
    assert readers.load_bundle(spark, path, 1)[0]["t"].count() == 2
    # a manifest whose writing broke off is no version
    (tmp_path / "b" / "_commits" / "00000009").mkdir()
    (tmp_path / "b" / "_commits" / "00000009" / "part-0").write_text("{")
    assert readers.load_bundle(spark, path)[1] == {"n": 3}
    readers.drop_versions(spark, path)
    assert readers.load_bundle(spark, path)[0]["t"].count() == 4 and len([f for f in (tmp_path / "b").iterdir() if f.name.startswith("v")]) == 1
    with pytest.raises(ValueError, match="version 1"):
        readers.load_bundle(spark, path, 1)


def test_public_names():
    import tidemark
    from tidemark import functions, operators, plans, sources, streaming

    for package in (tidemark, functions, operators, plans, sources, streaming):
        assert package.__all__ and all(getattr(package, n) is not None for n in package.__all__)
        with pytest.raises(AttributeError):
            package.nothing_of_the_kind


def test_one_check_of_a_batch(spark):
    rows = [("s", "d", "x", 0, 0, 5, "file://a", None, 0.5), ("s", "d", "x", 1, 1, 5, "file://a", None, None), ("s", "d", "x", 2, 2, 4, None, None, 2.0), ("s", "d", None, 3, 3, -1, "file://a", b"x".hex(), None), ("s", "e", "x", 4, None, 9, "file://a", None, None), ("s", "e", "x", 5, None, 9, "file://a", None, None)]
    batch = spark.createDataFrame(rows, "session_id string, device_id string, stream_id string, pos long, seq long, t_device_us long, payload_ref string, payload_inline string, confidence double")
    assert sorted((r.pos, r.reason) for r in sessions.batch_violations(batch).collect()) == [(2, "confidence"), (2, "order"), (2, "payload"), (3, "payload"), (3, "stream"), (3, "t_device_us"), (5, "order")]
