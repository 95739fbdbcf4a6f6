import copy
import json

import pytest
from pyspark.sql import functions as F
from tidemark.sources import sessions


def stream(device, stream_id="s", **more):
    return {"stream_id": stream_id, "device_id": device, "kind": "k", "kernel": "hold", "payload_kind": "p", "units": "u", "nominal_rate_hz": 30.0} | more


def device(name, role="follower", **more):
    d = {"device_id": name, "modality": "m", "producer": "p", "is_synthetic": True, "clock": {"clock_id": name + "_c"}, "evidence_tiers": ["shared_event"], "streams": [stream(name)]} | more
    return {"device_id": name, "role": role, "descriptor": d, "stream_refs": {"s": "file://x"}}


def session(**more):
    return {"metadata": {"session_id": "one", "origin": "synthetic", "producers": ["p"]}, "devices": [device("a", "reference"), device("b")]} | more


FULL = session(
    calibration_refs=[{"calibration_id": "c", "kind": "other", "uri": "file://c", "tier": "KNOWN", "confidence": 0.5}],
    timeline={"timeline_id": "t", "reference_clock_id": "a_c", "grid_rate_hz": 100.0, "t_start_us": 0, "t_end_us": 5, "n_grid": 3, "subframe_buckets": {"anchor_stream": "s", "rule": "repeat", "R": 4}},
    sync_report={"reference_clock_id": "a_c", "reference_selection": "designated", "sync_resid_us": 1.5, "per_device": {"b": {"device_id": "b", "ref_clock_id": "a_c", "alpha": 1.00001, "beta_us": 3.0, "n_events": 9, "clock_confidence": 0.9}}, "coverage": {"a::s": 1.0}},
    validation_report={"gate_verdict": "release", "property_checks": {"grid_monotonic": "pass"}, "roundtrip_accuracy": {"b": {"alpha_err": 1e-7}}},
    exports=[{"format": "f", "uri": "file://e", "frame_count": 3}],
    ground_truth={"clock_models": {"b": {"alpha": 1.00001, "beta_us": 2.0}}},
)


def put(doc, path, value):
    doc = copy.deepcopy(doc)
    at = doc
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return doc


#: (place, value, entity, reason) of one broken rule each.
BROKEN = [
    (("metadata", "session_id"), "", "session", "session_id"),
    (("metadata", "origin"), "elsewhere", "session", "origin"),
    (("metadata", "origin"), "real", "session", "ground_truth"),
    (("metadata", "producers"), [], "session", "producers"),
    (("metadata", "contract_version"), "2.0.0", "session", "contract_version"),
    (("metadata", "grid_rate_hz"), 0.0, "session", "grid_rate_hz"),
    (("devices",), [], "session", "devices"),
    (("devices", 1, "role"), "reference", "session", "reference"),
    (("devices", 0, "role"), "follower", "session", "reference"),
    (("devices", 1, "role"), "leader", "registration", "role"),
    (("devices", 1), device("a"), "session", "device ids"),
    (("devices", 1, "descriptor"), KeyError, "registration", "descriptor"),
    (("devices", 1, "device_id"), "z", "registration", "descriptor.device_id"),
    (("devices", 1, "stream_refs"), {"other": "file://x"}, "registration", "stream_refs"),
    (("devices", 1, "descriptor", "modality"), "", "device", "modality"),
    (("devices", 1, "descriptor", "is_synthetic"), KeyError, "device", "is_synthetic"),
    (("devices", 1, "descriptor", "contract_version"), "2.1.0", "device", "contract_version"),
    (("devices", 1, "descriptor", "clock"), KeyError, "device", "clock"),
    (("devices", 1, "descriptor", "clock", "timestamp_unit"), "ms", "device", "timestamp_unit"),
    (("devices", 1, "descriptor", "clock", "resolution_us"), 0, "device", "resolution_us"),
    (("devices", 1, "descriptor", "evidence_tiers"), ["ptp"], "device", "evidence_tiers"),
    (("devices", 1, "descriptor", "streams"), [stream("b"), stream("b")], "device", "stream ids"),
    (("devices", 1, "descriptor", "streams", 0, "device_id"), "a", "stream", "device_id"),
    (("devices", 1, "descriptor", "streams", 0, "kernel"), "cubic", "stream", "kernel"),
    (("devices", 1, "descriptor", "streams", 0, "nominal_rate_hz"), -1.0, "stream", "nominal_rate_hz"),
    (("devices", 1, "descriptor", "streams", 0, "payload_shape"), [3, 0], "stream", "payload_shape"),
    (("devices", 1, "descriptor", "streams", 0, "quality_floor"), 1.5, "stream", "quality_floor"),
    (("calibration_refs", 0, "uri"), "", "calibration", "uri"),
    (("calibration_refs", 0, "tier"), "GUESSED", "calibration", "tier"),
    (("calibration_refs", 0, "confidence"), 2.0, "calibration", "confidence"),
    (("timeline", "grid_rate_hz"), 0.0, "timeline", "grid_rate_hz"),
    (("timeline", "t_start_us"), 9, "timeline", "t_end_us"),
    (("timeline", "n_grid"), -1, "timeline", "n_grid"),
    (("timeline", "reference_clock_id"), "b_c", "session", "reference clocks"),
    (("timeline", "subframe_buckets", "R"), 0, "timeline", "R"),
    (("sync_report", "sync_resid_us"), -1.0, "sync_report", "sync_resid_us"),
    (("sync_report", "coverage"), {"a::s": 1.1}, "sync_report", "coverage"),
    (("sync_report", "per_device", "b", "alpha"), 0.0, "clock_model", "alpha"),
    (("sync_report", "per_device", "b", "clock_confidence"), -0.1, "clock_model", "clock_confidence"),
    (("validation_report", "gate_verdict"), "fine", "validation_report", "gate_verdict"),
    (("validation_report", "property_checks"), {"x": "maybe"}, "validation_report", "property_checks"),
    (("exports", 0, "frame_count"), -3, "export", "frame_count"),
    (("ground_truth", "clock_models", "b", "beta_us"), KeyError, "session", "clock_models"),
    # wrong types, which must not become a default
    (("devices", 1, "descriptor", "clock", "resolution_us"), "abc", "device", "resolution_us"),
    (("devices", 1, "descriptor", "clock", "resolution_us"), 1.7, "device", "resolution_us"),
    (("devices", 1, "descriptor", "clock", "resolution_us"), 5.0, "device", "resolution_us"),
    (("devices", 1, "descriptor", "clock", "resolution_us"), True, "device", "resolution_us"),
    (("devices", 1, "descriptor", "clock", "resolution_us"), 10**19, "device", "resolution_us"),
    (("devices", 1, "descriptor", "clock", "resolution_us"), None, "device", "resolution_us"),
    (("devices", 1, "descriptor", "clock", "timestamp_unit"), None, "device", "timestamp_unit"),
    (("devices", 1, "descriptor", "clock"), "c", "device", "clock"),
    (("devices", 1, "descriptor", "streams", 0, "nominal_rate_hz"), "fast", "stream", "nominal_rate_hz"),
    (("devices", 1, "descriptor", "streams", 0, "nominal_rate_hz"), True, "stream", "nominal_rate_hz"),
    (("devices", 1, "descriptor", "streams", 0, "payload_shape"), [3, "x"], "stream", "payload_shape"),
    (("devices", 1, "descriptor", "streams", 0, "payload_shape"), [3, None], "stream", "payload_shape"),
    (("devices", 1, "descriptor", "streams", 0, "payload_shape"), {"x": 3}, "stream", "payload_shape"),
    (("devices", 1, "descriptor", "streams", 0, "subframe_capable"), 1, "stream", "subframe_capable"),
    (("devices", 1, "descriptor", "streams", 0, "quality_floor"), "0.5", "stream", "quality_floor"),
    (("devices", 1, "descriptor", "is_synthetic"), "true", "device", "is_synthetic"),
    (("devices", 1, "descriptor", "modality"), 7, "device", "modality"),
    (("devices", 1, "descriptor", "calibration_refs"), ["c", 2], "device", "calibration_refs"),
    (("devices", 1, "descriptor"), ["b"], "registration", "descriptor"),
    (("devices", 1, "stream_refs"), {"s": 5}, "registration", "stream_refs"),
    (("devices", 1), "b", "session", "devices"),
    (("metadata", "rejection_tolerance_us"), "x", "session", "rejection_tolerance_us"),
    (("metadata", "rejection_tolerance_us"), 1.5, "session", "rejection_tolerance_us"),
    (("metadata", "grid_rate_hz"), "1600", "session", "grid_rate_hz"),
    (("metadata", "producers"), "p", "session", "producers"),
    (("metadata", "producers"), None, "session", "producers"),
    (("metadata", "contract_version"), 1, "session", "contract_version"),
    (("metadata", "contract_version"), "1" * 40 + ".0.0", "session", "contract_version"),
    (("calibration_refs", 0, "confidence"), "high", "calibration", "confidence"),
    (("timeline", "n_grid"), "3", "timeline", "n_grid"),
    (("timeline", "subframe_buckets", "R"), 4.5, "timeline", "R"),
    (("sync_report", "coverage"), {"a::s": "1"}, "sync_report", "coverage"),
    (("sync_report", "per_device", "b", "alpha"), "1", "clock_model", "alpha"),
    (("sync_report", "per_device", "b", "segments"), [{"t_lo_us": "0"}], "clock_model", "t_lo_us"),
    (("validation_report", "property_checks"), {"x": True}, "validation_report", "property_checks"),
    (("exports", 0, "frame_count"), False, "export", "frame_count"),
    (("ground_truth", "clock_models", "b", "beta_us"), "2", "session", "beta_us"),
]


def documents(spark, docs):
    return sessions.from_json(spark.createDataFrame([(json.dumps(d),) for d in docs], "value string"))


def test_rules(spark):
    assert sessions.violations(documents(spark, [session(), FULL])).count() == 0
    docs = [put(put(FULL, ("metadata", "session_id"), f"s{k}"), path, value) for k, (path, value, *_) in enumerate(BROKEN)]
    found = {}
    for r in sessions.violations(documents(spark, docs)).collect():
        found.setdefault(r.session_id, set()).add((r.entity, r.reason))
    for k, (path, _, entity, reason) in enumerate(BROKEN):
        got = found.get("" if path == ("metadata", "session_id") else f"s{k}", set())
        assert (entity, reason) in got, (path, got)
    assert sessions.violations(documents(spark, [{}, {"metadata": None}])).count() > 0


def test_types_that_are_taken(spark):
    """Numbers for doubles, anything for opaque fields, unknown fields, absent and null fields, long version numbers."""
    taken = [
        (("metadata", "grid_rate_hz"), 1600),
        (("metadata", "grid_rate_hz"), 1e300),
        (("metadata", "grid_rate_hz"), None),
        (("metadata", "anything"), [{}]),
        (("metadata", "contract_version"), "1.99999999999.0"),
        (("metadata", "contract_version"), "1." + "9" * 40 + ".0"),
        (("devices", 1, "descriptor", "clock", "expected_drift"), {"ppm": [1, "x"]}),
        (("devices", 1, "descriptor", "clock", "expected_offset_us"), 3),
        (("devices", 1, "descriptor", "param_tiers"), {"x": 5}),
        (("devices", 1, "descriptor", "streams", 0, "payload_shape"), []),
        (("sync_report", "per_device", "b", "segments"), [{"t_lo_us": 0, "t_hi_us": 1.5, "alpha": 1, "beta_us": -2}]),
    ]
    assert sessions.violations(documents(spark, [put(FULL, path, value) for path, value in taken])).collect() == []


def test_each_fault_is_told_once_with_its_type(spark):
    rows = documents(spark, [put(FULL, ("devices", 1, "descriptor", "clock", "resolution_us"), "abc"), [1], "x"])
    assert [[tuple(f) for f in r.type_faults] for r in rows.collect()] == [[("device", "b", "resolution_us", "bigint", "STRING")], [("session", None, "document", "struct", "ARRAY")], [("session", None, "document", "struct", "STRING")]]
    found = sessions.violations(rows.limit(1)).collect()
    assert [tuple(r) for r in found] == [("one", "device", "b", "resolution_us")]
    broken = sessions.from_json(spark.createDataFrame([("{",), (None,)], "value string"))
    assert [[f.found for f in r.type_faults] for r in broken.collect()] == [["NONE"], ["NONE"]]


def test_manifests_come_back(spark, tmp_path):
    plain = f"file://{tmp_path}/in"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(FULL, indent=1))
    (tmp_path / "in" / "b.json").write_text(json.dumps(put(session(), ("metadata", "session_id"), "two")))
    got = sessions.load_sessions(spark, plain)
    assert {r.session_id for r in got.collect()} == {"one", "two"}
    sessions.save_sessions(got, f"file://{tmp_path}/out")
    back = sessions.from_json(spark.read.text(f"file://{tmp_path}/out"))
    assert sorted(sessions.to_json(back).collect()) == sorted(sessions.to_json(got).collect())
    assert {tuple(r) for r in sessions.reference_device(got).collect()} == {("one", "a"), ("two", "a")}
    assert [tuple(r) for r in sessions.ground_truth(got).collect()] == [("one", "b", 1.00001, 2.0)]
    d = sessions.devices_of(got).where("session_id = 'two' and device_id = 'b'").first()
    assert (d.is_reference, d.reference_candidate, d.evidence_tiers, d.max_rate_hz) == (False, False, ["shared_event"], 30.0)
    assert sessions.streams_of(got).count() == 4
    (tmp_path / "in" / "c.json").write_text(json.dumps(put(session(), ("metadata", "contract_version"), "2.0.0")))
    with pytest.raises(ValueError, match="2.0.0"):
        sessions.load_sessions(spark, plain)
    bad = documents(spark, [put(session(), ("devices", 0, "role"), "follower")])
    with pytest.raises(ValueError, match="reference"):
        sessions.save_sessions(bad, f"file://{tmp_path}/none")


def test_descriptors_by_lines(spark, tmp_path):
    """Many devices in one file, read once: the files may be gone by the time that the rows are."""
    many = [json.dumps(device(f"d{i}")["descriptor"]) for i in range(300)]
    (tmp_path / "many.txt").write_text("\n".join(many) + "\n")
    got = sessions.load_descriptors(spark, f"file://{tmp_path}/many.txt", lines=True)
    (tmp_path / "many.txt").unlink()
    assert sorted(r.device_id for r in got.collect()) == sorted(f"d{i}" for i in range(300))
    (tmp_path / "wrong.txt").write_text("\n".join([*many, json.dumps(device("cam", streams=[])["descriptor"])]))
    with pytest.raises(ValueError, match="streams"):
        sessions.load_descriptors(spark, f"file://{tmp_path}/wrong.txt", lines=True)


def test_descriptors(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(device("cam")["descriptor"]))
    r = sessions.load_descriptors(spark, f"file://{tmp_path}/d.json").first()
    assert (r.device_id, r.clock.resolution_us, r.contract_version, r.streams[0].subframe_capable) == ("cam", 1, "1.1.0", False)
    for name, wrong in (("resolution_us", device("cam", clock={"clock_id": "c", "resolution_us": "1"})), ("nominal_rate_hz", device("cam", streams=[stream("cam", nominal_rate_hz="fast")]))):
        (tmp_path / "w.json").write_text(json.dumps(wrong["descriptor"]))
        with pytest.raises(ValueError, match=name):
            sessions.load_descriptors(spark, f"file://{tmp_path}/w.json")
    (tmp_path / "e.json").write_text(json.dumps(device("cam", streams=[])["descriptor"]))
    with pytest.raises(ValueError, match="streams"):
        sessions.load_descriptors(spark, f"file://{tmp_path}/e.json")
    yaml = pytest.importorskip("yaml")

    (tmp_path / "f.yaml").write_text(yaml.safe_dump(device("cam")["descriptor"]))
    assert sessions.load_descriptors(spark, f"file://{tmp_path}/f.yaml").first().device_id == "cam"


def test_ingest(spark):
    dev = spark.createDataFrame([("1", "glove", True, ["shared_event"]), ("1", "cam", False, ["shared_event"]), ("2", "cam", False, ["wall_clock"])], "session_id string, device_id string, reference_candidate boolean, evidence_tiers array<string>")
    streams = spark.createDataFrame([("1", "glove", "t", "hold", 400.0), ("1", "cam", "v", "hold", 900.0), ("2", "cam", "v", "hold", None)], "session_id string, device_id string, stream_id string, kernel string, nominal_rate_hz double")
    samples = spark.createDataFrame([(s, d, x, i, i * 10) for s, d, x in (("1", "glove", "t"), ("1", "cam", "v"), ("1", "cam", "undeclared"), ("2", "cam", "v")) for i in range(5)], "session_id string, device_id string, stream_id string, seq long, t_device_us long")
    got = sessions.ingest(dev, streams, samples, max_samples=3)
    assert {(r.session_id, r.device_id) for r in got.devices.where("is_reference").collect()} == {("1", "glove"), ("2", "cam")}
    assert got.total_samples() == 9 and [r.seq for r in got.batch("1", "cam", "v").orderBy("seq").collect()] == [0, 1, 2]
    with pytest.raises(KeyError):
        got.batch("1", "cam", "undeclared")
    other = sessions.ingest(dev, streams, samples, spark.createDataFrame([("1", "cam")], "session_id string, device_id string"))
    assert {(r.session_id, r.device_id) for r in other.devices.where("is_reference").collect()} == {("1", "cam"), ("2", "cam")}
    with pytest.raises(ValueError, match="twice"):
        sessions.ingest(dev.unionByName(dev), streams, samples)
    with pytest.raises(ValueError, match="reference"):
        sessions.ingest(dev, streams, samples, spark.createDataFrame([("2", "glove")], "session_id string, device_id string"))
    with pytest.raises(ValueError, match="no registered device"):
        sessions.ingest(dev.where("device_id = 'cam'"), streams, samples)
    nested = sessions.to_batches(samples, 2)
    assert nested.count() == 12 and sorted(map(tuple, sessions.to_rows(nested).select(*samples.columns).collect())) == sorted(map(tuple, samples.collect()))
    assert samples.where(F.col("seq") < 0).count() == 0 and sessions.to_batches(samples.limit(0)).count() == 0


def test_sessions_as_yaml(spark):
    """The same manifests, with the contract's order of fields."""
    yaml = pytest.importorskip("yaml")
    rows = documents(spark, [FULL, put(session(), ("metadata", "session_id"), "zwei ä")])
    for (name, text), (_, plain) in zip(sorted(sessions.to_yaml(rows).collect()), sorted(sessions.to_json(rows).collect())):
        assert yaml.safe_load(text) == json.loads(plain) and list(yaml.safe_load(text))[:2] == ["metadata", "devices"] and name in text


def test_a_check_parses_once(spark):
    """What was checked is what is read and saved: documents are not made or parsed again for it."""
    made, text = spark.sparkContext.accumulator(0), json.dumps(session())

    def make(i):
        made.add(1)
        return text.replace('"one"', f'"{i}"')

    make = F.udf(make, "string")

    got = sessions.checked(sessions.from_json(spark.range(3).select(make("id").alias("value"))))
    assert sessions.devices_of(got).count() == 6 and sessions.to_json(got).count() == 3 and made.value == 3
