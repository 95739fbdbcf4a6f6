"""Session manifests as tables: one row per session, entities nested as the manifests nest them.

Manifests are JSON or YAML documents. All of a folder are read in one scan, whatever their number, and
checked by column expressions: every broken rule is a row of ``violations``. Only the count of
unsupported versions comes to the driver, before anything else is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from ..functions.scalars import contract_version_supported
from ..operators.durable import checkpointed, stored
from ..operators.ordered import ROWS
from ..operators.validate import broken, monotonic_violations, out_of_unit, sample_violations
from ..plans.engine import rated_devices, select_reference
from .typed import type_faults

#: Versions that a manifest has if it names none, and the closed vocabularies.
SCHEMA_VERSION, CONTRACT_VERSION = "0.3.0", "1.1.0"
KERNELS, ROLES, ORIGINS = ("continuous", "hold"), ("reference", "follower"), ("synthetic", "real", "mixed")
TIERS = ("hardware_ptp", "shared_event", "wall_clock")
PARAM_TIERS, VERDICTS = ("KNOWN", "ESTIMATED", "UNKNOWN"), ("certified", "release", "needs_review", "blocked")

_CLOCK = "struct<clock_id:string,timestamp_unit:string,resolution_us:bigint,nominal_epoch:string,expected_offset_us:double,expected_skew_ppm:double,expected_drift:string>"
_STREAM = "struct<stream_id:string,device_id:string,kind:string,kernel:string,payload_kind:string,units:string,nominal_rate_hz:double,payload_shape:array<bigint>,subframe_capable:boolean,quality_floor:double>"
DESCRIPTOR = f"struct<device_id:string,modality:string,producer:string,is_synthetic:boolean,clock:{_CLOCK},evidence_tiers:array<string>,streams:array<{_STREAM}>,reference_candidate:boolean,calibration_refs:array<string>,topology_ref:string,topology_hash:string,param_tiers:map<string,string>,notes:string,contract_version:string>"
_REGISTRATION = f"struct<device_id:string,role:string,descriptor:{DESCRIPTOR},descriptor_ref:string,stream_refs:map<string,string>>"
_METADATA = "struct<session_id:string,origin:string,producers:array<string>,schema_version:string,contract_version:string,created_at:string,reference_clock_policy:string,grid_rate_hz:double,rejection_tolerance_us:bigint,notes:string>"
_CALIBRATION = "struct<calibration_id:string,kind:string,uri:string,device_id:string,device_ids:array<string>,tier:string,confidence:double>"
_BUCKETS = "struct<anchor_stream:string,rule:string,R:bigint>"
_TIMELINE = f"struct<timeline_id:string,reference_clock_id:string,grid_rate_hz:double,t_start_us:bigint,t_end_us:bigint,n_grid:bigint,manifest_uri:string,aligned_table_uri:string,subframe_buckets:{_BUCKETS}>"
_MODEL = "struct<device_id:string,ref_clock_id:string,alpha:double,beta_us:double,segments:array<struct<t_lo_us:double,t_hi_us:double,alpha:double,beta_us:double>>,method:string,fit_residual_us:double,n_events:bigint,clock_confidence:double>"
_SYNC = f"struct<reference_clock_id:string,reference_selection:string,sync_resid_us:double,per_device:map<string,{_MODEL}>,sync_method:string,coverage:map<string,double>,dropout:map<string,double>>"
_VALIDATION = "struct<gate_verdict:string,property_checks:map<string,string>,roundtrip_accuracy:map<string,map<string,double>>,gate_detail:string>"
_EXPORT = "struct<format:string,uri:string,produced_at:string,frame_count:bigint,sample_count:bigint,consumer_hint:string>"
_TRUTH = "struct<clock_models:map<string,struct<alpha:double,beta_us:double>>,note:string>"
SESSION = f"struct<metadata:{_METADATA},devices:array<{_REGISTRATION}>,calibration_refs:array<{_CALIBRATION}>,timeline:{_TIMELINE},sync_report:{_SYNC},validation_report:{_VALIDATION},exports:array<{_EXPORT}>,ground_truth:{_TRUTH}>"

#: What stands where in a manifest, and what names it; fields that take any value; fields whose default a null does not stand for.
_ENTITIES = {
    "devices": ("registration", "device_id"),
    "devices.descriptor": ("device", "device_id"),
    "devices.descriptor.streams": ("stream", "stream_id"),
    "calibration_refs": ("calibration", "calibration_id"),
    "timeline": ("timeline", "timeline_id"),
    "sync_report": ("sync_report", "reference_clock_id"),
    "sync_report.per_device": ("clock_model", "device_id"),
    "validation_report": ("validation_report", "gate_verdict"),
    "exports": ("export", "uri"),
}
_OPAQUE = {"expected_drift", "param_tiers"}
_NEVER_NULL = {"timestamp_unit", "resolution_us", "subframe_capable", "reference_candidate", "producers", "schema_version", "contract_version", "reference_clock_policy"}


def _or(c, name: str, value) -> Column:
    return F.coalesce(c[name], value if isinstance(value, Column) else F.lit(value))


def _descriptor(d: Column) -> Column:
    """A descriptor with its defaults filled in."""
    clock = d["clock"].withField("timestamp_unit", _or(d["clock"], "timestamp_unit", "microseconds")).withField("resolution_us", _or(d["clock"], "resolution_us", F.lit(1).cast("bigint")))
    full = d.withField("clock", F.when(d["clock"].isNotNull(), clock))
    full = full.withField("streams", F.transform(d["streams"], lambda s: s.withField("subframe_capable", _or(s, "subframe_capable", False))))
    full = full.withField("reference_candidate", _or(d, "reference_candidate", False)).withField("contract_version", _or(d, "contract_version", CONTRACT_VERSION))
    return F.when(d.isNotNull(), full.withField("calibration_refs", _or(d, "calibration_refs", F.array().cast("array<string>"))))


def from_json(documents: DataFrame, value: str = "value") -> DataFrame:
    """One row per manifest: the columns of ``SESSION``, defaults filled in, ``session_id`` and ``type_faults``.

    A document that is no mapping or has no metadata gives a row of nulls, which ``violations`` reports.
    A value of a type that is not the contract's becomes null or a default, and stands in ``type_faults``,
    which ``violations`` reports too.
    """
    s = F.from_json(F.col(value), SESSION)
    faults = type_faults(f"`{value}`", StructType.fromDDL(SESSION), "session", f"get_json_object(`{value}`, '$.metadata.session_id')", _ENTITIES, _OPAQUE, _NEVER_NULL)
    rows = documents.select(s.alias("s"), faults.alias("type_faults")).select("s.*", "type_faults")
    meta = F.col("metadata")
    for name, default in (("schema_version", SCHEMA_VERSION), ("contract_version", CONTRACT_VERSION), ("reference_clock_policy", "designated_anchor")):
        meta = meta.withField(name, _or(F.col("metadata"), name, default))
    meta = meta.withField("producers", _or(F.col("metadata"), "producers", F.array().cast("array<string>")))
    rows = rows.withColumn("devices", F.transform(F.coalesce("devices", F.array().cast(f"array<{_REGISTRATION}>")), lambda r: r.withField("descriptor", _descriptor(r["descriptor"]))))
    rows = rows.withColumn("metadata", F.when(F.col("metadata").isNotNull(), meta))
    for name, kind in (("calibration_refs", _CALIBRATION), ("exports", _EXPORT)):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    return rows.withColumn("session_id", F.col("metadata.session_id"))


def to_json(sessions: DataFrame) -> DataFrame:
    """``session_id, value``: manifests as JSON documents; what is null is left out."""
    names = [c for c in sessions.columns if c not in ("session_id", "type_faults")]
    return sessions.select("session_id", F.to_json(F.struct(*names)).alias("value"))


def to_yaml(sessions: DataFrame) -> DataFrame:
    """``session_id, value``: manifests as YAML documents, made where the rows are; the order of fields is the contract's. Needs ``pyyaml``."""

    def convert(batches):
        import json

        import yaml

        for b in batches:
            b["value"] = [yaml.safe_dump(json.loads(v), sort_keys=False, allow_unicode=True) for v in b["value"]]
            yield b

    rows = to_json(sessions)
    return rows.mapInPandas(convert, rows.schema)


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the documents of a file or folder as JSON; YAML is turned into JSON where it is read."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))

    def convert(batches):
        import json

        import yaml

        for b in batches:
            b["value"] = [json.dumps(yaml.safe_load(v), default=str) for v in b["value"]]
            yield b[["value"]]

    plain = rows.where(~F.col("path").rlike(r"(?i)\.ya?ml$")).select("value")
    return plain.unionByName(rows.where(F.col("path").rlike(r"(?i)\.ya?ml$")).mapInPandas(convert, "value string"))


def load_sessions(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Manifests of a file or folder (.json, .yaml). Versions are looked at first: one that is not supported refuses the load."""
    documents = _documents(spark, path)
    version = F.get_json_object("value", "$.metadata.contract_version")
    refused = documents.where(version.isNotNull() & ~contract_version_supported(version)).select(version.alias("v")).first()
    if refused:
        raise ValueError(f"{path} declares contract version {refused['v']!r}, which is not supported")
    sessions = from_json(documents)
    return checked(sessions) if check else sessions


def save_sessions(sessions: DataFrame, path: str, check: bool = True) -> None:
    """One JSON document per session under ``path``."""
    (to_json(checked(sessions)) if check else to_json(sessions)).select("value").write.mode("overwrite").text(path)


def checked(sessions: DataFrame) -> DataFrame:
    """The sessions, if none breaks a rule, as they were parsed for the check: what reads them reads the columns it needs."""
    sessions = stored(sessions)
    wrong = _violations(sessions).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.session_id} {r.entity} {r.entity_id}: {r.reason}" for r in wrong))
    return sessions


def load_descriptors(spark: SparkSession, path: str, check: bool = True, lines: bool = False) -> DataFrame:
    """Device descriptors of a file or folder: one row per device, the columns of ``DESCRIPTOR``.

    A file is one document, or with ``lines`` holds a JSON document a line: a fleet of many devices then
    needs few files. With ``check`` the files are read once, whatever is checked.
    """
    documents = spark.read.text(path).where("trim(value) <> ''") if lines else _documents(spark, path)
    if check:
        documents = checkpointed(documents)
    rows = documents.select(_descriptor(F.from_json("value", DESCRIPTOR)).alias("d")).select("d.*")
    if check:
        nobody = F.lit(None).cast("string").alias("session_id")
        wrong = descriptor_violations(rows.select(nobody, F.struct("*").alias("d")))
        faults = type_faults("value", StructType.fromDDL(DESCRIPTOR), "device", "get_json_object(value, '$.device_id')", {"streams": _ENTITIES["devices.descriptor.streams"]}, _OPAQUE, _NEVER_NULL)
        wrong = wrong.unionByName(_wrong_types(documents.select(nobody, faults.alias("type_faults")))).limit(5).collect()
        if wrong:
            raise ValueError("; ".join(f"{r.entity} {r.entity_id}: {r.reason}" for r in wrong))
    return rows


def registrations(sessions: DataFrame) -> DataFrame:
    """``session_id`` and the fields of each device registration."""
    return sessions.select("session_id", F.explode("devices").alias("r")).select("session_id", "r.*")


def devices_of(sessions: DataFrame) -> DataFrame:
    """``session_id, device_id, is_reference, reference_candidate, evidence_tiers, max_rate_hz``: what the engine reads."""
    rate = F.coalesce(F.array_max(F.transform("descriptor.streams", lambda s: s["nominal_rate_hz"])), F.lit(0.0))
    return registrations(sessions).select("session_id", "device_id", (F.col("role") == "reference").alias("is_reference"), F.coalesce("descriptor.reference_candidate", F.lit(False)).alias("reference_candidate"), F.coalesce("descriptor.evidence_tiers", F.array().cast("array<string>")).alias("evidence_tiers"), rate.alias("max_rate_hz"))


def streams_of(sessions: DataFrame) -> DataFrame:
    """``session_id`` and the fields of each stream descriptor."""
    return registrations(sessions).select("session_id", F.explode("descriptor.streams").alias("s")).select("session_id", "s.*")


def reference_device(sessions: DataFrame) -> DataFrame:
    """``session_id, device_id`` of each session's reference."""
    return registrations(sessions).where("role = 'reference'").select("session_id", "device_id")


def ground_truth(sessions: DataFrame) -> DataFrame:
    """``session_id, device_id, alpha, beta_us`` of sessions that carry it; for checks, never for estimation."""
    return sessions.select("session_id", F.explode("ground_truth.clock_models").alias("device_id", "m")).select("session_id", "device_id", "m.alpha", "m.beta_us")


def _blank(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def _if(c, bad: Column) -> Column:
    """Broken only where there is a value."""
    return F.col(c).isNotNull() & bad


def _none_of(c: str, allowed) -> Column:
    return ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))


def _found(rows: DataFrame, entity: str, entity_id, rules: dict) -> DataFrame:
    return broken(rows, rules).select("session_id", F.lit(entity).alias("entity"), F.col(entity_id).cast("string").alias("entity_id"), "reason")


def _wrong_types(rows: DataFrame) -> DataFrame:
    """Type faults as violations: the field is the reason."""
    return rows.select("session_id", F.explode("type_faults").alias("f")).select("session_id", "f.entity", "f.entity_id", F.col("f.field").alias("reason"))


def descriptor_violations(rows: DataFrame) -> DataFrame:
    """``session_id, entity, entity_id, reason`` of ``rows(session_id, d)``: device, clock and stream rules."""
    device = rows.select("session_id", "d.*")
    found = _found(
        device,
        "device",
        "device_id",
        {
            "device_id": _blank("device_id"),
            "modality": _blank("modality"),
            "producer": _blank("producer"),
            "is_synthetic": F.col("is_synthetic").isNull(),
            "contract_version": ~contract_version_supported("contract_version"),
            "clock": F.col("clock").isNull(),
            "clock_id": _if("clock", _blank("clock.clock_id")),
            "timestamp_unit": _if("clock", F.col("clock.timestamp_unit") != "microseconds"),
            "resolution_us": _if("clock", F.col("clock.resolution_us") <= 0),
            "evidence_tiers": F.coalesce(F.size("evidence_tiers") < 1, F.lit(True)) | F.coalesce(F.exists("evidence_tiers", lambda t: ~t.isin(*TIERS)), F.lit(False)),
            "streams": F.coalesce(F.size("streams") < 1, F.lit(True)),
            "stream ids": F.coalesce(F.size(F.array_distinct(F.transform("streams", lambda s: s["stream_id"]))) < F.size("streams"), F.lit(False)),
            "topology_ref": _if("topology_ref", F.col("topology_ref") == ""),
            "topology_hash": _if("topology_hash", F.col("topology_hash") == ""),
        },
    )
    stream = device.select("session_id", F.col("device_id").alias("owner"), F.explode("streams").alias("s")).select("session_id", "owner", "s.*")
    return found.unionByName(
        _found(
            stream,
            "stream",
            "stream_id",
            {
                "stream_id": _blank("stream_id"),
                "device_id": ~F.coalesce(F.col("device_id") == F.col("owner"), F.lit(False)),
                "kind": _blank("kind"),
                "kernel": _none_of("kernel", KERNELS),
                "payload_kind": _blank("payload_kind"),
                "units": _blank("units"),
                "nominal_rate_hz": _if("nominal_rate_hz", F.col("nominal_rate_hz") <= 0),
                "payload_shape": F.coalesce(F.exists("payload_shape", lambda v: v <= 0), F.lit(False)),
                "quality_floor": out_of_unit("quality_floor"),
            },
        )
    )


def violations(sessions: DataFrame) -> DataFrame:
    """``session_id, entity, entity_id, reason``: every rule that a session or a part of it breaks, once, and every value of a wrong type."""
    return _violations(stored(sessions))  # parsed once, and read by each kind of entity


def _violations(sessions: DataFrame) -> DataFrame:
    regs = registrations(sessions)
    ids = F.transform("devices", lambda r: r["device_id"])
    found = _found(
        sessions,
        "session",
        "session_id",
        {
            "session_id": _blank("session_id"),
            "origin": _none_of("metadata.origin", ORIGINS),
            "producers": F.coalesce((F.size("metadata.producers") < 1) | F.exists("metadata.producers", lambda p: p.isNull() | (p == "")), F.lit(True)),
            "schema_version": _blank("metadata.schema_version"),
            "contract_version": ~contract_version_supported("metadata.contract_version"),
            "reference_clock_policy": _blank("metadata.reference_clock_policy"),
            "grid_rate_hz": _if("metadata.grid_rate_hz", F.col("metadata.grid_rate_hz") <= 0),
            "rejection_tolerance_us": _if("metadata.rejection_tolerance_us", F.col("metadata.rejection_tolerance_us") < 0),
            "devices": F.coalesce(F.size("devices") < 1, F.lit(True)),
            "device ids": F.coalesce(F.size(F.array_distinct(ids)) < F.size(ids), F.lit(False)),
            "reference": F.coalesce(F.size(F.filter("devices", lambda r: r["role"] == "reference")) != 1, F.lit(True)),
            "ground_truth": _if("ground_truth", ~F.col("metadata.origin").isin("synthetic", "mixed")),
            "clock_models": _if("ground_truth.clock_models", F.exists(F.map_values("ground_truth.clock_models"), lambda m: m["alpha"].isNull() | m["beta_us"].isNull())),
            "reference clocks": _if("sync_report", F.col("timeline").isNotNull() & ~F.col("sync_report.reference_clock_id").eqNullSafe(F.col("timeline.reference_clock_id"))),
        },
    )
    known = F.transform("descriptor.streams", lambda s: s["stream_id"])
    found = found.unionByName(
        _found(
            regs,
            "registration",
            "device_id",
            {
                "device_id": _blank("device_id"),
                "role": _none_of("role", ROLES),
                "descriptor": F.col("descriptor").isNull() & F.col("descriptor_ref").isNull(),
                "descriptor_ref": _if("descriptor_ref", F.col("descriptor_ref") == ""),
                "descriptor.device_id": _if("descriptor", ~F.col("descriptor.device_id").eqNullSafe(F.col("device_id"))),
                "stream_refs": F.coalesce(F.size(F.array_except(F.map_keys("stream_refs"), known)) > 0, F.lit(False)),
            },
        )
    )
    found = found.unionByName(descriptor_violations(regs.where("descriptor is not null").select("session_id", F.col("descriptor").alias("d"))))
    part = lambda c: sessions.select("session_id", F.explode(c).alias("x")).select("session_id", "x.*")
    one = lambda c: sessions.where(F.col(c).isNotNull()).select("session_id", f"{c}.*")
    found = found.unionByName(
        _found(
            part("calibration_refs"),
            "calibration",
            "calibration_id",
            {
                "calibration_id": _blank("calibration_id"),
                "kind": _blank("kind"),
                "uri": _blank("uri"),
                "device_ids": F.coalesce(F.exists("device_ids", lambda d: d.isNull() | (d == "")), F.lit(False)),
                "tier": _if("tier", _none_of("tier", PARAM_TIERS)),
                "confidence": out_of_unit("confidence"),
            },
        )
    )
    found = found.unionByName(_found(part("exports"), "export", "uri", {"format": _blank("format"), "uri": _blank("uri"), "frame_count": _if("frame_count", F.col("frame_count") < 0), "sample_count": _if("sample_count", F.col("sample_count") < 0)}))
    found = found.unionByName(
        _found(
            one("timeline"),
            "timeline",
            "timeline_id",
            {
                "timeline_id": _blank("timeline_id"),
                "reference_clock_id": _blank("reference_clock_id"),
                "grid_rate_hz": F.col("grid_rate_hz").isNull() | (F.col("grid_rate_hz") <= 0),
                "t_start_us": _if("t_start_us", F.col("t_start_us") < 0),
                "t_end_us": _if("t_end_us", (F.col("t_end_us") < 0) | F.coalesce(F.col("t_end_us") < F.col("t_start_us"), F.lit(False))),
                "n_grid": _if("n_grid", F.col("n_grid") < 0),
                "anchor_stream": _if("subframe_buckets", _blank("subframe_buckets.anchor_stream")),
                "rule": _if("subframe_buckets", _blank("subframe_buckets.rule")),
                "R": _if("subframe_buckets.R", F.col("subframe_buckets.R") <= 0),
            },
        )
    )
    unit = lambda c: F.coalesce(F.exists(F.map_values(c), lambda v: v.isNull() | ~v.between(0, 1)), F.lit(False))
    found = found.unionByName(
        _found(
            one("sync_report"),
            "sync_report",
            "reference_clock_id",
            {
                "reference_clock_id": _blank("reference_clock_id"),
                "reference_selection": _blank("reference_selection"),
                "sync_resid_us": F.col("sync_resid_us").isNull() | (F.col("sync_resid_us") < 0),
                "coverage": unit("coverage"),
                "dropout": unit("dropout"),
            },
        )
    )
    models = sessions.where("sync_report is not null").select("session_id", F.explode("sync_report.per_device").alias("key", "m")).select("session_id", "m.*")
    found = found.unionByName(
        _found(
            models,
            "clock_model",
            "device_id",
            {
                "device_id": _blank("device_id"),
                "ref_clock_id": _blank("ref_clock_id"),
                "alpha": F.coalesce("alpha", F.lit(1.0)) <= 0,
                "method": _if("method", _none_of("method", TIERS)),
                "fit_residual_us": _if("fit_residual_us", F.col("fit_residual_us") < 0),
                "n_events": _if("n_events", F.col("n_events") < 0),
                "clock_confidence": out_of_unit("clock_confidence"),
            },
        )
    )
    rules = {"gate_verdict": _none_of("gate_verdict", VERDICTS), "property_checks": F.coalesce(F.exists(F.map_values("property_checks"), lambda v: v.isNull() | ~v.isin("pass", "fail")), F.lit(False))}
    found = found.unionByName(_found(one("validation_report"), "validation_report", "gate_verdict", rules))
    if "type_faults" in sessions.columns:  # sessions that were read from documents
        found = found.unionByName(_wrong_types(sessions))
    return found.distinct()


@dataclass
class Ingested:
    """Sessions with their reference chosen, and one table of all their samples."""

    devices: DataFrame
    streams: DataFrame
    samples: DataFrame
    truth: DataFrame | None = None

    def batch(self, session_id, device_id: str, stream_id: str) -> DataFrame:
        """The samples of one declared stream; a stream that is not declared is an error."""
        here = (F.col("session_id") == session_id) & (F.col("device_id") == device_id) & (F.col("stream_id") == stream_id)
        if self.streams.where(here).isEmpty():
            raise KeyError((session_id, device_id, stream_id))
        return self.samples.where(here)

    def total_samples(self) -> int:
        return self.samples.count()


def ingest(devices: DataFrame, streams: DataFrame, samples: DataFrame, reference: DataFrame | None = None, max_samples: int | None = None, truth: DataFrame | None = None) -> Ingested:
    """Register devices, choose each session's reference, and read the declared streams.

    ``devices(session_id, device_id, reference_candidate, evidence_tiers)``, ``streams(session_id,
    device_id, stream_id, kernel, nominal_rate_hz)``, ``samples(session_id, device_id, stream_id, seq,
    t_device_us)``. ``reference(session_id, device_id)`` overrides the choice. Device ids are unique in
    a session, an override names a device of the session, and a stream has at least one device;
    otherwise a ``ValueError`` says what is wrong. ``max_samples`` bounds each stream's first samples.
    """
    from .readers import limit_per_stream

    keys = ["session_id", "device_id"]
    twice = devices.groupBy(*keys).count().where("count > 1").first()
    if twice:
        raise ValueError(f"device {twice['device_id']!r} is registered twice in session {twice['session_id']!r}")
    lost = streams.join(devices, keys, "left_anti").first()
    if lost:
        raise ValueError(f"stream {lost['stream_id']!r} belongs to no registered device")
    chosen = select_reference(rated_devices(devices, streams))
    if reference is not None:
        wrong = reference.join(devices, keys, "left_anti").first()
        if wrong:
            raise ValueError(f"reference {wrong['device_id']!r} is not a device of session {wrong['session_id']!r}")
        chosen = chosen.join(reference, "session_id", "left_anti").unionByName(reference.select(*keys))
    named = rated_devices(devices, streams).join(chosen.withColumn("is_reference", F.lit(True)), keys, "left").withColumn("is_reference", F.coalesce("is_reference", F.lit(False)))
    declared = samples.join(streams.select(*keys, "stream_id"), [*keys, "stream_id"], "left_semi")
    if max_samples is not None:
        declared = limit_per_stream(declared, [*keys, "stream_id"], max_samples)
    return Ingested(named, streams, declared, truth)


def batch_violations(samples: DataFrame, width: float = ROWS) -> DataFrame:
    """The rows of batches that break a rule, with a ``reason``, in one check of the whole batch.

    ``samples(session_id, device_id, stream_id, seq, t_device_us, payload_ref, payload_inline,
    confidence, ...)`` in the order of ``pos``: each sample's own rules, a stream's order (``order``),
    and samples that name no stream (``stream``).
    """
    keys = ["session_id", "device_id", "stream_id"]
    named = samples.where(F.col("device_id").isNotNull() & F.col("stream_id").isNotNull())
    nameless = samples.where(F.col("device_id").isNull() | F.col("stream_id").isNull()).withColumn("reason", F.lit("stream"))
    late = monotonic_violations(named, keys, "pos", width=width).withColumn("reason", F.lit("order"))
    return sample_violations(samples).unionByName(late).unionByName(nameless)


def to_rows(batches: DataFrame) -> DataFrame:
    """``session_id, device_id, stream_id, seq, t_device_us, ...`` from one row per stream that nests its samples as arrays of structs."""
    return batches.select("session_id", "device_id", "stream_id", F.explode("samples").alias("s")).select("session_id", "device_id", "stream_id", "s.*")


def to_batches(samples: DataFrame, slot_rows: int = 65_536) -> DataFrame:
    """The inverse: one row per stream and slot of at most ``slot_rows`` sequence numbers, with samples in order."""
    keys = ["session_id", "device_id", "stream_id"]
    rest = [c for c in samples.columns if c not in keys]
    slot = F.floor(F.col("seq") / slot_rows).cast("long")
    return samples.groupBy(*keys, slot.alias("slot")).agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in rest if c != "seq"]))).alias("samples"))
