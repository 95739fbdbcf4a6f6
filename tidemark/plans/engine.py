"""The whole query: reconcile clocks, correct streams, build the grid, join, rate confidence, and judge.

Every step is a DataFrame over all sessions at once; ``Result`` holds them unevaluated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import confidence as conf
from ..operators import graph, metrics, timeline
from ..operators.durable import checkpointed, stored
from ..operators.transforms import correct, correct_streams

#: Rank of evidence tiers, best first.
TIERS = ("hardware_ptp", "shared_event", "wall_clock")


def select_reference(devices: DataFrame) -> DataFrame:
    """``session_id, device_id`` of each session's reference: has the best tier, is a candidate, has the highest rate; ties to the least id.

    ``devices(session_id, device_id, reference_candidate, evidence_tiers, max_rate_hz)``.
    """
    best = F.array_max(F.transform("evidence_tiers", lambda t: F.coalesce(F.nullif(F.lit(len(TIERS) + 1) - F.array_position(F.array(*map(F.lit, TIERS)), t), F.lit(len(TIERS) + 1)), F.lit(0))))
    order = Window.partitionBy("session_id").orderBy(F.array_contains("evidence_tiers", TIERS[0]).desc(), F.col("reference_candidate").desc(), F.col("max_rate_hz").desc(), best.desc(), "device_id")
    return devices.withColumn("__k", F.row_number().over(order)).where("__k = 1").select("session_id", "device_id")


def rated_devices(devices: DataFrame, streams: DataFrame) -> DataFrame:
    """``devices`` with ``max_rate_hz``: the highest nominal rate of their streams, 0 without any."""
    rates = streams.groupBy("session_id", "device_id").agg(F.max("nominal_rate_hz").alias("__rate"))
    return devices.drop("max_rate_hz").join(rates, ["session_id", "device_id"], "left").withColumn("max_rate_hz", F.coalesce("__rate", F.lit(0.0))).drop("__rate")


@dataclass
class Result:
    edges: DataFrame
    clock_models: DataFrame
    samples_ref: DataFrame
    grid: DataFrame
    alignment: DataFrame
    confidence: DataFrame
    coverage: DataFrame
    dropout: DataFrame | None
    roundtrip: DataFrame | None
    report: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if v is not None}


def synchronize(
    devices: DataFrame,
    streams: DataFrame,
    samples: DataFrame,
    observations: DataFrame,
    grid_rate_hz: float,
    rejection_tolerance_us: int,
    gates: metrics.Gates = metrics.Gates(),
    truth: DataFrame | None = None,
    expected: DataFrame | None = None,
    robust: bool = False,
    ransac_threshold_us: float = 1000.0,
    confidence_decay_tau_us: float | None = None,
    min_events: int = 2,
    bucket_us: int = timeline.BUCKET_US,
    weight: str | None = None,
    use_valid: bool = False,
    sample_confidence: str | None = None,
) -> Result:
    """All steps over all sessions.

    ``devices(session_id, device_id, is_reference)``, ``streams(session_id, device_id, stream_id,
    kernel)``, ``samples(session_id, device_id, stream_id, t_device_us)``, ``observations(session_id,
    event_id, device_id, t_local_us, tier)``, ``truth(session_id, device_id, alpha, beta_us)``,
    ``expected(session_id, device_id, stream_id, n_expected)``. ``weight`` names a column of the
    observations (an event's quality) that fits are weighted by.

    With ``use_valid``, samples whose column ``valid`` is false are passed over by the as-of join (null
    counts as valid), while indices still count the whole stream. ``sample_confidence`` names a column
    of the samples that becomes the points' source confidence, which is 1 without it.
    """
    session, device = ["session_id"], ["session_id", "device_id"]
    stream = [*device, "stream_id"]
    known = stored(observations.join(devices.select(*device), device, "left_semi"))
    edges = graph.build_edges(known, session, min_events, "ransac" if robust else "tls", ransac_threshold_us, weight)
    models = graph.reconcile(edges, devices, session).join(devices.select(*device, "is_reference"), device)
    models = checkpointed(models)
    fixed = stored(correct_streams(samples, models, device))  # read for the span, the stretches and by the caller
    grid = timeline.grid(fixed, session, grid_rate_hz)
    rated_points = use_valid or sample_confidence is not None
    own = streams.select(*stream, "kernel").where(F.col("kernel").isin(timeline.HOLD, timeline.CONTINUOUS)).join(models.select(*device, "clock_confidence"), device, "left")
    # points are many more than samples, and each reader makes them anew from these
    rows = stored(timeline.stretches(fixed, own, session, stream, grid_rate_hz, F.col("valid") if use_valid else None, sample_confidence, bucket_us))
    points = timeline.aligned(rows, stream, rejection_tolerance_us, grid_rate_hz, rated_points)
    alignment = points.drop("clock_confidence")
    seen = known.join(models.select(*device, "alpha", "beta_us"), device).select(*device, correct("t_local_us").alias("t_ref_us"))
    seen = seen.join(streams.select(*stream), device)
    rated = conf.build_confidence(points, None, stream, seen if confidence_decay_tau_us else None, confidence_decay_tau_us, bucket_us=bucket_us)
    covered = timeline.coverage(alignment, stream)
    lost = metrics.dropout(expected, samples, stream) if expected is not None else None
    residual = metrics.reconciliation_residual(known, models, session)
    report = residual.join(covered.groupBy(*session).agg(F.min("coverage").alias("coverage_min")), session, "left")
    if lost is not None:
        report = report.join(lost.groupBy(*session).agg(F.max("dropout").alias("dropout_max")), session, "left")
    else:
        report = report.withColumn("dropout_max", F.lit(None).cast("double"))
    report = report.withColumn("coverage_min", F.coalesce("coverage_min", F.lit(1.0))).withColumn("dropout_max", F.coalesce("dropout_max", F.lit(0.0)))
    report = report.join(metrics.sync_method(observations, session), session, "left").withColumn("sync_method", F.coalesce("sync_method", F.lit("none")))
    report = report.withColumn("gate_verdict", metrics.gate("sync_resid_us", "coverage_min", "dropout_max", gates)).join(metrics.property_checks(grid, alignment, session), session, "left")
    trip = metrics.roundtrip_accuracy(models, truth, samples, session) if truth is not None else None
    return Result(edges, models, fixed, grid, alignment, rated, covered, lost, trip, report)
