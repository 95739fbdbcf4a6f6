"""Contract checks: each returns the rows that break a rule, with a ``reason``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ROWS, previous


def broken(df: DataFrame, rules: dict) -> DataFrame:
    """The rows that break a rule, once for each, with its name as ``reason``; a rule that is null counts as broken."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules.items()]))
    return df.withColumn("reason", F.explode(reasons))


def out_of_unit(c: str):
    return F.col(c).isNotNull() & ~F.col(c).between(0, 1)


def sample_violations(samples: DataFrame) -> DataFrame:
    """Payload by reference or inline but not both, times and sequence not negative, confidence in [0, 1]."""
    return broken(
        samples,
        {
            "payload": F.col("payload_ref").isNull() == F.col("payload_inline").isNull(),
            "t_device_us": F.col("t_device_us").isNull() | (F.col("t_device_us") < 0),
            "seq": F.coalesce(F.col("seq") < 0, F.lit(False)),
            "confidence": out_of_unit("confidence"),
        },
    )


def monotonic_violations(samples: DataFrame, keys: list[str], order: str, t: str = "t_device_us", seq: str | None = "seq", width: float = ROWS) -> DataFrame:
    """Samples earlier than the one before, or at its time without a rising sequence number."""
    rows = previous(samples, keys, order, {"__t": t} | ({"__q": seq} if seq else {}), width)
    tie = F.col(t) == F.col("__t")
    if seq:
        tie = tie & ~F.coalesce(F.col(seq) > F.col("__q"), F.lit(False))
    return rows.where((F.col(t) < F.col("__t")) | tie).select(*samples.columns)


def event_violations(events: DataFrame) -> DataFrame:
    """A sync event needs an observation, times that are not negative and a quality in [0, 1]."""
    times = F.map_values("observations")
    return broken(events, {"observations": F.size("observations") < 1, "t_local_us": F.exists(times, lambda v: v < 0), "quality": out_of_unit("quality")})


def model_violations(models: DataFrame) -> DataFrame:
    """A clock model needs a positive alpha, a residual that is not negative and a confidence in [0, 1]."""
    return broken(models, {"alpha": F.col("alpha") <= 0, "fit_residual_us": F.coalesce(F.col("fit_residual_us") < 0, F.lit(False)), "clock_confidence": out_of_unit("clock_confidence")})


def device_violations(devices: DataFrame) -> DataFrame:
    """A device needs a microsecond clock of positive resolution, an evidence tier, and a unique id in its session."""
    n = F.count("*").over(Window.partitionBy("session_id", "device_id"))
    checked = devices.withColumn("__n", n)
    return broken(
        checked,
        {
            "device_id": F.col("__n") > 1,
            "timestamp_unit": F.col("clock.timestamp_unit") != "microseconds",
            "resolution_us": F.col("clock.resolution_us") <= 0,
            "evidence_tiers": F.size("evidence_tiers") < 1,
        },
    ).drop("__n")


def stream_violations(streams: DataFrame, devices: DataFrame) -> DataFrame:
    """A stream needs a known device and kernel, a unique id, a positive rate and a positive shape."""
    n = F.count("*").over(Window.partitionBy("session_id", "device_id", "stream_id"))
    known = devices.select("session_id", "device_id", F.lit(True).alias("__known")).distinct()
    checked = streams.withColumn("__n", n).join(known, ["session_id", "device_id"], "left")
    return broken(
        checked,
        {
            "stream_id": F.col("__n") > 1,
            "device_id": F.col("__known").isNull(),
            "kernel": ~F.col("kernel").isin("hold", "continuous"),
            "nominal_rate_hz": F.col("nominal_rate_hz") <= 0,
            "payload_shape": F.coalesce(F.exists("payload_shape", lambda v: v <= 0), F.lit(False)),
        },
    ).drop("__n", "__known")


def session_violations(devices: DataFrame) -> DataFrame:
    """``session_id, reason``: sessions without exactly one reference device."""
    per = devices.groupBy("session_id").agg(F.sum(F.coalesce("is_reference", F.lit(False)).cast("int")).alias("n"))
    return per.where("n <> 1").select("session_id", F.lit("reference").alias("reason"))
