"""Streams: running clock fits and coverage over windows, with late rows dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fit import _line
from ..operators.transforms import clock_confidence


def online_fit(pairs: DataFrame, keys: list[str], time: str, window: str = "10 minutes", late: str = "1 minute", x: str = "t_local_us", y: str = "t_ref_us") -> DataFrame:
    """Total least squares per key and window of ``time``: only the moments are kept in state."""
    over, beta = _line("tls", F.col(x), F.col(y))
    out = pairs.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg((1 + over).alias("alpha"), beta.alias("beta_us"), F.count("*").alias("n_events"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "alpha", "beta_us", "n_events", clock_confidence(F.lit(0.0), "n_events").alias("confidence_at_most"))


def bursts(detections: DataFrame, keys: list[str], time: str, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Coarse association: detections of a session closer than the gap share a session window."""
    out = detections.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"), F.approx_count_distinct("device_id").alias("devices"))
    return out.select(F.col("session_window.start").alias("burst_start"), F.col("session_window.end").alias("burst_end"), *keys, "n", "devices")
