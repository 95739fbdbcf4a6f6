"""Three confidences per grid point, kept apart: source, clock and interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import BUCKET_US, neighbours


def nearest_event_us(points: DataFrame, events: DataFrame, keys: list[str], extra: list[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """``points`` with ``distance_us`` to the nearest of ``events(keys, t_ref_us)`` on either side; null without events."""
    near = neighbours(points, events, keys, extra, bucket_us=bucket_us)
    return near.select(*keys, "t_us", *extra, F.least(F.col("t_us") - F.col("prev_t"), F.col("next_t") - F.col("t_us")).alias("distance_us"))


def build_confidence(alignment: DataFrame, models: DataFrame | None, keys: list[str], events: DataFrame | None = None, decay_tau_us: float | None = None, source: DataFrame | None = None, bucket_us: int = BUCKET_US) -> DataFrame:
    """``alignment`` with ``source, clock, interpolation, derived``; all 0 where it is not valid.

    ``models(keys, clock_confidence)`` gives the clock's confidence, or with None the alignment's own
    column of that name, which then goes; with ``events`` and a tau other
    than 0 it decays by exp(-distance / tau) from the nearest event. ``source(keys, source_index,
    confidence)`` gives a sample's own confidence, else it is 1; a point without a previous sample
    has 0 then; an alignment that brings ``source_confidence`` along needs no such table. ``derived`` is
    the product, for export.
    """
    if models is None:
        out = alignment.withColumnRenamed("clock_confidence", "__clock")
        alignment = alignment.drop("clock_confidence")
    else:
        out = alignment.join(models.select(*keys, F.coalesce("clock_confidence", F.lit(0.0)).alias("__clock")), keys, "left")
    decay = F.lit(1.0)
    if events is not None and decay_tau_us:
        names = [c for c in out.columns if c not in (*keys, "t_us")]
        out = nearest_event_us(out, events, keys, names, bucket_us)
        decay = F.coalesce(F.exp(-F.col("distance_us") / float(decay_tau_us)), F.lit(1.0))
    own = F.lit(1.0)
    if source is not None:
        out = out.join(source.select(*keys, "source_index", F.col("confidence").alias("__own")), [*keys, "source_index"], "left")
        own = F.coalesce("__own", F.lit(0.0))
    elif "source_confidence" in alignment.columns:
        own = F.col("source_confidence")
    zero = lambda c: F.when(F.col("valid"), c).otherwise(0.0)
    out = out.withColumn("source", zero(own)).withColumn("clock", zero(F.coalesce("__clock", F.lit(0.0)) * decay)).withColumn("interpolation", zero(F.col("interp_confidence")))
    out = out.withColumn("derived", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("source") * F.col("clock") * F.col("interpolation"))))
    return out.select(*alignment.columns, "source", "clock", "interpolation", "derived")
