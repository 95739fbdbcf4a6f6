"""Clock maps and forward models as column expressions and small relational operators.

The relation is ``t_ref = alpha * t_local + beta_us``; times are integer microseconds. Rounding is
half to even (``rint``), and results are cast to long, so that no negative zero remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ROWS, before, carried, cut, inside

SEGMENTS = "array<struct<t_lo_us: double, t_hi_us: double, alpha: double, beta_us: double>>"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_long(c) -> Column:
    """Half-even rounding to a long."""
    return F.rint(col(c)).cast("long")


def ref_from_local(t, alpha="alpha", beta="beta_us") -> Column:
    return col(alpha) * col(t) + col(beta)


def local_from_ref(t, alpha="alpha", beta="beta_us") -> Column:
    return (col(t) - col(beta)) / col(alpha)


def correct(t, alpha="alpha", beta="beta_us") -> Column:
    """Reference time of a sample: the whole-session model, segments are not consulted."""
    return to_long(ref_from_local(t, alpha, beta))


def to_reference(t, alpha="alpha", beta="beta_us", segments="segments") -> Column:
    """Reference time by the first segment with ``t_lo <= t < t_hi``, else the last one; without segments the affine map."""
    s = col(segments)
    inside = F.filter(s, lambda x: (col(t) >= x["t_lo_us"]) & (col(t) < x["t_hi_us"]))
    pick = F.when(F.size(inside) > 0, F.element_at(inside, 1)).otherwise(F.element_at(s, -1))
    return F.when(s.isNull() | (F.size(s) == 0), correct(t, alpha, beta)).otherwise(to_long(pick["alpha"] * col(t) + pick["beta_us"]))


def offset_skew(offset_us, skew_ppm) -> tuple[Column, Column]:
    """(alpha, beta_us) of a clock with a constant offset and skew."""
    return 1 + col(skew_ppm) * 1e-6, col(offset_us) + F.lit(0.0)


def compose(alpha_out, beta_out, alpha_in, beta_in) -> tuple[Column, Column]:
    """The map ``out(in(t))``."""
    return col(alpha_out) * col(alpha_in), col(alpha_out) * col(beta_in) + col(beta_out)


def invert(alpha, beta) -> tuple[Column, Column]:
    return 1 / col(alpha), -col(beta) / col(alpha)


def quantize(t, resolution_us: int) -> Column:
    if resolution_us < 1:
        raise ValueError("resolution_us must be >= 1")
    return to_long(F.rint(col(t) / resolution_us) * resolution_us)


def clock_confidence(residual_us, n_events) -> Column:
    """``(1 - 1 / (n + 1)) exp(-residual / 1000)``, clipped to [0, 1]; no events: 0."""
    r, n = F.greatest(col(residual_us), F.lit(0.0)), col(n_events)
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - 1 / (n + 1.0)) * F.exp(-r / 1000))))


def stream_key(device="device_id", stream="stream_id") -> Column:
    return F.concat_ws("::", col(device), col(stream))


def correct_streams(samples: DataFrame, models: DataFrame, keys: list[str], t: str = "t_device_us") -> DataFrame:
    """``samples`` with ``t_ref_us``. Models are one row per device; the join is left to Spark, which
    broadcasts them while they are small and splits a crowded device otherwise."""
    return samples.join(models.select(*keys, "alpha", "beta_us"), keys).withColumn("t_ref_us", correct(t)).drop("alpha", "beta_us")


def enforce_monotonic(df: DataFrame, keys: list[str], order: str, t: str, width: float = ROWS) -> DataFrame:
    """``t_mono``: rounded times made non-decreasing, ties pushed up by their index, shifted if the first is negative.

    A running maximum over the sequence; positions that did not rise get their index added, and the
    maximum runs once more. Maxima and counts are carried from bucket to bucket.
    """
    w = inside(keys, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = cut(df.withColumn("__t", to_long(t)), order, width)
    rows = carried(rows, keys, {"__n": F.count("*"), "__top": F.max("__t")}, {"__base": F.coalesce(F.sum("__n").over(before(keys)), F.lit(0)), "__before": F.max("__top").over(before(keys))})
    rows = rows.withColumn("__m", F.greatest(F.max("__t").over(run), "__before")).withColumn("__i", F.col("__base") + F.row_number().over(w) - 1)
    rows = rows.withColumn("__d", F.col("__m") <= F.coalesce(F.lag("__m").over(w), "__before")).drop("__n", "__top", "__base", "__before")
    rows = rows.withColumn("__m", F.when(F.col("__d"), F.col("__m") + F.col("__i")).otherwise(F.col("__m")))
    whole = Window.partitionBy(*keys)
    rows = carried(rows, keys, {"__top": F.max("__m"), "__head": F.min_by("__m", order)}, {"__before": F.max("__top").over(before(keys)), "__first": F.min_by("__head", "__b").over(whole)})
    m = F.greatest(F.max("__m").over(run), "__before")
    return rows.withColumn("t_mono", F.when(F.col("__first") < 0, m - F.col("__first")).otherwise(m).cast("long")).select(*df.columns, "t_mono")
