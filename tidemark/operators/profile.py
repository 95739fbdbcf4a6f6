"""Gaps and jitter of streams as mergeable sketches, rolled up without reading the samples again."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed
from .ordered import TIME_US, before, inside, previous

#: Size of a sketch: about 800 values, for a rank error of a third of a percent.
K = 800


def rank_error(k: int = K) -> float:
    """How far, as a share of all values, the rank of a quantile may lie from the one asked for (with 99 percent confidence)."""
    return 2.296 / k**0.9723


def gaps(samples: DataFrame, keys: list[str], t: str = "t_device_us", width: float = TIME_US) -> DataFrame:
    """``keys, gap``: the time from a sample to the next one of its stream; a row per sample, null for the first."""
    rows = previous(samples.where(F.col(t).isNotNull()).select(*keys, F.col(t).cast("long").alias("t")), keys, "t", {"__p": "t"}, width)
    return rows.select(*keys, (F.col("t") - F.col("__p")).alias("gap"))


def gap_profile(samples: DataFrame, keys: list[str], t: str = "t_device_us", k: int = K, width: float = TIME_US) -> DataFrame:
    """``keys, samples, gaps, gap_min, gap_max, gap_sum, gap_squares, sketch``: one row per stream.

    A gap is the time from a sample to the next one of its stream. The samples are read for their
    order by buckets, and each task then folds its gaps into a sketch of bounded size per stream.
    Samples without a time have no gaps and are not counted; a stream of one sample has no gap, and a
    null sketch. Nothing depends on how rows are dealt out as long as a sketch holds all gaps (up to
    ``k`` of them); beyond that quantiles vary within ``rank_error(k)``.
    """
    rows, gap = gaps(samples, keys, t, width), F.col("gap")
    sums = [F.count("*").alias("samples"), F.count(gap).alias("gaps"), F.min(gap).alias("gap_min"), F.max(gap).alias("gap_max"), F.sum(gap).alias("gap_sum"), F.sum(gap.cast("double") * gap).alias("gap_squares")]
    return rows.groupBy(*keys).agg(*sums, F.when(F.count(gap) > 0, F.kll_sketch_agg_bigint(gap, k)).alias("sketch"))


def roll_up(profile: DataFrame, keys: list[str]) -> DataFrame:
    """The same columns for coarser ``keys`` (a device, a session), by merging what finer ones have."""
    total = [F.sum(c).alias(c) for c in ("samples", "gaps")]
    ends = [F.min("gap_min").alias("gap_min"), F.max("gap_max").alias("gap_max"), F.sum("gap_sum").alias("gap_sum"), F.sum("gap_squares").alias("gap_squares")]
    return profile.groupBy(*keys).agg(*total, *ends, F.when(F.sum("gaps") > 0, F.kll_merge_agg_bigint("sketch")).alias("sketch"))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str = "gap", ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``keys, gap_p50`` and so on: the least value whose share of values at or below it reaches the rank, whatever their number.

    ``value`` is a whole number of at least 0; nulls take no part, and a group without values has no
    row. Values are counted in cells of at most a thousandth of their size; only the cells that hold
    a place asked for are then sorted. The rows are read twice.
    """
    bits = f"length(bin(`{value}`))"
    cell = F.expr(f"{bits} * 4096L + shiftright(`{value}`, greatest({bits} - 11, 0))")
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias(value)).withColumn("__b", cell)
    counts = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before(keys)), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    place = lambda r: F.greatest(F.lit(1), F.ceil(F.col("__all") * F.lit(Decimal(str(r)))).cast("long")) - F.col("__base")
    asked = [F.when(place(r).between(1, F.col("__n")), place(r)).alias(f"__k{i}") for i, r in enumerate(ranks)]
    asked = checkpointed(counts.select(*keys, "__b", *asked).where(F.coalesce(*[f"__k{i}" for i in range(len(ranks))]).isNotNull()))
    placed = rows.join(asked, [*keys, "__b"]).withColumn("__i", F.row_number().over(inside(keys, value)))
    return placed.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == F.col(f"__k{i}"), F.col(value))).alias(f"gap_p{r * 100:g}") for i, r in enumerate(ranks)])


def summary(profile: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The profile with ``gap_mean``, ``jitter`` (standard deviation of the gaps) and ``gap_p50`` and so on, without sums and sketch.

    A quantile is the least gap whose share of gaps at or below it reaches the rank.
    """
    mean = F.try_divide(F.col("gap_sum"), F.col("gaps"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("gap_squares"), F.col("gaps")) - mean * mean))
    at = [F.when(F.col("gaps") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(r)))).alias(f"gap_p{r * 100:g}") for r in ranks]
    return profile.select("*", mean.alias("gap_mean"), spread.alias("jitter"), *at).drop("gap_sum", "gap_squares", "sketch")
