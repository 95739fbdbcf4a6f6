"""Residuals, round-trip accuracy, dropout, property checks and the release gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ROWS, previous
from .transforms import col, correct


@dataclass(frozen=True)
class Gates:
    """Thresholds of the release gate."""

    release_resid_us: float = 2000.0
    certified_resid_us: float = 500.0
    hardfail_resid_us: float = 5000.0
    min_coverage: float = 0.99
    max_dropout: float = 0.03

    def __post_init__(self):
        if not 0 < self.certified_resid_us <= self.release_resid_us <= self.hardfail_resid_us:
            raise ValueError("certified <= release <= hardfail is required, all positive")
        if not (0 <= self.min_coverage <= 1 and 0 <= self.max_dropout <= 1):
            raise ValueError("coverage and dropout lie in [0, 1]")


def rms(c) -> Column:
    """Root mean square; no rows: 0."""
    return F.coalesce(F.sqrt(F.avg(col(c) * col(c))), F.lit(0.0))


def event_residual(observations: DataFrame, models: DataFrame, keys: list[str], event: str = "event_id") -> DataFrame:
    """``keys, device_id, residual_us``: RMS of the mapped time less the reference's over events both observed.

    One row per follower; without such an event it is 0.
    """
    ref = models.where("is_reference").select(*keys, "device_id")
    theirs = observations.join(ref, [*keys, "device_id"]).select(*keys, event, F.col("t_local_us").alias("__ref"))
    mapped = observations.join(models.where("not is_reference").select(*keys, "device_id", "alpha", "beta_us"), [*keys, "device_id"])
    both = mapped.join(theirs, [*keys, event]).withColumn("__r", (correct("t_local_us") - F.col("__ref")).cast("double"))
    per = both.groupBy(*keys, "device_id").agg(rms("__r").alias("__rms"))
    followers = models.where("not is_reference").select(*keys, "device_id")
    return followers.join(per, [*keys, "device_id"], "left").select(*keys, "device_id", F.coalesce("__rms", F.lit(0.0)).alias("residual_us"))


def reconciliation_residual(observations: DataFrame, models: DataFrame, keys: list[str], event: str = "event_id") -> DataFrame:
    """``keys, sync_resid_us``: RMS over events of the spread of mapped times.

    Observers count if they are the reference or have a clock confidence above 0; an event needs two.
    Sessions without such an event have 0.
    """
    usable = models.where("is_reference or clock_confidence > 0").select(*keys, "device_id", "alpha", "beta_us")
    mapped = observations.join(usable, [*keys, "device_id"]).withColumn("__t", correct("t_local_us"))
    spread = mapped.groupBy(*keys, event).agg((F.max("__t") - F.min("__t")).cast("double").alias("__s"), F.count("*").alias("__n")).where("__n >= 2")
    return models.select(*keys).distinct().join(spread.groupBy(*keys).agg(rms("__s").alias("r")), keys, "left").select(*keys, F.coalesce("r", F.lit(0.0)).alias("sync_resid_us"))


def roundtrip_accuracy(models: DataFrame, truth: DataFrame, samples: DataFrame, keys: list[str], t: str = "t_device_us") -> DataFrame:
    """``keys, device_id, alpha_err, beta_err_us, alignment_rmse_us`` of every follower that has a truth."""
    group = [*keys, "device_id"]
    both = models.where("not is_reference").select(*group, "alpha", "beta_us").join(truth.select(*group, F.col("alpha").alias("ta"), F.col("beta_us").alias("tb")), group)
    diff = (F.col("alpha") * F.col(t) + F.col("beta_us")) - (F.col("ta") * F.col(t) + F.col("tb"))
    errors = samples.join(both, group).groupBy(*group).agg(rms(diff).alias("rmse"))
    return both.join(errors, group, "left").select(*group, F.abs(F.col("alpha") - F.col("ta")).alias("alpha_err"), F.abs(F.col("beta_us") - F.col("tb")).alias("beta_err_us"), F.coalesce("rmse", F.lit(0.0)).alias("alignment_rmse_us"))


def dropout(expected: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, dropout``: the share of ``expected(keys, n_expected)`` that is missing; none expected: 0."""
    got = samples.groupBy(*keys).agg(F.count("*").alias("__got"))
    share = F.when(F.col("n_expected") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce("__got", F.lit(0)) / F.col("n_expected")))
    return expected.join(got, keys, "left").select(*keys, share.alias("dropout"))


def sync_method(events: DataFrame, keys: list[str], tier: str = "tier") -> DataFrame:
    """``keys, sync_method``: the tier of the events if it is one, else mixed."""
    return events.groupBy(*keys).agg(F.when(F.count_distinct(tier) == 1, F.min(tier)).when(F.count_distinct(tier) > 1, "mixed").otherwise("none").alias("sync_method"))


def property_checks(grid: DataFrame, alignment: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, grid_monotonic, bounded_step, no_fabricated_gaps`` as pass or fail."""
    step = previous(grid, keys, "grid_idx", {"__p": "t_us"}, ROWS).withColumn("__d", F.col("t_us") - F.col("__p"))
    word = lambda c: F.when(F.coalesce(c, F.lit(True)), "pass").otherwise("fail")
    steps = step.groupBy(*keys).agg(word(F.min("__d") > 0).alias("grid_monotonic"), word((F.min("__d") >= 1) & (F.max("__d") <= 2 * F.min("__d"))).alias("bounded_step"))
    gaps = alignment.groupBy(*keys).agg(word(F.bool_and(F.col("valid") | (F.col("interp_confidence") == 0))).alias("no_fabricated_gaps"))
    return steps.join(gaps, keys, "left").withColumn("no_fabricated_gaps", F.coalesce("no_fabricated_gaps", F.lit("pass")))


def worst_device(roundtrip: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, max_alpha_err, max_beta_err_us, devices``: the largest errors over a session's followers."""
    return roundtrip.groupBy(*keys).agg(F.max("alpha_err").alias("max_alpha_err"), F.max("beta_err_us").alias("max_beta_err_us"), F.count("*").alias("devices"))


def gate(residual, coverage_min, dropout_max, gates: Gates = Gates()) -> Column:
    """blocked, certified, release or needs_review."""
    r, good = col(residual), (col(coverage_min) >= gates.min_coverage) & (col(dropout_max) <= gates.max_dropout)
    return F.when(r >= gates.hardfail_resid_us, "blocked").when((r < gates.certified_resid_us) & good, "certified").when((r < gates.release_resid_us) & good, "release").otherwise("needs_review")
