"""Impulse detection in signals, and a registry of detectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ROWS, before, carried, cut, inside

#: Registered by name: (signals, **options) -> detections.
_DETECTORS: dict[str, Callable[..., DataFrame]] = {}


def find_peaks(signals: DataFrame, keys: list[str], threshold: float = 0.5, t: str = "t_us", signal: str = "signal", pos: str = "pos", width: float = ROWS) -> DataFrame:
    """``keys, t_local_us``: the time of the first largest value of each maximal run above the threshold.

    Runs are taken in the order of ``pos``. A NaN is never above. A run is known by the last place
    before it that is not above, which is carried over buckets of ``width`` positions.
    """
    above = F.coalesce((F.col(signal) > threshold) & ~F.isnan(signal), F.lit(False))
    rows = cut(signals.select(*keys, t, signal, pos).withColumn("__low", F.when(~above, F.col(pos))), pos, width)
    rows = carried(rows, keys, {"__l": F.max("__low")}, {"__open": F.max("__l").over(before(keys))})
    run = F.coalesce(F.max("__low").over(inside(keys, pos).rowsBetween(Window.unboundedPreceding, 0)), F.col("__open"))
    peak = F.min_by(t, F.struct(-F.col(signal), F.col(pos)))
    return rows.withColumn("__run", run).where("__low is null").groupBy(*keys, "__run").agg(peak.cast("long").alias("t_local_us")).drop("__run")


def register_detector(name: str, detector: Callable[..., DataFrame]) -> None:
    """Make a detector known by name; a known name is replaced."""
    if not name:
        raise ValueError("a detector needs a name")
    _DETECTORS[name] = detector


def get_detector(name: str) -> Callable[..., DataFrame]:
    if name not in _DETECTORS:
        raise KeyError(f"unknown detector {name!r}; known: {registered_detectors()}")
    return _DETECTORS[name]


def registered_detectors() -> list[str]:
    return sorted(_DETECTORS)


register_detector("tactile_tap", find_peaks)
register_detector("visual_flash", find_peaks)
