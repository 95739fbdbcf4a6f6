"""Reference grid, as-of joins, and bucketing of a fast stream onto slow frames.

A stream is cut into buckets of time, and what a bucket needs from its neighbours is carried over from
one summary row per bucket: how many samples came before, the last before, the first after. So no task
holds a whole stream, one stream may hold any share of all rows, and results do not depend on the cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import before, carried, cut, inside, previous
from .transforms import to_long

#: Width of a bucket: one hour.
BUCKET_US = 3_600_000_000
HOLD, CONTINUOUS = "hold", "continuous"


def grid(samples: DataFrame, keys: list[str], rate_hz: float, t: str = "t_ref_us") -> DataFrame:
    """``keys, grid_idx, t_us``: points every 1e6 / rate from the first to the last sample of all streams of a session."""
    if rate_hz <= 0:
        raise ValueError("rate_hz must be positive")
    points = _numbers(_spans(samples, keys, rate_hz, t).withColumn("__lo", F.lit(0).cast("long")).withColumnRenamed("__n", "__hi"))
    return points.select(*keys, "grid_idx", _point(F.col("grid_idx"), rate_hz).alias("t_us"))


def _spans(samples: DataFrame, keys: list[str], rate_hz: float, t: str) -> DataFrame:
    """``keys, __a, __n``: time of the first point of each grid, and its number of points."""
    span = samples.groupBy(*keys).agg(F.min(t).alias("__a"), F.max(t).alias("__b")).where("__a is not null")
    return span.select(*keys, "__a", (F.floor((F.col("__b") - F.col("__a")) / (1e6 / rate_hz)).cast("long") + 1).alias("__n"))


def _point(k: Column, rate_hz: float) -> Column:
    """Time of point ``k``."""
    return F.col("__a") + to_long(k * F.lit(1e6 / rate_hz))


def _numbers(rows: DataFrame) -> DataFrame:
    """``rows`` with ``grid_idx`` from ``__lo`` to before ``__hi``, in two levels of sequences, so that no row holds a whole grid."""
    blocks = rows.where("__lo < __hi").withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(__hi - __lo - 1) div 4096"))))
    first = F.col("__lo") + F.col("__k") * 4096
    return blocks.withColumn("grid_idx", F.explode(F.sequence(first, F.least(first + 4095, F.col("__hi") - 1)))).drop("__k")


def summary(points: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_grid, t_start_us, t_end_us`` of every session's grid; a session without points has zeros."""
    per = points.groupBy(*keys).agg(F.count("*").alias("n"), F.min("t_us").alias("a"), F.max("t_us").alias("z"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return sessions.select(*keys).distinct().join(per, keys, "left").select(*keys, zero(F.col("n"), "n_grid"), zero(F.col("a"), "t_start_us"), zero(F.col("z"), "t_end_us"))


def neighbours(points: DataFrame, samples: DataFrame, keys: list[str], extra: list[str], t: str = "t_us", s: str = "t_ref_us", bucket_us: int = BUCKET_US) -> DataFrame:
    """``points`` with ``n_upto, prev_t, next_t``: samples at or before each point, the last such, the first after.

    One exchange by (keys, bucket) carries both window passes; the frame that looks ahead is a
    descending one, so that it grows row by row too.
    """
    bucket = lambda c: F.floor(F.col(c) / bucket_us).cast("long")
    marked = points.select(*keys, F.col(t).alias("__t"), F.lit(None).cast("long").alias("__s"), *extra)
    sampled = samples.where(F.col(s).isNotNull()).select(*keys, F.col(s).cast("long").alias("__t"), F.col(s).cast("long").alias("__s"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra])
    every = marked.withColumn("__p", F.lit(True)).unionByName(sampled.withColumn("__p", F.lit(False))).withColumn("__b", bucket("__t"))
    sums = every.groupBy(*keys, "__b").agg(F.count("__s").alias("__n"), F.max("__s").alias("__hi"), F.min("__s").alias("__lo"))
    order = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "__b", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__base"), F.max("__hi").over(order).alias("__before"), F.min("__lo").over(back).alias("__after"))
    up = Window.partitionBy(*keys, "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "__b").orderBy(F.col("__t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    seen = every.withColumn("__c", F.count("__s").over(up)).withColumn("__l", F.max("__s").over(up)).withColumn("__f", F.min("__s").over(down)).where("__p")
    out = seen.join(carry, [*keys, "__b"])
    return out.select(*keys, F.col("__t").alias(t), *extra, (F.col("__base") + F.col("__c")).alias("n_upto"), F.coalesce("__l", "__before").alias("prev_t"), F.coalesce("__f", "__after").alias("next_t"))


def asof_join(points: DataFrame, samples: DataFrame, keys: list[str], tolerance_us: int, kernel: str = HOLD, bucket_us: int = BUCKET_US) -> DataFrame:
    """``keys, grid_idx, t_us, source_index, next_index, weight, valid, interp_confidence``, one row per grid point.

    ``points(keys, grid_idx, t_us)`` meets ``samples(keys, t_ref_us)``. Indices count the stream sorted
    by time, from 0; -1 is none. HOLD takes the last sample at or before the point (of equals the
    last), valid within the tolerance. CONTINUOUS also gives the next sample and the weight towards
    it, and is valid if the nearer one is within the tolerance, also before the first and after the
    last sample. Confidence falls linearly to 0 at the tolerance. Samples with a null time are none; a
    stream without samples is invalid everywhere.
    """
    if tolerance_us <= 0:
        raise ValueError("tolerance_us must be positive")
    if kernel not in (HOLD, CONTINUOUS):
        raise ValueError(f"unknown kernel {kernel!r}")
    near = neighbours(points, samples, keys, ["grid_idx"], bucket_us=bucket_us)
    back, ahead = F.col("t_us") - F.col("prev_t"), F.col("next_t") - F.col("t_us")
    gap = back if kernel == HOLD else F.least(back, ahead)  # least skips nulls
    valid = F.coalesce(gap <= tolerance_us, F.lit(False))
    has_next = F.lit(kernel == CONTINUOUS) & F.col("next_t").isNotNull()
    weight = F.when(has_next & F.col("prev_t").isNotNull(), back / (F.col("next_t") - F.col("prev_t")).cast("double")).otherwise(0.0)
    return near.select(
        *keys,
        "grid_idx",
        "t_us",
        (F.col("n_upto") - 1).cast("long").alias("source_index"),
        F.when(has_next, F.col("n_upto")).otherwise(-1).cast("long").alias("next_index"),
        weight.alias("weight"),
        valid.alias("valid"),
        F.when(valid, F.greatest(F.lit(0.0), 1 - gap / float(tolerance_us))).otherwise(0.0).alias("interp_confidence"),
    )


def stream_positions(samples: DataFrame, keys: list[str], usable: Column, t: str = "t_ref_us", ties: tuple[str, ...] = (), bucket_us: int = BUCKET_US) -> DataFrame:
    """``samples`` with ``usable``, ``position`` and ``usable_position``: places from 0 in the whole stream and among usable samples, in one pass.

    Order is by time, then samples that are not usable first (so that the last of equals is usable if
    one of them is), then by ``ties``. Samples with a null time have no place and are left out; of a
    sample that is not usable, ``usable_position`` is null.
    """
    rows = cut(samples.where(F.col(t).isNotNull()).withColumn("usable", F.coalesce(usable, F.lit(True))), t, bucket_us)
    total = lambda c: F.coalesce(F.sum(c).over(before(keys)), F.lit(0))
    rows = carried(rows, keys, {"__n": F.count("*"), "__u": F.count_if("usable")}, {"__base": total("__n"), "__ubase": total("__u")})
    w = inside(keys, t, "usable", *ties)
    place = (F.col("__base") + F.row_number().over(w) - 1).cast("long")
    among = (F.col("__ubase") + F.count_if("usable").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")
    return rows.select(*samples.columns, "usable", place.alias("position"), F.when(F.col("usable"), among).alias("usable_position"))


def _beside(points: DataFrame, samples: DataFrame, keys: list[str], bucket_us: int) -> DataFrame:
    """``points(keys, grid_idx, t_us)`` with ``last`` and ``following``: the structs ``s`` (time first) of the samples beside each, null for none."""
    marked = points.select(*keys, F.col("t_us").alias("__t"), F.lit(None).cast(samples.schema["s"].dataType).alias("s"), F.col("grid_idx"))
    every = marked.unionByName(samples.select(*keys, F.col("s")["t"].alias("__t"), "s", F.lit(None).cast("long").alias("grid_idx"))).withColumn("__b", F.floor(F.col("__t") / bucket_us).cast("long"))
    ends = every.groupBy(*keys, "__b").agg(F.max("s").alias("__hi"), F.min("s").alias("__lo"))
    back = Window.partitionBy(*keys).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "__b", F.max("__hi").over(before(keys)).alias("__before"), F.min("__lo").over(back).alias("__after"))
    up = Window.partitionBy(*keys, "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "__b").orderBy(F.col("__t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    seen = every.withColumn("__l", F.max("s").over(up)).withColumn("__f", F.min("s").over(down)).where("grid_idx is not null")
    return seen.join(carry, [*keys, "__b"]).select(*keys, "grid_idx", F.col("__t").alias("t_us"), F.coalesce("__l", "__before").alias("last"), F.coalesce("__f", "__after").alias("following"))


def asof_join_rated(points: DataFrame, samples: DataFrame, keys: list[str], tolerance_us: int, kernel: str = HOLD, usable: Column | None = None, confidence: str | None = None, bucket_us: int = BUCKET_US) -> DataFrame:
    """``asof_join`` for samples that may be unusable and have a confidence of their own.

    ``usable`` is a condition on a sample (null counts as true; all are usable without it); only
    usable samples are joined, while ``source_index`` and ``next_index`` still count the whole stream.
    Two columns are added: ``usable_index``, the source's place among usable samples, and
    ``source_confidence``, the value of ``confidence`` in the source sample (null is 1, and so is
    every sample's without it; 0 for a point without a source).
    """
    if tolerance_us <= 0:
        raise ValueError("tolerance_us must be positive")
    if kernel not in (HOLD, CONTINUOUS):
        raise ValueError(f"unknown kernel {kernel!r}")
    own = samples.withColumn("__c", F.coalesce(F.col(confidence), F.lit(1.0)) if confidence else F.lit(1.0))
    placed = stream_positions(own, keys, F.lit(True) if usable is None else usable, ties=("__c",), bucket_us=bucket_us).where("usable")
    placed = placed.select(*keys, F.struct(F.col("t_ref_us").cast("long").alias("t"), "position", "usable_position", F.col("__c").alias("c")).alias("s"))
    near = _beside(points, placed, keys, bucket_us)
    back, ahead = F.col("t_us") - F.col("last.t"), F.col("following.t") - F.col("t_us")
    gap = back if kernel == HOLD else F.least(back, ahead)
    valid = F.coalesce(gap <= tolerance_us, F.lit(False))
    both = F.lit(kernel == CONTINUOUS) & F.col("following").isNotNull()
    index = lambda c: F.coalesce(c, F.lit(-1)).cast("long")
    return near.select(
        *keys,
        "grid_idx",
        "t_us",
        index(F.col("last.position")).alias("source_index"),
        F.when(both, index(F.col("following.position"))).otherwise(-1).cast("long").alias("next_index"),
        F.when(both & F.col("last").isNotNull(), back / (F.col("following.t") - F.col("last.t")).cast("double")).otherwise(0.0).alias("weight"),
        valid.alias("valid"),
        F.when(valid, F.greatest(F.lit(0.0), 1 - gap / float(tolerance_us))).otherwise(0.0).alias("interp_confidence"),
        index(F.col("last.usable_position")).alias("usable_index"),
        F.coalesce("last.c", F.lit(0.0)).alias("source_confidence"),
    )


def stretches(samples: DataFrame, streams: DataFrame, session: list[str], keys: list[str], rate_hz: float, usable: Column | None = None, confidence: str | None = None, bucket_us: int = BUCKET_US) -> DataFrame:
    """Each sample of ``streams(keys, ...)`` with the one before it and the numbers of the grid points between them, for ``aligned``.

    The grid is that of all ``samples(keys, t_ref_us)`` of a ``session``. What is sorted and dealt out
    are samples, and one row more per stream for the points behind its last sample, however many points
    there are. Other columns of ``streams`` pass through; ``usable`` and ``confidence`` are those of ``asof_join_rated``.
    """
    if rate_hz <= 0:
        raise ValueError("rate_hz must be positive")
    own = samples.withColumn("__c", F.coalesce(F.col(confidence), F.lit(1.0)) if confidence else F.lit(1.0))
    placed = stream_positions(own, keys, F.lit(True) if usable is None else usable, ties=("__c",), bucket_us=bucket_us).where("usable")
    placed = placed.select(*keys, F.col("t_ref_us").cast("long").alias("__t"), "position", "usable_position", F.col("__c").alias("c"))
    end = F.lit(1 << 62).cast("long")
    ends = streams.select(*keys, end.alias("__t"), end.alias("position"), end.alias("usable_position"), F.lit(0.0).alias("c"))
    rows = previous(placed.unionByName(ends), keys, "__t", {"__pt": "__t", "__pi": "position", "__pu": "usable_position", "__pc": "c"}, bucket_us, ["position"])
    rows = rows.join(streams.join(_spans(samples, session, rate_hz, "t_ref_us"), session), keys)
    final = F.col("__t") == end

    def first(t: Column) -> Column:
        """The first point at or after a time: by division, and by the points beside it for what rounding leaves open."""
        k = F.ceil((t - F.col("__a") - 0.5) / (1e6 / rate_hz)).cast("long")
        return F.greatest(F.lit(0).cast("long"), k - 1 + sum(F.when(_point(k + i, rate_hz) < t, 1).otherwise(0) for i in (-1, 0, 1)))

    lo = F.when(F.col("__pt").isNull(), F.lit(0).cast("long")).otherwise(first(F.col("__pt")))
    hi = F.when(final, F.col("__n")).otherwise(F.least("__n", first(F.col("__t"))))
    extra = [c for c in streams.columns if c not in keys]
    following = [F.when(~final, F.col(c)).alias(n) for c, n in (("__t", "__ft"), ("position", "__fi"))]
    return rows.select(*keys, *extra, "__a", lo.alias("__lo"), hi.alias("__hi"), "__pt", "__pi", "__pu", "__pc", *following).where("__lo < __hi")


def aligned(rows: DataFrame, keys: list[str], tolerance_us: int, rate_hz: float, rated: bool = False) -> DataFrame:
    """``asof_join`` (or ``asof_join_rated``) of the points of ``stretches``, by their column ``kernel``; the streams' other columns pass through.

    Points are made where their samples lie: no row of a point is exchanged, sorted or written.
    """
    if tolerance_us <= 0:
        raise ValueError("tolerance_us must be positive")
    known = ["__a", "__lo", "__hi", "__pt", "__pi", "__pu", "__pc", "__ft", "__fi"]
    extra = [c for c in rows.columns if c not in (*keys, *known)]
    near = _numbers(rows).withColumn("t_us", _point(F.col("grid_idx"), rate_hz))
    back, ahead, both = F.col("t_us") - F.col("__pt"), F.col("__ft") - F.col("t_us"), F.col("kernel") == CONTINUOUS
    gap = F.when(both, F.least(back, ahead)).otherwise(back)
    near = near.withColumn("valid", F.coalesce(gap <= tolerance_us, F.lit(False)))
    index = lambda c: F.coalesce(c, F.lit(-1)).cast("long")
    more = [index(F.col("__pu")).alias("usable_index"), F.coalesce("__pc", F.lit(0.0)).alias("source_confidence")] if rated else []
    return near.select(
        *keys,
        "grid_idx",
        "t_us",
        index(F.col("__pi")).alias("source_index"),
        F.when(both, index(F.col("__fi"))).otherwise(-1).cast("long").alias("next_index"),
        F.when(both & F.col("__pt").isNotNull() & F.col("__ft").isNotNull(), back / (F.col("__ft") - F.col("__pt")).cast("double")).otherwise(0.0).alias("weight"),
        "valid",
        F.when(F.col("valid"), F.greatest(F.lit(0.0), 1 - gap / float(tolerance_us))).otherwise(0.0).alias("interp_confidence"),
        *more,
        *extra,
    )


def coverage(alignment: DataFrame, keys: list[str]) -> DataFrame:
    """Share of grid points that are valid."""
    return alignment.groupBy(*keys).agg(F.avg(F.col("valid").cast("double")).alias("coverage"))


def slots_per_frame(grid_rate_hz: float, anchor_fps: float) -> int:
    """Samples that a frame may hold: the rate ratio, rounded up."""
    if grid_rate_hz <= 0 or anchor_fps <= 0:
        raise ValueError("rates must be positive")
    return math.ceil(grid_rate_hz / anchor_fps)


def subframe_buckets(anchors: DataFrame, samples: DataFrame, keys: list[str], slots: int, t: str = "t_us", s: str = "t_ref_us", bucket_us: int = BUCKET_US) -> DataFrame:
    """``keys, frame_idx, index ARRAY<BIGINT>, m_k, valid``: the samples in [anchor k, anchor k + 1).

    The first ``slots`` samples of a frame by time, padded by repeating the last; an empty frame has
    zeros, ``m_k`` 0 and is invalid. The last anchor closes the last frame. Since indices run on in
    time, a frame's samples are known from the number of samples before its two anchors alone.
    """
    if slots < 1:
        raise ValueError("slots must be >= 1")
    # samples before an anchor: those at or before the microsecond before it
    at = anchors.where(F.col(t).isNotNull()).select(*keys, (F.col(t) - 1).cast("long").alias("t_us"), F.col(t).cast("long").alias("anchor"))
    rows = cut(neighbours(at, samples, keys, ["anchor"], s=s, bucket_us=bucket_us), "anchor", bucket_us)
    # a frame is closed by the next anchor, so it is written down there; counts rise with anchors
    rows = carried(rows, keys, {"__n": F.count("*"), "__top": F.max("n_upto")}, {"__base": F.coalesce(F.sum("__n").over(before(keys)), F.lit(0)), "__before": F.max("__top").over(before(keys))})
    w = inside(keys, "anchor", "n_upto")
    frames = rows.select(*keys, (F.col("__base") + F.row_number().over(w) - 2).cast("long").alias("frame_idx"), F.coalesce(F.lag("n_upto").over(w), "__before").alias("__a"), F.col("n_upto").alias("__z")).where("__a is not null")
    m = F.least(F.col("__z") - F.col("__a"), F.lit(slots).cast("long"))
    index = F.when(m == 0, F.array_repeat(F.lit(0).cast("long"), slots)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")), lambda i: F.col("__a") + F.least(i, m - 1)))
    return frames.select(*keys, "frame_idx", index.alias("index"), m.cast("int").alias("m_k"), (m > 0).alias("valid"))
