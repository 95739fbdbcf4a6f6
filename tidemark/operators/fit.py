"""Clock estimators per group: offset, least squares, total least squares, piecewise, RANSAC.

All sums are mergeable aggregates (``regr_*`` keep centred moments), so every task pre-aggregates its
rows before the shuffle and a crowded group costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed, stored
from .ordered import TIME_US, before, cut, inside
from .transforms import clock_confidence, to_reference

#: Residuals beyond this many RMS are left out of the second fit.
OUTLIER = 3.0
#: Rows of a group that two-point models are drawn from, and a prime below 2^31.
POOL, _PRIME = 400, 2_147_483_647


def _apart(x: Column, y: Column) -> Column:
    """y - x. Clocks run nearly alike, so this is small where x and y are large, and for whole numbers it is exact."""
    return F.coalesce(F.try_subtract(y, x).cast("double"), y.cast("double") - x.cast("double"))


def _mean(w: Column, z: Column) -> Column:
    """Weighted mean as an aggregate; equal values give theirs."""
    return F.when(F.min(z) == F.max(z), F.min(z)).otherwise(F.sum(w * z) / F.sum(w))


def _slope(method: str, n: Column, sxx: Column, sxy: Column, sxz: Column, szz: Column) -> Column:
    """alpha - 1 from centred sums, z being y - x; alpha itself keeps four digits less of it where clocks run nearly alike."""
    if method == "offset":
        return F.lit(0.0)
    if method == "ols":
        return F.when((n < 2) | (sxx == 0), F.lit(0.0)).otherwise(F.try_divide(sxz, sxx))
    q = F.try_divide(2 * sxz + szz, 2 * sxy)  # syy - sxx over twice sxy
    root = F.sqrt(q * q + 1)
    return F.when((n < 2) | (sxy == 0), F.lit(0.0)).when(sxy > 0, q + q * F.try_divide(q, root + 1)).otherwise(q - root - 1)


def _line(method: str, x: Column, y: Column) -> tuple[Column, Column]:
    """(alpha - 1, beta) as aggregate expressions."""
    z, x, y = _apart(x, y), x.cast("double"), y.cast("double")
    over = _slope(method, F.count(x), F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_sxy(z, x), F.regr_syy(z, x))
    return over, F.avg(z) - over * F.avg(x)


def weighted_moments(df: DataFrame, keys: list[str], x: str, y: str, weight: str, width: float = TIME_US) -> DataFrame:
    """``keys, n, w, mx, my, sxx, syy, sxy``: rows, sum of weights, weighted means and centred sums per group."""
    m = _moments(df, keys, x, y, weight, width)
    sxx, szz, sxz = F.col("sxx"), F.col("szz"), F.col("sxz")
    return m.select(*keys, "n", "w", "mx", (F.col("mx") + F.col("mz")).alias("my"), "sxx", (sxx + 2 * sxz + szz).alias("syy"), (sxx + sxz).alias("sxy"))


def _moments(df: DataFrame, keys: list[str], x: str, y: str, weight: str, width: float = TIME_US) -> DataFrame:
    """``keys, n, w, mx, mz, sxx, szz, sxz``, z being y - x.

    Two levels, both pre-aggregated. Rows are cut into buckets of ``x``, and sums are taken around the
    bucket's edge, which every row knows, so nothing large is squared; a bucket's centred sums follow
    from them. Buckets are then merged by the distances of their means from the group's mean. One
    group may have any number of rows and buckets.
    """
    edge = F.floor(F.col(x) / F.lit(width)) * F.lit(width)
    rows = df.select(*keys, F.col(weight).cast("double").alias("__w"), edge.cast("double").alias("__e"), (F.col(x) - edge).cast("double").alias("__x"), _apart(F.col(x), F.col(y)).alias("__z"))
    w, dx, z = F.col("__w"), F.col("__x"), F.col("__z")
    sums = {"n": F.count("*"), "w": F.sum(w), "x": F.sum(w * dx), "z": F.sum(w * z), "mz": _mean(w, z), "xx": F.sum(w * dx * dx), "zz": F.sum(w * z * z), "xz": F.sum(w * dx * z)}
    part = rows.groupBy(*keys, "__e").agg(*[c.alias(f"__{n}") for n, c in sums.items()])
    part = part.select(*keys, "__n", "__w", (F.col("__e") + F.col("__x") / F.col("__w")).alias("__mx"), "__mz", *[(F.col(f"__{a}{b}") - F.col(f"__{a}") * F.col(f"__{b}") / F.col("__w")).alias(f"__s{a}{b}") for a, b in ("xx", "zz", "xz")])
    part = checkpointed(part)  # a row per bucket, read for the means and for the sums around them
    means = part.groupBy(*keys).agg(F.sum("__n").alias("n"), F.sum("__w").alias("w"), (F.sum(F.col("__w") * F.col("__mx")) / F.sum("__w")).alias("mx"), _mean(F.col("__w"), F.col("__mz")).alias("mz"))
    apart = {"x": F.col("__mx") - F.col("mx"), "z": F.col("__mz") - F.col("mz")}
    merged = [F.sum(F.col(f"__s{a}{b}") + F.col("__w") * apart[a] * apart[b]).alias(f"s{a}{b}") for a, b in ("xx", "zz", "xz")]
    return part.join(means, keys).groupBy(*keys, "n", "w", "mx", "mz").agg(*merged)


def _weighted_lines(df: DataFrame, keys: list[str], x: str, y: str, method: str, weight: str) -> DataFrame:
    m = _moments(df, keys, x, y, weight)
    over = _slope(method, F.col("n"), F.col("sxx"), F.col("sxx") + F.col("sxz"), F.col("sxz"), F.col("szz"))
    return m.withColumn("__over", over).select(*keys, "__over", (F.col("mz") - F.col("__over") * F.col("mx")).alias("beta_us"), F.col("n").alias("n_events"))


def _lines(df: DataFrame, keys: list[str], x: str, y: str, method: str, weight: str | None = None) -> DataFrame:
    """``keys, __over, beta_us, n_events``; ``__over`` is alpha - 1."""
    if weight:
        return _weighted_lines(df, keys, x, y, method, weight)
    over, beta = _line(method, F.col(x), F.col(y))
    return df.groupBy(*keys).agg(over.alias("__over"), beta.alias("beta_us"), F.count("*").alias("n_events"))


def _residuals(df: DataFrame, lines: DataFrame, keys: list[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """Rows with ``__r``, alpha * x + beta - y without its large terms."""
    off = F.col("__over") * F.col(x) + F.col("beta_us") - _apart(F.col(x), F.col(y))
    return df.select(*keys, x, y, *([weight] if weight else [])).join(lines, keys).withColumn("__r", off)


def _rms(res: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    square = F.col("__r") * F.col("__r")
    mean = F.sum(F.col(weight) * square) / F.sum(weight) if weight else F.avg(square)
    return res.groupBy(*keys).agg(F.sqrt(mean).alias("residual_us"))


def _usable(df: DataFrame, x: str, y: str, weight: str | None) -> DataFrame:
    """Rows that a fit takes; with a weight, no weight is 1, and rows without a positive one take no part."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if weight:
        w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
        df = df.withColumn(weight, w).where((w > 0) & (w < float("inf")))
    return df


def fit(df: DataFrame, keys: list[str], x: str = "t_local_us", y: str = "t_ref_us", method: str = "tls", robust: bool = False, weight: str | None = None) -> DataFrame:
    """``keys, alpha, beta_us, residual_us, n_events, confidence``: y = alpha * x + beta per group.

    ``method`` is offset, ols or tls. ``robust`` fits again without residuals beyond three RMS (if the
    group has three rows, the RMS is positive, and some but not all rows go); the residual is always
    over all rows. The rows are read twice per fit: for the line's moments and for its residuals. Lines
    and their RMS, one row per group, are written before rows are held against them.

    ``weight`` names a column of weights, such as the quality of events: means, moments and RMS are
    weighted, ``n_events`` counts rows. A null weight is 1; rows whose weight is not positive, NaN or
    infinite take no part. Equal weights give the fit without them.
    """
    df = _usable(df, x, y, weight)
    lines = _fitted(df, keys, x, y, method, robust, weight)
    out = lines.join(_rms(_residuals(df, lines, keys, x, y, weight), keys, weight), keys)
    out = out.select(*keys, (1 + F.col("__over")).alias("alpha"), "beta_us", "residual_us", "n_events")
    return out.withColumn("confidence", clock_confidence("residual_us", "n_events"))


def _fitted(df: DataFrame, keys: list[str], x: str, y: str, method: str, robust: bool, weight: str | None = None) -> DataFrame:
    """``keys, __over, beta_us, n_events``, stored, ``__over`` being alpha - 1: rows that are held against their group's line need not be sorted by group while groups are few."""
    lines = stored(_lines(df, keys, x, y, method, weight))
    if not robust:
        return lines
    out = stored(lines.join(_rms(_residuals(df, lines, keys, x, y, weight), keys, weight), keys))
    good = F.abs("__r") <= OUTLIER * F.col("residual_us")
    kept = _residuals(df, out.where("n_events >= 3 and residual_us > 0"), keys, x, y, weight).where(good)
    again = _lines(kept, keys, x, y, method, weight).withColumnsRenamed({"__over": "a2", "beta_us": "b2", "n_events": "n2"})
    both = out.join(again, keys, "left").withColumn("__use", F.col("n2").isNotNull() & (F.col("n2") < F.col("n_events")))
    return stored(both.select(*keys, F.when(F.col("__use"), F.col("a2")).otherwise(F.col("__over")).alias("__over"), F.when(F.col("__use"), F.col("b2")).otherwise(F.col("beta_us")).alias("beta_us"), "n_events"))


def fit_piecewise(df: DataFrame, keys: list[str], n_segments: int, x: str = "t_local_us", y: str = "t_ref_us", width: float = TIME_US) -> DataFrame:
    """``keys, segment, t_lo_us, t_hi_us, alpha, beta_us, n_events``: one row per segment.

    Rows sorted by x are cut into k = max(1, min(n_segments, n div 2)) runs at ``floor(i (n / k))``;
    each is fitted by robust total least squares. Borders are half-way between neighbours, the
    outermost at -1e18 and 1e18. Rows are counted in buckets of ``width``; only the buckets that a run
    begins inside of are sorted, and the rest goes to its run as it is read.
    """
    rows = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y), x, width)
    per = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    per = per.withColumn("__base", F.coalesce(F.sum("__n").over(before(keys)), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    k = F.greatest(F.lit(1), F.least(F.lit(n_segments), F.expr("__all div 2")))
    starts = F.transform(F.sequence(F.lit(1), F.lit(max(1, n_segments))), lambda s: F.when(s < k, F.floor(s * (F.col("__all") / k)) - F.col("__base")))
    here = F.transform(F.filter(starts, lambda s: (s >= 0) & (s < F.col("__n"))), lambda s: F.struct(F.col("__b").alias("b"), s.alias("at")))
    starts = stored(per.groupBy(*keys).agg(F.flatten(F.collect_list(here)).alias("__starts")))  # a row per group
    placed = rows.join(starts, keys)
    within = F.exists("__starts", lambda s: (s["b"] == F.col("__b")) & (s["at"] > 0))
    segment = lambda i: F.size(F.filter("__starts", lambda s: (s["b"] < F.col("__b")) | ((s["b"] == F.col("__b")) & (s["at"] <= i))))
    whole = placed.where(~within).select(*keys, segment(F.lit(0)).alias("segment"), x, y)
    split = placed.where(within).withColumn("__i", F.row_number().over(inside(keys, x, y)) - 1).select(*keys, segment(F.col("__i")).alias("segment"), x, y)
    rows = checkpointed(whole.unionByName(split))
    lines = _fitted(rows, [*keys, "segment"], x, y, "tls", True).withColumn("alpha", 1 + F.col("__over"))
    ends = rows.groupBy(*keys, "segment").agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    by = Window.partitionBy(*keys).orderBy("segment")  # n_segments rows
    lo = F.coalesce((F.lag("__hi").over(by) + F.col("__lo")) / 2.0, F.lit(-1e18))
    hi = F.coalesce((F.col("__hi") + F.lead("__lo").over(by)) / 2.0, F.lit(1e18))
    ends = ends.select(*keys, "segment", lo.alias("t_lo_us"), hi.alias("t_hi_us"))
    return ends.join(lines, [*keys, "segment"]).select(*keys, "segment", "t_lo_us", "t_hi_us", "alpha", "beta_us", "n_events")


def rate_piecewise(df: DataFrame, segments: DataFrame, keys: list[str], x: str = "t_local_us", y: str = "t_ref_us") -> DataFrame:
    """``keys, alpha, beta_us, segments, residual_us, n_events, confidence``: a piecewise model as one row.

    ``alpha`` and ``beta_us`` are the first segment's; the residual is the RMS of the rounded time that
    the segments map x to, less y.
    """
    models = stored(as_models(segments, keys))
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(models, keys)
    off = (to_reference(F.col(x).cast("long")) - F.col(y)).cast("double")
    per = rows.groupBy(*keys).agg(F.sqrt(F.avg(off * off)).alias("residual_us"), F.count("*").alias("n_events"))
    return models.join(per, keys).withColumn("confidence", clock_confidence("residual_us", "n_events"))


def as_models(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group with the segments nested, as ``to_reference`` reads them."""
    one = F.struct("segment", F.struct("t_lo_us", "t_hi_us", "alpha", "beta_us").alias("s"))
    nested = segments.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("segments"))
    return nested.withColumn("alpha", F.col("segments")[0]["alpha"]).withColumn("beta_us", F.col("segments")[0]["beta_us"])


def _drawn(k, salt: int) -> Column:
    """A number below 2^31 for each draw, by squaring modulo a prime."""
    h = (k + 1) * (48_271 + salt) % _PRIME
    h = (h * h + salt) % _PRIME
    return h * h % _PRIME


def ransac(df: DataFrame, keys: list[str], threshold_us: float = 1000.0, n_iters: int = 200, x: str = "t_local_us", y: str = "t_ref_us", refine: bool = True, weight: str | None = None) -> DataFrame:
    """``keys, alpha, beta_us, residual_us, n_events, confidence`` of the best consensus set per group.

    Two-point models are drawn, ``n_iters`` per group, from the group's ``POOL`` rows that are first by
    a hash of their values, so no group is sorted whole and a rerun agrees; a group's models are one
    row, and each is scored against all of the group's rows, hits being added up within the tasks. The model with most inliers wins (the earlier if they tie); it is refitted by robust
    total least squares on its inliers, with ``refine`` once more on the inliers of that, and the
    residual is over these. Groups of fewer than three rows, or without a consensus of two, are
    fitted whole, robustly, and count all rows. ``weight`` is that of ``fit``: it counts in the
    refits, while drawing and voting take each row of positive weight as one.
    """
    own = [F.col(weight).alias("weight")] if weight else []
    weight = "weight" if weight else None
    rows = _usable(df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *own), "x", "y", weight)
    more = [weight] if weight else []
    mixed = (F.pmod(F.col("x").cast("long"), F.lit(_PRIME)) * 48_271 + F.pmod(F.col("y").cast("long"), F.lit(_PRIME)) * 69_621) % _PRIME
    pool = rows.withColumn("h", mixed * mixed % _PRIME)
    # numbered from 1, so that each task keeps its first rows alone before they are sorted together
    pool = pool.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "x", "y"))).where(F.col("i") <= POOL)
    pool = checkpointed(pool.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p")))
    n, p = F.size("p").cast("long"), F.col("p")
    first = lambda k: _drawn(k, 11) % n
    drawn = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_iters - 1).cast("long")), lambda k: F.struct(F.get(p, first(k).cast("int")).alias("p"), F.get(p, ((first(k) + 1 + _drawn(k, 97) % (n - 1)) % n).cast("int")).alias("q")))
    slope = F.transform("d", lambda d: F.when(d["p"]["x"] != d["q"]["x"], (d["q"]["y"] - d["p"]["y"]) / (d["q"]["x"] - d["p"]["x"])))
    models = pool.where(F.size("p") >= 3).select(*keys, drawn.alias("d")).withColumn("as", slope)
    # one row per group: models as rows, some hundred per group, look small to Spark, which would broadcast them
    models = stored(models.select(*keys, "as", F.transform("d", lambda d, k: d["p"]["y"] - F.get("as", k) * d["p"]["x"]).alias("bs")))
    near = F.abs(F.col("__a") * F.col("x") + F.col("__b") - F.col("y")) <= threshold_us
    votes = rows.join(models, keys).select(*keys, "x", "y", "bs", F.posexplode("as").alias("k", "__a")).withColumn("__b", F.get("bs", F.col("k")))
    hits = votes.where("__a is not null").groupBy(*keys, "k").agg(F.count(F.when(near, True)).alias("hits"))
    best = hits.groupBy(*keys).agg(F.max_by(F.struct("k", "hits"), F.struct("hits", -F.col("k"))).alias("w")).where("w.hits >= 2")
    best = checkpointed(best.join(models, keys).select(*keys, F.get("as", F.col("w.k")).alias("__a"), F.get("bs", F.col("w.k")).alias("__b")))
    inliers = rows.join(best, keys).where(near).select(*keys, "x", "y", *more)
    if refine:
        lines = _fitted(checkpointed(inliers), keys, "x", "y", "tls", True, weight)
        inliers = _residuals(rows, lines, keys, "x", "y", weight).where(F.abs("__r") <= threshold_us).select(*keys, "x", "y", *more)
    good = fit(checkpointed(inliers), keys, "x", "y", "tls", robust=True, weight=weight)
    whole = fit(rows.join(best.select(*keys), keys, "left_anti"), keys, "x", "y", "tls", robust=True, weight=weight)
    return good.unionByName(whole)
