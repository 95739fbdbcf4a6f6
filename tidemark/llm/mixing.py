"""Operator 4: mixing sources to target weights, as a time-varying curriculum.

Each source has a weight schedule over training time. Its integral, scaled to the source's target,
is the source's cumulative demand of tokens; each copy of a document stands at a known place in its
source's token sequence, pass after pass, and inverting the demand there gives its training position.
Sorting copies by range over the positions yields the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, whole_row

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Relative weight of a source at the start and at the end of training; linear between. By weight
#: rank, like ``WEIGHTS``: heavy sources fade, light ones grow, the rest are even.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
#: Rows of one source that share a bucket when running totals are built.
BUCKET_ROWS = 2_000


def target_table(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, weight, rank, target)`` from ``(source, source_size)``, one row per source.

    Sources by code point, null last, take the weights in turn. ``share`` times all sizes is dealt by
    weight; a target stops at ``most`` times its source's size and the excess goes to the others by
    weight until none is above. That is a water level: with sources sorted by cap per weight, the
    first k are capped and the rest share what is left, for the least k where the next is not above
    its cap. The windows here run over one row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.partitionBy(F.lit(0)).orderBy("level", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    filled = (
        ranked.withColumn("total", share * F.sum("source_size").over(every))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("fits", F.col("left") <= F.col("level") * F.col("left_weight"))
        # the level at the first source that is not above its cap holds for it and all after it
        .withColumn("common", F.min_by(F.col("left") / F.col("left_weight"), F.when(F.col("fits"), F.struct("level", "rank"))).over(every))
    )
    target = F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap")))
    return filled.select("source", F.col("source_size"), "weight", "rank", target.alias("target"))


def position(share: Column, start: Column, end: Column) -> Column:
    """The time in [0, 1] at which a linear schedule from ``start`` to ``end`` has used ``share`` of its integral."""
    # integral over [0, t] of start + (end - start) x is start t + (end - start) t^2 / 2; solved without cancellation
    whole = (start + end) / 2
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * (end - start) * whole * share))
    return F.least(F.lit(1.0), 2 * whole * share / (start + root))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, schedules=SCHEDULES, keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, source, size, source_size, target, start, taken, copies, position, positions)``, one row per input row.

    ``size`` counts ``[^\\x20\\x09-\\x0D]+`` in the whole text (null: 0). Within a source documents
    follow one another in the order of the MD5 of id and text; the mix runs over that sequence until the
    target is reached, again from the front if need be. ``start`` is the document's place in it,
    ``taken`` the words that the mix takes of it (repeats counted; the words of one document per
    source may be taken in part, so that a source's sum is its target to within a word), ``copies``
    the nearest whole number of copies, ``positions`` the training position of each pass that reaches
    the document (pass k at ``start`` + k ``source_size``, while below the target; null if none is),
    and ``position`` the first of them. Empty documents take 0 words. A null source is a source of its own; a source
    whose texts are all empty has target 0. Equal rows get neighbouring places. ``keep`` names
    further input columns to carry along; an empty table gives an empty result. Nothing is random, so
    reruns agree.

    A source may hold a third of all rows: running totals are taken within buckets of about
    ``BUCKET_ROWS`` rows by hash, and between buckets over one row per bucket.
    """
    keep = keep or []
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text_col), F.lit("")))).alias("h"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    if not keep:
        rows = durable(rows)
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = durable(per)
    goals = target_table(per.select("source", "source_size"), weights, share, most).join(per.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    goals = goals.withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS).cast("long"))
    goals = durable(goals).withColumnRenamed("source", "s2")
    placed = rows.join(goals, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    # hash order cut into equal ranges: a bucket is a range of the order, so bucket totals add up to places
    placed = placed.withColumn("bucket", F.least(F.floor(F.conv(F.substr("h", F.lit(1), F.lit(8)), 16, 10).cast("double") / float(1 << 32) * F.col("buckets")), F.col("buckets") - 1))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    ahead = sums.select(
        F.col("source").alias("s2"),
        F.col("bucket").alias("b2"),
        F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = placed.join(ahead, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    start = F.col("ahead") + F.col("inside")
    goal = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = goal - full * F.col("source_size")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    pair = F.element_at(F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in schedules]), (F.col("rank") % len(schedules) + 1).cast("int"))
    out = out.withColumn("start", start).withColumn("pair", pair)
    passes = F.sequence(F.lit(0).cast("long"), F.floor((goal - F.col("start") - 1) / F.col("source_size")))
    places = F.transform(passes, lambda k: position((F.col("start") + k * F.col("source_size")) / F.col("target"), F.col("pair.a"), F.col("pair.b")))
    out = out.withColumn("positions", F.when((F.col("target") > 0) & (F.col("start") < goal), places))
    return out.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "start",
        taken.cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.floor(taken / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int").alias("copies"),
        F.get("positions", F.lit(0)).alias("position"),
        "positions",
        *[F.col(f"kept_{c}") for c in keep],
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Rows sorted by range over the training position; those that are never reached come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def repeat_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes it: each row as often as its nearest whole number of copies, in training order.

    Each copy stands at its own pass's position, so the repeats of a row are apart. Rows that the mix
    never reaches go; rows without words have no size to weigh and stay once, at their first position.
    """
    mixed = mix(docs.withColumn("__row", whole_row(docs)), id_col, text_col, source_col, keep=["__row"], **options)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    taken = mixed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    taken = taken.withColumn("at", F.get("positions", F.col("copy") - 1))
    return taken.orderBy(F.col("at").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "copy").select("kept___row.*")


def sql(weights=WEIGHTS, share: float = SHARE, most: float = MOST, schedules=SCHEDULES) -> str:
    """The op4 query over ``documents`` in DuckDB: targets by trying every number of capped sources, places by one running sum."""
    w = "CASE " + " ".join(f"WHEN k % {len(weights)} = {i} THEN {x}::DOUBLE" for i, x in enumerate(weights)) + " END"
    a, b = ("CASE " + " ".join(f"WHEN k % {len(schedules)} = {i} THEN {x[j]}::DOUBLE" for i, x in enumerate(schedules)) + " END" for j in (0, 1))
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
q AS (SELECT *, {w} AS w, {most}::DOUBLE * source_size AS cap FROM s), total AS (SELECT {share}::DOUBLE * sum(source_size) AS t FROM q),
level AS (SELECT x.cap / x.w AS edge, sum(CASE WHEN y.cap / y.w < x.cap / x.w THEN y.cap ELSE 0 END) AS full_, sum(CASE WHEN y.cap / y.w < x.cap / x.w THEN 0 ELSE y.w END) AS w FROM q x, q y GROUP BY ALL),
water AS (SELECT arg_min((t - full_) / w, edge) AS l FROM level, total WHERE (t - full_) / w <= edge),
g AS (SELECT source, source_size, k, least(cap, coalesce(l * w, cap)) AS target, {a} AS a, {b} AS b FROM q, water),
p AS (SELECT d.doc_id, d.size, g.*, round(target)::BIGINT AS goal, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
n AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size * size + greatest(0, least(size, goal - goal // source_size * source_size - start)) ELSE 0 END AS taken FROM p),
z AS (SELECT *, CASE WHEN target > 0 AND start < goal THEN list_transform(range(0, (goal - start - 1) // source_size + 1), lambda i: least(1.0, (a + b) * ((start + i * source_size) / target) / (a + sqrt(greatest(0.0, a * a + (b - a) * (a + b) * ((start + i * source_size) / target)))))) END AS places FROM n)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken::BIGINT AS taken, CASE WHEN size > 0 THEN floor(taken / size + 0.5) ELSE 0 END::INTEGER AS copies, round(places[1], 9) AS position, array_to_string(list_transform(places, lambda x: round(x * 1000000)::BIGINT), ',') AS positions_ppm FROM z
"""
