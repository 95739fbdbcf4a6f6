"""Operator 13: filter interaction audit by inclusion-exclusion.

Five document filters are judged once per document. What a part of the table needs from then on is one
number per set of filters: how many of its documents fail all of the set, summed as a product of
flags. These 32 joint counts determine every order of application, since each figure is a linear
combination of them: survivors of a set by Moebius inversion over its subsets, what a filter removes
after others, what it alone fails, and its Shapley value as its shares of the Harsanyi dividends of
"fails at least one of the set", which are the joint counts with alternating sign.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, r"[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(docs: DataFrame, part: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, part, A, B, C, D, E)``, one row per input row; a flag is 1 if the whole text fails the filter.

    A: fewer than 200 words; B: under half of the words are distinct; C: over 3 percent of the
    characters are A-Z; D: holds one of ``#$%&*|``; E: some smaller id has the same text. Null texts
    are empty (they fail A, and E after a smaller id with an empty or null text). A null id is neither
    smaller nor larger than another, so such rows never fail E nor make others fail it; rows that
    share an id do not make each other fail it. ``part`` defaults to ``lang``; null is the empty string.
    """
    part = F.col("lang") if part is None else part
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, capitals = F.size("words"), F.length("text") - F.length(F.translate("text", _CAPITALS, ""))
    judged = words.select(
        "doc_id",
        "part",
        (n < MIN_WORDS).cast("long").alias("A"),
        (100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * n).cast("long").alias("B"),
        (100 * capitals.cast("long") > MAX_CAPITALS_PERCENT * F.length("text")).cast("long").alias("C"),
        F.col("text").rlike(SYMBOLS).cast("long").alias("D"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    judged = durable(judged)  # some 50 bytes a document: the texts are read once and never shuffled
    # texts that several ids share, by partial aggregation; a text of a third of all rows is split by adaptive skew joins
    shared = judged.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("long")
    return judged.join(shared, "digest", "left").select("doc_id", "part", *FILTERS[:-1], later.alias("E"))


def joint_counts(rows: DataFrame, filters: str = FILTERS, weights: tuple[str, ...] = ()) -> DataFrame:
    """``(part, mask, n, *weights)``: documents of each part that fail all filters of each set, by number and by weight.

    Bit k of ``mask`` stands for the k-th filter; the empty set counts every document. One pass, and
    each task sends one row per part.
    """
    sums = []
    for mask in range(1 << len(filters)):
        both = [F.col(f) for k, f in enumerate(filters) if mask >> k & 1]
        product = math.prod(both, start=F.lit(1).cast("long"))
        fields = [F.sum(product).alias("n"), *(F.sum(product * F.col(w)).alias(w) for w in weights)]
        sums.append(F.struct(F.lit(mask).alias("mask"), *fields))
    return rows.groupBy("part").agg(F.array(*sums).alias("joint")).select("part", F.inline("joint"))


def coefficients(n: int) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """``(before, filter, mask, kept, removed, fails, unique, shapley)``: what each joint count adds to each figure.

    ``before`` is the set of filters applied so far and ``filter`` the next one. With (-1)^|R| = s(R):
    kept sums s(R) J(R) over subsets R of before and the filter; removed sums s(R) J(R and filter)
    over subsets R of before; unique does so over subsets of all other filters; shapley, summed over
    all n! orders, gives each set with the filter its dividend -s(R) J(R) times n! / |R|.
    """
    sign, orders, out = (lambda m: -1 if m.bit_count() & 1 else 1), math.factorial(n), []
    for f in range(n):
        bit = 1 << f
        for before in (m for m in range(1 << n) if not m & bit):
            for mask in range(1 << n):
                rest = mask & ~bit
                kept = sign(mask) if not mask & ~(before | bit) else 0
                removed = sign(rest) if mask & bit and not rest & ~before else 0
                unique = sign(rest) if mask & bit else 0
                shapley = -sign(mask) * (orders // mask.bit_count()) if mask & bit else 0
                out.append((before, f, mask, kept, removed, int(mask == bit), unique, shapley))
    return out


def every_order(joint: DataFrame, filters: str = FILTERS, weights: tuple[str, ...] = ()) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, <weight>_lost..., shapley)`` for all orders.

    All of it from the joint counts alone: 2^n rows a part meet a table of coefficients of fixed size.
    """
    spark, n = joint.sparkSession, len(filters)
    names = ("kept", "removed", "fails", "unique_fails", "shapley")
    table = spark.createDataFrame(coefficients(n), "before int, filter int, mask int, " + ", ".join(f"{c} long" for c in names))
    sums = [F.sum(F.col(f"c.{c}") * F.col("j.n")).alias(c) for c in names]
    sums += [F.sum(F.col("c.removed") * F.col(f"j.{w}")).alias(f"{w}_lost") for w in weights]
    figures = joint.alias("j").join(table.alias("c"), "mask").groupBy("part", "before", "filter").agg(*sums)
    steps = [("".join(filters[k] for k in p), i + 1, sum(1 << k for k in p[:i]), p[i]) for p in itertools.permutations(range(n)) for i in range(n)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    redundant = (F.col("fails") - F.col("removed")).alias("redundant")
    return figures.join(orders, ["before", "filter"]).select("part", "filter_order", "step", "kept", "removed", redundant, "unique_fails", *(f"{w}_lost" for w in weights), "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, order of the five filters, and step: what stays, goes, is redundant, unique, and lost of the labelled.

    ``labels(doc_id, quality, toxic)``: a document is good if a label of its id has quality 1, toxic if
    one has toxic 1; ids without a label, null ids and null labels are neither. Nulls, empty texts,
    ties and repeated rows as in ``failures`` (a repeated row counts as often as it stands); other
    columns are ignored, whatever their names; an empty table has no parts and gives no rows.
    """
    seen = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    seen = seen.agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = failures(docs, part, id_col, text_col).join(seen, "doc_id", "left").na.fill(0, ["good", "toxic"])
    return every_order(joint_counts(rows, FILTERS, ("good", "toxic")), FILTERS, ("good", "toxic"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part,
    concat(CASE WHEN len(words) < 200 THEN 'A' END,
           CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
           CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
           CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
           CASE WHEN doc_id > least THEN 'E' END) AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
p AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[:step - 1] AS done FROM o, range(1, 6) r(step)),
j AS (SELECT *, contains(fails, letter) AS hit, len(translate(done, fails, '')) < len(done) AS gone FROM p, s)
SELECT part, filter_order, step::INT AS step,
    coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost,
    (sum(coalesce(sum(n) FILTER (hit AND NOT gone), 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM j GROUP BY part, filter_order, step, letter
"""
