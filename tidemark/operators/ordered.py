"""Order within long sequences, without a task that holds a whole one.

A sequence is cut into buckets of its order column. Inside a bucket a window runs over the bucket's
rows; what a bucket needs from those before it is one summary row per bucket, carried over by a
window over these. One session, device or stream may thus hold any share of all rows. Order columns
must not be null; key columns are compared by equality, so rows with a null key are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Rows of a sequence number, and microseconds of a time, that share a bucket.
ROWS, TIME_US = 1 << 16, 3_600_000_000


def cut(df: DataFrame, order: str, width: float) -> DataFrame:
    """``df`` with its bucket ``__b``."""
    return df.withColumn("__b", F.floor(F.col(order) / width).cast("long"))


def inside(keys: list[str], *order) -> WindowSpec:
    """The window over one bucket."""
    return Window.partitionBy(*keys, "__b").orderBy(*order)


def before(keys: list[str]) -> WindowSpec:
    """The window over the summaries of all buckets before one."""
    return Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, keys: list[str], sums: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns ``carry``, made by windows ``before`` over per-bucket aggregates ``sums``."""
    per = rows.groupBy(*keys, "__b").agg(*[c.alias(n) for n, c in sums.items()])
    return rows.join(per.select(*keys, "__b", *[c.alias(n) for n, c in carry.items()]), [*keys, "__b"])


def numbered(df: DataFrame, keys: list[str], order: str, ties: list, width: float, name: str) -> DataFrame:
    """``df`` with ``name``: each row's number from 0 in the order of ``order`` and then ``ties``."""
    rows = cut(df, order, width)
    rows = carried(rows, keys, {"__n": F.count("*")}, {"__base": F.coalesce(F.sum("__n").over(before(keys)), F.lit(0))})
    return rows.withColumn(name, (F.col("__base") + F.row_number().over(inside(keys, order, *ties)) - 1).cast("long")).drop("__b", "__base")


def previous(df: DataFrame, keys: list[str], order: str, columns: dict[str, str], width: float, ties: list = ()) -> DataFrame:
    """``df`` with, for each (new name, column), the column's value in the row before; null in the first row."""
    rows = cut(df, order, width)
    last = F.max_by(F.struct(*columns.values()), F.struct(order, *ties))
    rows = carried(rows, keys, {"__last": last}, {"__before": F.max_by("__last", "__b").over(before(keys))})
    w = inside(keys, order, *ties)
    first = F.row_number().over(w) == 1
    out = rows.withColumn("__prev", F.when(first, F.col("__before")).otherwise(F.lag(F.struct(*columns.values())).over(w)))
    return out.select(*df.columns, *[F.col("__prev")[c].alias(n) for n, c in columns.items()])
