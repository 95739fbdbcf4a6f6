"""Shared helpers: durable intermediate tables, row keys and distributed connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words everywhere in this package: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c):
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, _UPPER, _LOWER)


def named(c: str):
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + c.replace("`", "``") + "`")


def whole_row(docs: DataFrame):
    """Each row of ``docs`` as one struct."""
    return F.struct(*[named(c).alias(c) for c in docs.columns])


def row_hash(docs: DataFrame):
    """A hash of all columns of a row; maps count as their entries."""
    return F.xxhash64(*[F.map_entries(named(f.name)) if f.dataType.typeName() == "map" else named(f.name) for f in docs.schema.fields])


#: Arrow types of the columns that ``map_texts`` makes.
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "byte": pa.int8()}


def slices(texts: list, characters: int, rows: int = 4000) -> Iterator[slice]:
    """Slices of whole texts of about so many characters, and so many rows at most; one text at least."""
    return _cut([len(t) if t else 0 for t in texts], characters, rows)


def _cut(lengths: list[int], characters: int, rows: int) -> Iterator[slice]:
    a = held = 0
    for k, n in enumerate(lengths):
        n += 1
        if k > a and (held + n > characters or k - a >= rows):
            yield slice(a, k)
            a, held = k, 0
        held += n
    if a < len(lengths):
        yield slice(a, len(lengths))


def map_texts(df: DataFrame, make: Callable[[list], dict], new: str, text: str = "text", characters: int = 1 << 20, rows: int = 4000, end: Callable[[], None] | None = None) -> DataFrame:
    """The columns of ``df`` but the text (or bytes) ``text``, and the columns ``new`` that ``make(texts)`` gives.

    ``make`` gets whole texts, about ``characters`` bytes of them in all, so what Python holds does not depend on
    the size of Arrow's batches; ``end`` is called when a task has read its last. The other columns
    pass through as Arrow arrays: large and null ids keep their values.
    """
    passed = [f for f in df.schema.fields if f.name != text]
    made = [tuple(x.split()) for x in new.split(", ")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in passed), *(" ".join(x) for x in made)])
    names, types = [*(f.name for f in passed), *(n for n, _ in made)], [_TYPES[t] for _, t in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(text)
            # bytes of each, so that no more of a batch than one slice becomes Python's strings
            for at in _cut(pc.fill_null(pc.binary_length(whole), 0).to_pylist(), characters, rows):
                found = make(whole.slice(at.start, at.stop - at.start).to_pylist())
                kept = [b.column(f.name).slice(at.start, at.stop - at.start) for f in passed]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[n], t) for (n, _), t in zip(made, types, strict=True))], names)
        if end:
            end()

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests) a temporary folder takes its place, one for the
    session; on a cluster an unset folder is an error, since no local folder is shared there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _local.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="tidemark-")
        _local[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


_local: dict[str, str] = {}


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``durable`` wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def durable(df: DataFrame, keep: bool = True, options: dict | None = None) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage: what reads the result never recomputes ``df``, and an executor that is lost
    takes none of it along. ``options`` are the writer's. ``keep=False`` leaves deletion to the caller (path in ``_tidemark_path``);
    otherwise the table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    if keep:
        atexit.register(_forget, spark, path)
    return out


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_table(spark, path)
    except Exception:  # the JVM may have ended before
        pass


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph, by alternating large-star and small-star rounds.

    ``edges(src, dst)`` of one orderable type; null ends and loops are ignored. Returns
    ``(node, component)`` for every node that has an edge, ``component`` being the least node
    reachable. Each round is a few aggregations and equi-joins whose hot nodes are pre-aggregated
    (minimum per node) or split by adaptive skew joins; no adjacency list is ever gathered. Rounds
    grow with the logarithm of the longest path, each is written to the shared folder, and the loop
    ends when a round leaves the edge set as it was. An empty graph gives an empty result.
    """
    spark = edges.sparkSession
    cur = durable(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        keep=False,
    )
    size = cur.count()
    while size:
        # Large star: every larger neighbour of a node hangs on the node's least neighbour.
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # Small star: every smaller neighbour, and the node itself, hang on the least of them.
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            big.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.withColumnRenamed("m", "v"))
            .distinct()
        )
        new, before = durable(small, keep=False), size
        size = new.count()
        done = size == before and new.join(cur, ["u", "v"], "left_anti").isEmpty()  # the same edges: nothing will change
        drop_table(spark, cur._tidemark_path)
        cur = new
        if done:
            break
    atexit.register(_forget, spark, cur._tidemark_path)
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
