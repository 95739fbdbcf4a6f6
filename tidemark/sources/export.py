"""Timelines as files: shards of bounded size per session and hour, in order, and a record of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

HOUR_US, SHARD_ROWS = 3_600_000_000, 1_000_000
FORMAT = "parquet"


def export_timeline(aligned: DataFrame, path: str, stream: list[str] = ("device_id", "stream_id"), shard_rows: int = SHARD_ROWS, shards: int | None = None, consumer_hint: str | None = None, hours: int = 1) -> DataFrame:
    """Write ``aligned(session_id, stream, grid_idx, t_us, ...)``; ``session_id, format, uri, produced_at, frame_count, sample_count, consumer_hint``.

    Folders are ``session=.../hour=...`` (hours from the session's zero, ``hours`` of them each), files
    hold at most ``shard_rows`` rows, and rows stand in order of time and stream within a folder's files, whose
    names follow that order. Rows are dealt out by ranges of that order, so a session of any size is
    shared out. The rows are counted by the job that writes them, and what is read back must be as
    many. ``frame_count`` is the number of a session's grid points, ``sample_count`` that of its valid
    rows. An export must not exist yet; an empty timeline leaves an empty record.
    """
    order = ["session", "hour", "t_us", *stream]
    rows = aligned.withColumn("session", F.col("session_id").cast("string")).withColumn("hour", (F.floor(F.col("t_us") / (hours * HOUR_US)) * hours).cast("long"))
    seen = Observation("export")
    dealt = rows.repartitionByRange(*([shards] if shards else []), *order).sortWithinPartitions(*order)
    # counted behind the exchange, since dealing out by ranges reads a sample of what is before it
    dealt.observe(seen, F.count("*").alias("rows"), F.count_if("valid").alias("valid")).write.partitionBy("session", "hour").option("maxRecordsPerFile", shard_rows).parquet(f"{path}/data")
    spark = aligned.sparkSession
    if not seen.get["rows"]:
        return spark.createDataFrame([], f"session_id {aligned.schema['session_id'].dataType.simpleString()}, {_RECORD}")
    back = read_timeline(spark, path)
    per = back.groupBy("session_id").agg(F.count("*").alias("rows"), F.count_if("valid").alias("sample_count"), (F.max("grid_idx") + 1).alias("frame_count"))
    found = per.agg(F.sum("rows").alias("rows"), F.sum("sample_count").alias("valid")).first()
    if (found["rows"], found["valid"]) != (seen.get["rows"], seen.get["valid"]):
        raise RuntimeError(f"{path} holds {found['rows']} rows, {seen.get['rows']} were written")
    uri = F.concat(F.lit(f"{path}/data/session="), F.col("session_id").cast("string"))
    record = per.select("session_id", F.lit(FORMAT).alias("format"), uri.alias("uri"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("produced_at"), "frame_count", "sample_count", F.lit(consumer_hint).cast("string").alias("consumer_hint"))
    record.write.parquet(f"{path}/record")
    return spark.read.parquet(f"{path}/record")


_RECORD = "format string, uri string, produced_at string, frame_count bigint, sample_count bigint, consumer_hint string"


def read_timeline(spark, path: str) -> DataFrame:
    """What ``export_timeline`` wrote; conditions on ``session`` and ``hour`` choose folders."""
    return spark.read.parquet(f"{path}/data")


def exports_of(record: DataFrame) -> DataFrame:
    """``session_id, exports``: the records as a session's manifest nests them."""
    one = F.struct("format", "uri", "produced_at", F.col("frame_count").cast("long").alias("frame_count"), F.col("sample_count").cast("long").alias("sample_count"), "consumer_hint")
    return record.groupBy("session_id").agg(F.array_sort(F.collect_list(one)).alias("exports"))
