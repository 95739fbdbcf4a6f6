"""Device files as a Spark source: ``spark.read.format("device_files")``.

A device's recordings are Parquet files, or JSON files of one record a line, and every stream that is
declared for the device has the files' times. The source cuts them into pieces, a row group of a
Parquet file or a whole JSON file for each stream, which Spark reads in parallel. Conditions on the
time and the stream, the columns of the schema and the limit are applied where a piece is planned or
read: row groups whose statistics lie outside the range, or which come after the limit, are never opened.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Columns that the source makes; any other name of a schema is a column of the files.
MADE = ("device_id", "stream_id", "t_device_us", "seq", "payload_ref")
SCHEMA = "device_id string, stream_id string, t_device_us bigint, seq bigint, payload_ref string"
_JSON_ROWS = 20_000


@dataclass
class Piece(InputPartition):
    """Rows of some files for one stream; ``base`` numbers the first, ``limit`` says how many count."""

    paths: list[str]
    stream: str
    base: int | None
    group: int | None
    limit: int | None


def _whole_us(values: pa.Array, epoch_us: int) -> pa.Array:
    """Times as whole microseconds since the epoch."""
    if pa.types.is_timestamp(values.type):
        values = values.cast(pa.timestamp("us", values.type.tz)).cast(pa.int64())
    return pc.subtract(values.cast(pa.int64(), safe=False), epoch_us)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.device = options["path"], options.get("device", "")
        self.streams = [s.strip() for s in options.get("streams", "").split(",") if s.strip()]
        self.time, self.epoch = options.get("timecolumn", "t_master_us"), int(options.get("epochus", 0))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.base = options.get("base", self.path)
        if not self.device or not self.streams or self.limit is not None and self.limit < 0:
            raise ValueError("device and streams must be given, and a limit must not be negative")
        self.schema = to_arrow_schema(schema)
        self.low, self.high = None, None

    def pushFilters(self, filters):
        """Takes over ranges of time and choices of streams; what it leaves, Spark applies."""
        for f in filters:
            if f.attribute == ("t_device_us",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    low = f.value + isinstance(f, GreaterThan)
                    self.low = low if self.low is None else max(self.low, low)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    high = f.value - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(self.high, high)
            elif f.attribute == ("stream_id",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.streams = [s for s in self.streams if s in wanted]
            else:
                yield f

    def partitions(self) -> list[Piece]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pyarrow.fs.LocalFileSystem(), self.path)
        found = fs.get_file_info(root)
        if found.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if found.type == pyarrow.fs.FileType.Directory:
            files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.type == pyarrow.fs.FileType.File and not f.base_name.startswith(("_", ".")))
        else:
            files = [root]
        lines = [f for f in files if f.endswith((".json", ".jsonl"))]
        pieces: list[tuple] = []
        if lines:  # numbers are the records' own; only a limit needs them read in order
            pieces += [(lines, None, None, self.limit)] if self.limit is not None else [([f], None, None, None) for f in lines]
        base = 0
        for f in (f for f in files if f not in set(lines)):
            with fs.open_input_file(f) as source:
                meta = pq.ParquetFile(source).metadata
            column = meta.schema.to_arrow_schema().get_field_index(self.time)
            if column < 0:
                raise ValueError(f"{f} has no column {self.time!r}")
            for g in range(meta.num_row_groups):
                rows = meta.row_group(g).num_rows
                left = None if self.limit is None else self.limit - base
                if (left is None or left > 0) and self._may_hold(meta, g, column):
                    pieces.append(([f], base, g, left))
                base += rows
        return [Piece(paths, s, b, g, n) for s in self.streams for paths, b, g, n in pieces] or [Piece([], "", None, None, 0)]

    def _may_hold(self, meta, group: int, column: int) -> bool:
        stats = next((c.statistics for c in map(meta.row_group(group).column, range(meta.num_columns)) if c.path_in_schema == self.time), None)
        if stats is None or not stats.has_min_max or self.low is None and self.high is None:
            return True
        kind = meta.schema.to_arrow_schema().field(column).type
        least, most = _whole_us(pa.array([stats.min, stats.max], kind), self.epoch).to_pylist()
        return (self.low is None or most >= self.low) and (self.high is None or least <= self.high)

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        extra = [n for n in self.schema.names if n not in MADE]
        for rows, seq in self._rows(piece, extra):
            t = _whole_us(rows[self.time], self.epoch)
            ref = pc.binary_join_element_wise(f"{self.base}#stream={piece.stream}&row=", seq.cast(pa.string()), "")
            made = {"device_id": pa.repeat(self.device, len(t)), "stream_id": pa.repeat(piece.stream, len(t)), "t_device_us": t, "seq": seq, "payload_ref": ref}
            columns = [(made[f.name] if f.name in MADE else rows[f.name]).cast(f.type) for f in self.schema]
            keep = pa.repeat(True, len(t))
            if self.low is not None:
                keep = pc.and_(keep, pc.greater_equal(t, self.low))
            if self.high is not None:
                keep = pc.and_(keep, pc.less_equal(t, self.high))
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema).filter(keep)

    def _rows(self, piece: Piece, extra: list[str]) -> Iterator[tuple[dict, pa.Array]]:
        """(columns, numbers) batch by batch, no more rows than the piece's limit."""
        fs = pyarrow.fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pyarrow.fs.LocalFileSystem()
        left = piece.limit
        for path in piece.paths:
            with fs.open_input_file(path) as source:
                base = piece.base
                for rows in self._parquet(source, piece.group, extra) if piece.group is not None else self._lines(source, extra):
                    n = len(rows[self.time]) if left is None else min(left, len(rows[self.time]))
                    rows = {k: v.slice(0, n) for k, v in rows.items()}
                    left = None if left is None else left - n
                    if n:
                        yield rows, pa.array(range(base, base + n), pa.int64()) if base is not None else rows["seq"].cast(pa.int64())
                    base = None if base is None else base + n
                    if left == 0:
                        return

    def _parquet(self, source, group: int, extra: list[str]) -> Iterator[dict]:
        for b in pq.ParquetFile(source).iter_batches(row_groups=[group], columns=list(dict.fromkeys([self.time, *extra]))):
            yield {n: b.column(n) for n in b.schema.names}

    def _lines(self, source, extra: list[str]) -> Iterator[dict]:
        names = list(dict.fromkeys([self.time, "seq", *extra]))

        def batch(records: list[dict]) -> dict:
            return {n: pa.array([r.get(n) for r in records], self.schema.field(n).type if n in extra else pa.int64()) for n in names}

        held: list[dict] = []
        for line in io.TextIOWrapper(source, "utf-8"):
            if line.strip():
                held.append(json.loads(line))
                if len(held) == _JSON_ROWS:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)


class DeviceFiles(DataSource):
    """``device_id, stream_id, t_device_us, seq, payload_ref``, and columns of the files that a schema names.

    Options: ``path`` (a file or folder), ``device``, ``streams`` (names, by comma), ``timeColumn``
    (numbers of microseconds or timestamps), ``epochUs`` (taken off the times), ``base`` (of the
    addresses; the path without it) and ``limit`` (the first samples of each stream). Rows of Parquet
    files are numbered from 0 in the order of files and rows; records of JSON files have their own
    ``seq``, or none, and a limit counts them in that order too. Rows without a time pass unless a
    range is asked for; empty files and folders have no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "device_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()}, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take over conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DeviceFiles)
