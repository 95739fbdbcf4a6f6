"""Sources and sinks: timestamp streams, manifests and result bundles.

Tables are read and written by Spark; manifests and settings, which are small, by the driver. YAML
needs ``pyyaml`` and says so if it is missing; JSON is always there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.metrics import Gates
from ..operators.ordered import ROWS, numbered

BUNDLE_FORMAT, BUNDLE_VERSION = "tidemark-bundle", 2


def timestamps_from_parquet(spark: SparkSession, path: str, device_id: str, streams: list[str], ts_column: str = "t_master_us", base: str | None = None) -> DataFrame:
    """``device_id, stream_id, t_device_us, seq, payload_ref``: every declared stream has the file's times.

    Only the one column is scanned. Rows number in file order by file and row within it; the number
    is made from per-file counts, so no task holds all rows.
    """
    raw = spark.read.parquet(path).select(F.col(ts_column).cast("long").alias("t_device_us"), F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"))
    counts = raw.groupBy("__f").agg(F.count("*").alias("__n"))
    before = counts.select("__f", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rows = raw.join(before, "__f").select("t_device_us", (F.col("__before") + F.col("__r")).alias("seq"))
    rows = rows.withColumn("stream_id", F.explode(F.array(*map(F.lit, streams)))).withColumn("device_id", F.lit(device_id))
    ref = F.format_string("%s#stream=%s&row=%d", F.lit(base or path), F.col("stream_id"), F.col("seq"))
    return rows.select("device_id", "stream_id", "t_device_us", "seq", ref.alias("payload_ref"))


def samples_from_times(times: DataFrame, streams: DataFrame, base: str, pos: str = "pos") -> DataFrame:
    """``device_id, stream_id, t_device_us, seq, payload_ref`` of ``times(device_id, stream_id, pos, t_device_us)``.

    ``seq`` numbers a stream's rows from 0 in the order of ``pos``, and the address is ``base`` with
    the stream and row as its fragment. Only streams declared in ``streams(device_id, stream_id)`` may
    have times (a stream without times has no samples); ``base`` is an address of a registered scheme
    without a fragment.
    """
    from ..functions.scalars import allowed_schemes

    scheme, parted, place = base.partition("://")
    if not (parted and place and scheme in allowed_schemes()) or "#" in base:
        raise ValueError(f"not an address of a registered scheme without a fragment: {base!r}")
    keys = ["device_id", "stream_id"]
    odd = times.join(streams, keys, "left_anti").select(*keys).first()
    if odd:
        raise ValueError(f"stream {odd['stream_id']!r} of device {odd['device_id']!r} is not declared")
    rows = numbered(times.select(*keys, pos, F.col("t_device_us").cast("long").alias("t_device_us")), keys, pos, [], ROWS, "seq")
    ref = F.format_string("%s#stream=%s&row=%d", F.lit(base), F.col("stream_id"), F.col("seq"))
    return rows.select(*keys, "t_device_us", "seq", ref.alias("payload_ref"))


def topology_of(path: str) -> dict[str, str | None]:
    """``topology_ref`` and ``topology_hash`` from a Parquet file's key-value metadata, where they are.

    Either a JSON entry with descriptor_version and descriptor_hash, or two plain entries. A JSON
    entry that cannot be read is passed over.
    """
    import pyarrow.parquet as pq

    meta = {k.decode(): v.decode() for k, v in (pq.read_schema(path).metadata or {}).items()}
    found: dict = {}
    for v in meta.values():
        try:
            x = json.loads(v)
        except ValueError:
            continue
        if isinstance(x, dict) and "descriptor_hash" in x:
            found = x
    get = lambda k: found.get(k) or meta.get(k)
    return {"topology_ref": get("descriptor_version"), "topology_hash": get("descriptor_hash")}


def limit_per_stream(samples: DataFrame, keys: list[str], n: int, order: str = "seq") -> DataFrame:
    """The first ``n`` samples of each stream: what a bounded read of a device gives."""
    return samples.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("__k") <= n).drop("__k")


def ingest(parts: list[DataFrame]) -> DataFrame:
    """One table of samples from the devices' own."""
    if not parts:
        raise ValueError("no devices")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def load_mapping(path: str) -> dict:
    """A JSON or YAML file that holds a mapping; an empty file is an empty one."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs pyyaml") from e
        data = yaml.safe_load(text) or {}
    else:
        data = json.loads(text) if text.strip() else {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return data


def save_mapping(data: dict, path: str) -> None:
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("writing YAML needs pyyaml") from e
        text = yaml.safe_dump(data, sort_keys=False)
    elif path.endswith(".json"):
        text = json.dumps(data, indent=2)
    else:
        raise ValueError(f"unknown kind of manifest: {path}")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)


@dataclass(frozen=True)
class ReferenceConfig:
    """Policy of a run."""

    policy: str = "designated_anchor"
    grid_rate_hz: float = 1600.0
    rejection_tolerance_us: int = 1875
    gates: Gates = field(default_factory=Gates)

    def __post_init__(self):
        if self.policy != "designated_anchor":
            raise ValueError("only the policy designated_anchor is known")
        if self.grid_rate_hz <= 0 or self.rejection_tolerance_us <= 0:
            raise ValueError("rate and tolerance must be positive")

    @classmethod
    def load(cls, path: str) -> ReferenceConfig:
        data = load_mapping(path)
        gates = Gates(**data.pop("gates", {}))
        return cls(**data, gates=gates)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a bundle, in order: those whose manifest was written to its end."""
    p, fs = _fs(spark, f"{path}/_commits")
    if not fs.exists(p):
        return []
    found = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().isdigit()]
    return sorted(int(f.getName()) for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def save_bundle(tables: dict[str, DataFrame], path: str, info: dict | None = None, sessions: DataFrame | None = None) -> int:
    """One Parquet table per name under ``path``, the sessions' manifests, and a manifest of all that; the version's number.

    Every save is a version of its own, in new folders, and its manifest is written last: what breaks
    off before leaves no version behind, and earlier ones stay whole (tables may be made from what
    they hold). ``sessions`` are rows as ``load_sessions`` gives them; they are kept as documents, so
    what they hold comes back whatever the columns' types become. Saves of one path must not overlap.
    """
    from .sessions import to_json

    spark = next(iter(tables.values())).sparkSession
    version = max(_commits(spark, path), default=0) + 1
    folder = f"v{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    if sessions is not None:
        to_json(sessions).select("value").write.text(f"{path}/{folder}/_sessions")
    manifest = {"format": BUNDLE_FORMAT, "format_version": BUNDLE_VERSION, "folder": folder, "tables": sorted(tables), "sessions": sessions is not None, "info": info or {}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_commits/{version:08d}")
    return version


def _manifest(spark: SparkSession, path: str, version: int | None) -> dict:
    known = _commits(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no bundle{'' if version is None else f' of version {version}'}: {path}")
    manifest = json.loads(spark.read.text(f"{path}/_commits/{version or known[-1]:08d}").first()["value"])
    if (manifest.get("format"), manifest.get("format_version")) != (BUNDLE_FORMAT, BUNDLE_VERSION):
        raise ValueError(f"not a bundle of format {BUNDLE_VERSION}: {path}")
    return manifest


def load_bundle(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict[str, DataFrame], dict]:
    """(tables, info) of the last complete version that ``save_bundle`` wrote, or of the one asked for; another format is refused."""
    manifest = _manifest(spark, path, version)
    return {n: spark.read.parquet(f"{path}/{manifest['folder']}/{n}") for n in manifest["tables"]}, manifest["info"]


def load_bundle_sessions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The sessions that a bundle keeps, as ``load_sessions`` gives them; none if it was saved without."""
    from .sessions import from_json

    manifest = _manifest(spark, path, version)
    return from_json(spark.read.text(f"{path}/{manifest['folder']}/_sessions")) if manifest["sessions"] else None


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the last ``keep`` complete versions of a bundle, and what broken saves left."""
    if keep < 1:
        raise ValueError("one version must stay")
    known = _commits(spark, path)
    kept = {_manifest(spark, path, v)["folder"] for v in known[-keep:]}
    for v in known[:-keep]:
        p, fs = _fs(spark, f"{path}/_commits/{v:08d}")
        fs.delete(p, True)
    p, fs = _fs(spark, path)
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if name.startswith("v") and name not in kept:
            fs.delete(f.getPath(), True)


def config_dict(config: ReferenceConfig) -> dict:
    return asdict(config)
