"""Association of detections of one physical event across devices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed
from .ordered import TIME_US, before, carried, cut, inside, numbered, previous


def match_by_order(detections: DataFrame, keys: list[str], device: str = "device_id", t: str = "t_local_us", width: float = TIME_US) -> DataFrame:
    """``keys, event_no, device_id, t_local_us``: the k-th detection of every device is event k.

    Sessions of fewer than two devices, or whose devices have unequal counts, give no rows (see
    ``unmatchable``).
    """
    bad = unmatchable(detections, keys, device)
    good = detections.join(bad.select(*keys), keys, "left_anti").select(*keys, device, t)
    return numbered(good, [*keys, device], t, [], width, "event_no").select(*keys, "event_no", device, t)


def observers(events: DataFrame, keys: list[str], event: str = "event_id", device: str = "device_id") -> DataFrame:
    """``keys, event, device_ids, usable``: who saw an event; two devices make it usable for fitting. Devices bound the sets."""
    per = events.groupBy(*keys, event).agg(F.array_sort(F.collect_set(device)).alias("device_ids"))
    return per.withColumn("usable", F.size("device_ids") >= 2)


def unmatchable(detections: DataFrame, keys: list[str], device: str = "device_id") -> DataFrame:
    """Sessions that ``match_by_order`` refuses: ``keys, devices, least, most`` detections of a device."""
    per = detections.groupBy(*keys, device).agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.count("*").alias("devices"), F.min("n").alias("least"), F.max("n").alias("most")).where("devices < 2 or least < most")


def associate(detections: DataFrame, keys: list[str], tolerance_us: float, coarse: DataFrame | None = None, min_observers: int = 2, device: str = "device_id", t: str = "t_local_us", width: float = TIME_US) -> DataFrame:
    """``keys, event_no, device_id, t_local_us``: subset-aware association by greedy centroid clustering.

    Local times go to a coarse common time (``coarse(keys or device, alpha, beta_us)``, identity
    without). In its order a detection joins the last cluster if it lies within the tolerance of the
    running mean; a device that is in the cluster already replaces its detection if the new one is
    strictly nearer, without moving the mean, and is swallowed otherwise. Clusters of fewer than
    ``min_observers`` devices go.

    A gap of more than the tolerance always opens a cluster, since the mean never lies behind the last
    member. So the order is first cut into islands at such gaps, by buckets of time; islands are dealt
    out, and a task reads its islands in order and holds the last cluster alone, so an island of any
    length costs no memory. Detections without a time are left out.
    """
    if tolerance_us <= 0:
        raise ValueError("tolerance_us must be positive")
    rows = detections.where(F.col(t).isNotNull()).select(*keys, F.col(device).alias("device_id"), F.col(t).cast("long").alias("t_local_us"))
    if coarse is not None:
        on = [c for c in [*keys, "device_id"] if c in coarse.columns]
        rows = rows.join(coarse.select(*on, "alpha", "beta_us"), on, "left").withColumn("ct", F.coalesce("alpha", F.lit(1.0)) * F.col("t_local_us") + F.coalesce("beta_us", F.lit(0.0))).drop("alpha", "beta_us")
    else:
        rows = rows.withColumn("ct", F.col("t_local_us").cast("double"))
    ties = ["device_id", "t_local_us"]
    rows = checkpointed(previous(rows, keys, "ct", {"__p": "ct"}, width, ties))
    rows = cut(rows.withColumn("__new", F.when(F.coalesce(F.col("ct") - F.col("__p") > tolerance_us, F.lit(True)), F.col("ct"))), "ct", width)
    rows = carried(rows, keys, {"__n": F.max("__new")}, {"__open": F.max("__n").over(before(keys))})
    island = F.coalesce(F.max("__new").over(inside(keys, "ct", *ties).rowsBetween(Window.unboundedPreceding, 0)), F.col("__open"))
    dealt = rows.withColumn("__island", island).select(*keys, "__island", "ct", "device_id", "t_local_us").repartition(*keys, "__island").sortWithinPartitions(*keys, "__island", "ct", *ties)
    folded = checkpointed(dealt.mapInArrow(_clusters(keys, tolerance_us, min_observers), _fields(dealt, [*keys, "device_id", "t_local_us"]) + ", __at double, __lead boolean"))
    numbers = numbered(folded.where("__lead").select(*keys, "__at"), keys, "__at", [], width, "event_no")
    return folded.join(numbers, [*keys, "__at"]).select(*keys, "event_no", F.col("device_id").alias(device), F.col("t_local_us").alias(t))


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _clusters(keys: list[str], tolerance_us: float, min_observers: int):
    """The scan over sorted islands: members of each closed cluster, with the cluster's first time; the first row leads.

    Most islands are one cluster: every device once, and each member well within the tolerance of the
    mean before it. Those are told apart and written by whole arrays. The others, and the first and
    last island of a batch, which may go on in its neighbours, are scanned row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "device_id", "t_local_us", "__at", "__lead"]
        open_, members, total, n, at, types = None, {}, 0.0, 0, 0.0, None

        def close(out: list) -> None:
            if open_ is not None and len(members) >= min_observers:
                out += [(*open_[:-1], d, t, at, k == 0) for k, (d, (_, t)) in enumerate(members.items())]

        def batch(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), types, strict=True)], names)

        for b in batches:
            types = [*(b.schema.field(k).type for k in (*keys, "device_id", "t_local_us")), pa.float64(), pa.bool_()]
            if not b.num_rows:
                continue
            start, size, plain = _islands(b, keys, tolerance_us)
            first = [b.column(c)[0].as_py() for c in (*keys, "__island")]
            plain[-1] = False
            if first == open_:
                plain[0] = False
            whole = np.repeat(plain & (size >= min_observers), size)
            if whole.any():
                ct, rows = b.column("ct").to_numpy(zero_copy_only=False), pa.array(np.flatnonzero(whole))
                lead = np.zeros(b.num_rows, dtype=bool)
                lead[start] = True
                found = [b.column(c).take(rows) for c in (*keys, "device_id", "t_local_us")]
                yield pa.RecordBatch.from_arrays([*found, pa.array(np.repeat(ct[start], size)[whole]), pa.array(lead[whole])], names)
            rest = pa.array(np.flatnonzero(np.repeat(~plain, size)))
            out: list = []
            for *head, ct, d, t in zip(*(b.column(c).take(rest).to_pylist() for c in (*keys, "__island", "ct", "device_id", "t_local_us")), strict=True):
                centre = total / n if n else 0.0
                if head != open_ or abs(ct - centre) > tolerance_us:
                    close(out)
                    open_, members, total, n, at = head, {d: (ct, t)}, ct, 1, ct
                elif d not in members:
                    members[d] = ct, t
                    total, n = total + ct, n + 1
                elif abs(ct - centre) < abs(members[d][0] - centre):
                    del members[d]
                    members[d] = ct, t
            if out:
                yield batch(out)
        out = []
        close(out)
        if out:
            yield batch(out)

    return run


def _islands(b: pa.RecordBatch, keys: list[str], tolerance_us: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, rows, whether it is one cluster for certain) of each island of a sorted batch."""
    new = np.zeros(b.num_rows, dtype=bool)
    new[0] = True
    for c in (*keys, "__island"):
        codes = b.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, b.num_rows))
    island = np.cumsum(new) - 1
    place = np.arange(b.num_rows) - start[island]
    ct = b.column("ct").to_numpy(zero_copy_only=False)
    off = ct - ct[start][island]
    before_ = np.cumsum(off) - off
    mean = (before_ - before_[start][island]) / np.maximum(place, 1)
    # some room, since this sum is not rounded as the scan's is
    far = (place > 0) & ~(np.abs(off - mean) <= tolerance_us * (1 - 1e-9) - 1e-3)
    device = b.column("device_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.lexsort((device, island))
    again = np.zeros(b.num_rows, dtype=bool)
    again[1:] = (device[order][1:] == device[order][:-1]) & (island[order][1:] == island[order][:-1])
    bad = np.bincount(island, weights=far, minlength=len(start)) + np.bincount(island[order], weights=again, minlength=len(start))
    return start, size, bad == 0
