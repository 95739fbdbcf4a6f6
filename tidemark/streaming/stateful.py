"""Association and as-of joins over streams, with the results of their batch forms.

Rows of a group may come in any order within the lateness that the watermark grants. They wait in
state until the watermark has passed them, and are then taken in order of time; rows that come later
still are dropped. What the order needs to go on (the open cluster, the last sample, the points that
wait for a sample) is state too, so a query that stops and restarts from its checkpoint loses nothing.
A session's state is bounded by what arrives within the lateness, and by the points that wait.

Both need the RocksDB state store: see ``use_rocksdb``. Times count from each session's own zero, as
everywhere; the watermark sees them ``SHIFT_US`` later, so that the first instant is not late. Times
before minus one second are late from the start.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.timeline import CONTINUOUS, HOLD

SHIFT_US = 1_000_000


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors work with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_time(us: Column) -> Column:
    """Microseconds as the watermark sees them."""
    return F.timestamp_micros(F.floor(us).cast("long") + SHIFT_US)


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, and hands them on in order of their columns.

    The first column of ``fields`` is the time in microseconds. A subclass opens its own state in
    ``open``, takes rows in ``take`` and says in ``passed`` what happens once all rows up to the
    watermark are taken: both give result rows, ``passed`` also the next time to be called at, or none.
    """

    def __init__(self, keys: list[str], fields: str, result: str):
        self.keys, self.fields, self.columns = keys, fields, [*keys, *(x.split()[0] for x in result.split(", "))]
        self.names = [x.split()[0] for x in fields.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.timer = handle.getValueState("timer", "ms long")
        self.open()

    def open(self) -> None:
        raise NotImplementedError

    def take(self, rows: Iterator[tuple]) -> list[tuple]:
        raise NotImplementedError

    def passed(self, upto_us: int) -> tuple[list[tuple], float | None]:
        raise NotImplementedError

    def _wake(self, us: float | None) -> None:
        """One timer a group, at the earliest time that anything can be done."""
        old = self.timer.get() if self.timer.exists() else None
        new = None if us is None else max(1, int(-(-(us + SHIFT_US) // 1000)) + 1)
        if old and new != old[0]:
            self.handle.deleteTimer(old[0])
        if new is None:
            self.timer.clear()
        elif not old or new != old[0]:
            self.handle.registerTimer(new)
            self.timer.update((new,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for b in rows:
            new = list(zip(*(b[n].astype(object).where(b[n].notna(), None).tolist() for n in self.names), strict=True))
            if new:
                self.waiting.appendList(new)
                least = min(r[0] for r in new)
                earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            old = self.timer.get() if self.timer.exists() else None
            if not old or (earliest + SHIFT_US) / 1000 < old[0]:
                self._wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000 - SHIFT_US
        self.timer.clear()
        due, later = [], []
        for r in self.waiting.get() if self.waiting.exists() else ():
            (due if r[0] < upto + 1 else later).append(tuple(r))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        heapq.heapify(due)
        out = self.take(heapq.heappop(due) for _ in range(len(due)))
        more, again = self.passed(upto)
        self._wake(min([r[0] for r in later] + [again] * (again is not None), default=None))
        if out or more:
            yield pd.DataFrame([(*key, *r) for r in [*out, *more]], columns=self.columns)

    def close(self) -> None:
        pass


class _Association(InOrder):
    def __init__(self, keys: list[str], tolerance_us: float, min_observers: int):
        super().__init__(keys, "ct double, device string, t_local_us bigint", "event_no bigint, device_id string, t_local_us bigint")
        self.tolerance, self.least = tolerance_us, min_observers

    def open(self) -> None:
        # the open cluster: sum and number of the times that moved its mean, and its members
        self.mean = self.handle.getValueState("mean", "total double, n long")
        self.members = self.handle.getListState("members", "device string, ct double, t_local_us long")
        self.count = self.handle.getValueState("count", "n long")

    def _load(self) -> tuple[float, int, dict]:
        total, n = self.mean.get() if self.mean.exists() else (0.0, 0)
        return total, n, {d: (ct, t) for d, ct, t in self.members.get()} if n else {}

    def _closed(self, members: dict) -> list[tuple]:
        if len(members) < self.least:
            return []
        no = self.count.get()[0] if self.count.exists() else 0
        self.count.update((no + 1,))
        return [(no, d, t) for d, (_, t) in members.items()]

    def take(self, rows: Iterator[tuple]) -> list[tuple]:
        (total, n, members), out, touched = self._load(), [], False
        for ct, device, t in rows:
            touched = True
            if not n or abs(ct - total / n) > self.tolerance:
                out += self._closed(members)
                total, n, members = ct, 1, {device: (ct, t)}
            elif device not in members:
                total, n = total + ct, n + 1
                members[device] = ct, t
            elif abs(ct - total / n) < abs(members[device][0] - total / n):
                members[device] = ct, t
        if touched:
            self.mean.update((total, n))
            self.members.put([(d, ct, t) for d, (ct, t) in members.items()])
        return out

    def passed(self, upto_us: int) -> tuple[list[tuple], float | None]:
        """A cluster is closed once no row that may still come can lie within the tolerance of its mean."""
        total, n, members = self._load()
        if not n:
            return [], None
        if upto_us + 1 - total / n > self.tolerance:
            self.mean.clear()
            self.members.clear()
            return self._closed(members), None
        return [], total / n + self.tolerance


def associate_stream(detections: DataFrame, keys: list[str], tolerance_us: float, coarse: DataFrame | None = None, min_observers: int = 2, late: str = "10 seconds", device: str = "device_id", t: str = "t_local_us") -> DataFrame:
    """``keys, event_no, device_id, t_local_us``: ``associate`` over a stream; an event's rows come once it is closed.

    ``coarse`` is a table as in ``associate``. Rows more than ``late`` behind the latest are dropped;
    without such the rows, and the numbers of the events, are those of the batch form, but for events
    at the end that further rows could still join. Rows without a time or a key are left out.
    """
    if tolerance_us <= 0:
        raise ValueError("tolerance_us must be positive")
    rows = detections.where(F.col(t).isNotNull()).select(*keys, F.col(device).cast("string").alias("device"), F.col(t).cast("long").alias("t_local_us")).na.drop(subset=keys)
    if coarse is not None:
        named = coarse.withColumnRenamed("device_id", "device")
        on = [c for c in [*keys, "device"] if c in named.columns]
        rows = rows.join(named.select(*on, "alpha", "beta_us"), on, "left")
        ct = F.coalesce("alpha", F.lit(1.0)) * F.col("t_local_us") + F.coalesce("beta_us", F.lit(0.0))
    else:
        ct = F.col("t_local_us").cast("double")
    rows = rows.select(*keys, ct.alias("ct"), "device", "t_local_us").withColumn("at", event_time(F.col("ct"))).withWatermark("at", late)
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    out = rows.groupBy(*keys).transformWithStateInPandas(_Association(keys, tolerance_us, min_observers), StructType.fromDDL(f"{fields}, event_no bigint, device_id string, t_local_us bigint"), "Append", "EventTime")
    return out.withColumnRenamed("device_id", device).withColumnRenamed("t_local_us", t)


class _AsOf(InOrder):
    def __init__(self, keys: list[str], tolerance_us: int, kernel: str, wait_us: int | None):
        # samples (grid_idx -1) come before points of the same time, since a sample at a point counts as before it
        super().__init__(keys, "t_us bigint, grid_idx bigint", "grid_idx bigint, t_us bigint, source_index bigint, next_index bigint, weight double, valid boolean, interp_confidence double")
        self.tolerance, self.kernel, self.wait = tolerance_us, kernel, wait_us

    def open(self) -> None:
        self.last = self.handle.getValueState("last", "n long, t long")
        self.points = self.handle.getListState("points", "grid_idx long, t_us long, n long, prev long")

    def _joined(self, point: tuple, following: int | None) -> tuple:
        idx, t, n, prev = point
        gaps = [g for g in (t - prev if n else None, following - t if following is not None else None) if g is not None]
        gap = min(gaps, default=None)
        valid = gap is not None and gap <= self.tolerance
        weight = (t - prev) / (following - prev) if n and following is not None else 0.0
        return idx, t, n - 1, n if following is not None else -1, weight, valid, max(0.0, 1 - gap / self.tolerance) if valid else 0.0

    def take(self, rows: Iterator[tuple]) -> list[tuple]:
        n, prev = self.last.get() if self.last.exists() else (0, 0)
        open_ = [tuple(p) for p in self.points.get()] if self.points.exists() else []
        out = []
        for t, idx in rows:
            if idx >= 0 and self.kernel == HOLD:
                out.append(self._joined((idx, t, n, prev), None))
            elif idx >= 0:
                open_.append((idx, t, n, prev))
            else:
                out += [self._joined(p, t) for p in open_]
                n, prev, open_ = n + 1, t, []
        self.last.update((n, prev))
        self._keep(open_)
        return out

    def _keep(self, open_: list[tuple]) -> None:
        if open_:
            self.points.put(open_)
        else:
            self.points.clear()

    def passed(self, upto_us: int) -> tuple[list[tuple], float | None]:
        open_ = [tuple(p) for p in self.points.get()] if self.points.exists() else []
        if self.wait is None or not open_:
            return [], None
        given_up = [p for p in open_ if upto_us - p[1] >= self.wait]
        left = open_[len(given_up) :]
        if given_up:
            self._keep(left)
        return [self._joined(p, None) for p in given_up], left[0][1] + self.wait if left else None


def asof_join_stream(points: DataFrame, samples: DataFrame, keys: list[str], tolerance_us: int, kernel: str = HOLD, late: str = "10 seconds", wait_us: int | None = None) -> DataFrame:
    """``keys, grid_idx, t_us, source_index, next_index, weight, valid, interp_confidence``: ``asof_join`` over streams.

    ``points(keys, grid_idx, t_us)`` and ``samples(keys, t_ref_us)`` are streams. With HOLD a point
    comes out when the watermark has passed it. With CONTINUOUS it waits for the next sample, however
    long without ``wait_us``; with it, it is given up ``wait_us`` after its time and has no next sample.
    Rows more than ``late`` behind the latest are dropped, and so are rows without a time or a key;
    otherwise the rows are those of the batch form, but for points that still wait.
    """
    if tolerance_us <= 0:
        raise ValueError("tolerance_us must be positive")
    if kernel not in (HOLD, CONTINUOUS):
        raise ValueError(f"unknown kernel {kernel!r}")
    marked = points.select(*keys, F.col("t_us").cast("long").alias("t_us"), F.col("grid_idx").cast("long").alias("grid_idx"))
    sampled = samples.select(*keys, F.col("t_ref_us").cast("long").alias("t_us"), F.lit(-1).cast("long").alias("grid_idx"))
    rows = marked.unionByName(sampled).na.drop(subset=[*keys, "t_us"]).withColumn("at", event_time(F.col("t_us"))).withWatermark("at", late)
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    result = StructType.fromDDL(f"{fields}, grid_idx bigint, t_us bigint, source_index bigint, next_index bigint, weight double, valid boolean, interp_confidence double")
    return rows.groupBy(*keys).transformWithStateInPandas(_AsOf(keys, tolerance_us, kernel, wait_us), result, "Append", "EventTime")
