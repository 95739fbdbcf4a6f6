"""Detectors of one's own: state machines in Python that run on the buckets of a signal in parallel.

A machine has a few states and steps from one to the next with each value. A bucket's rows can't be
run before the state at its border is known, and that hangs on all buckets before. So the machine is
run from each of its states first, in every bucket at once: where each would end is the bucket's carry
row. The carry rows of a signal, one a bucket, give the state at every border, and the second run
starts there. Both runs go over buckets in order of position, any number of them in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import stored
from .ordered import ROWS, before, carried, cut


class Machine:
    """States by number, from 0, where a signal begins; ``active`` are those in which an event goes on."""

    states = 1
    active: frozenset[int] = frozenset()

    def step(self, state: int, value: float | None) -> int:
        raise NotImplementedError


class Hysteresis(Machine):
    """An event begins above ``high`` and goes on until the signal falls below ``low``; null and NaN change nothing."""

    states, active = 2, frozenset({1})

    def __init__(self, low: float, high: float):
        if not low <= high:
            raise ValueError("low must not be above high")
        self.low, self.high = low, high

    def step(self, state: int, value: float | None) -> int:
        if value is None or value != value:
            return state
        return 1 if value > self.high else 0 if value < self.low else state


class _Ends:
    """Where the machine ends in a bucket, for each state that it may begin in."""

    made = {"ends": ("array<int>", pa.list_(pa.int32()))}

    def __init__(self, machine: Machine, row: tuple):
        self.machine, self.at = machine, list(range(machine.states))

    def step(self, signal, pos, t, *_):
        self.at = [self.machine.step(s, signal) for s in self.at]
        return ()

    def end(self):
        yield (self.at,)


class _Runs:
    """The stretches of a bucket in which an event goes on: where it began (null: before the bucket), and its largest value."""

    made = {"began": ("long", pa.int64()), "peak": ("double", pa.float64()), "pos": ("long", pa.int64()), "t": ("long", pa.int64()), "some": ("boolean", pa.bool_())}

    def __init__(self, machine: Machine, row: tuple):
        self.machine, self.state = machine, row[-1]
        self.run = [None, None, None, None] if self.state in machine.active else None

    def step(self, signal, pos, t, *_):
        self.state = self.machine.step(self.state, signal)
        if self.state not in self.machine.active:
            yield from self.end()
            self.run = None
            return
        if self.run is None:
            self.run = [pos, None, None, None]
        good = signal is not None and signal == signal
        if self.run[2] is None or good and (self.run[1] is None or signal > self.run[1]):
            self.run[1:] = [signal if good else None, pos, t]

    def end(self):
        if self.run and self.run[2] is not None:
            yield (*self.run, True)


def _scanned(rows: DataFrame, bucket: list[str], scan, machine: Machine) -> DataFrame:
    """Each bucket of ``rows(bucket, signal, pos, t, ...)``, in order of position, through a ``scan`` of its own; tasks take their buckets one after another."""
    n, types = len(bucket), [kind for _, kind in scan.made.values()]
    fields = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in bucket] + [f"{c} {ddl}" for c, (ddl, _) in scan.made.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, kinds = None, None, None

        def table(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), [*kinds, *types], strict=True)], [*bucket, *scan.made])

        for b in batches:
            kinds, found = [b.schema.field(k).type for k in bucket], []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:n] != key:
                    if now is not None:
                        found += [(*key, *x) for x in now.end()]
                    key, now = row[:n], scan(machine, row[n:])
                found += [(*key, *x) for x in now.step(*row[n:])]
            if found:
                yield table(found)
        if now is not None and (found := [(*key, *x) for x in now.end()]):
            yield table(found)

    return rows.repartition(*bucket).sortWithinPartitions(*bucket, "pos").mapInArrow(run, ", ".join(fields))


def find_events(signals: DataFrame, keys: list[str], machine: Machine, t: str = "t_us", signal: str = "signal", pos: str = "pos", width: float = ROWS) -> DataFrame:
    """``keys, began, t_local_us``: one row per event: the position where it began, and the time of its first largest value.

    Positions order a signal and must not be null; rows with a null key are left out. A machine's step
    must depend on the state and the value alone. An event may span any number of buckets; one still
    going on at the end counts.
    """
    bucket = [*keys, "__b"]
    rows = signals.na.drop(subset=keys).select(*keys, F.col(t).cast("long").alias("t"), F.col(signal).cast("double").alias("signal"), F.col(pos).cast("long").alias("pos"))
    rows = cut(rows, "pos", width)
    rows = rows.select(*bucket, "signal", "pos", "t")
    ends = stored(_scanned(rows, bucket, _Ends, machine))  # a row per bucket

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, state = pdf.sort_values("__b"), [], 0
        for e in pdf["ends"]:
            at.append(state)
            state = int(e[state])
        return pdf[bucket].assign(state=at)

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in bucket)
    state = ends.groupBy(*keys).applyInPandas(borders, fields + ", state int")
    parts = stored(_scanned(rows.join(state, bucket).select(*bucket, "signal", "pos", "t", "state"), bucket, _Runs, machine))
    # a stretch that began before its bucket belongs to the last event that began in a bucket before
    parts = carried(parts, keys, {"__last": F.max("began")}, {"__open": F.max("__last").over(before(keys))}).withColumn("began", F.coalesce("began", "__open"))
    first = F.struct(F.col("peak").isNull(), -F.coalesce("peak", F.lit(0.0)), F.col("pos"))
    return parts.groupBy(*keys, "began").agg(F.min_by("t", first).alias("t_local_us"))


def detector(machine: Machine):
    """A machine as a detector for ``register_detector``: ``keys, t_local_us`` of its events."""

    def run(signals: DataFrame, keys: list[str], **options) -> DataFrame:
        return find_events(signals, keys, machine, **options).select(*keys, "t_local_us")

    return run


def rows_of(machine: Machine, values: Iterator[float | None]) -> list[int]:
    """The states that a machine passes through, for trying it out."""
    out, state = [], 0
    for v in values:
        state = machine.step(state, v)
        out.append(state)
    return out
