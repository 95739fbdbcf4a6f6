"""Operator 9: embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length one and rotated by a fixed random rotation, and the rotated axes are cut
into blocks. Two vectors of cosine c differ by 2 - 2c in squared distance, and the blocks' squared
distances add up to that; so in at least one block they differ by no more than the block's share of
it in proportion to its axes. Each block is range-joined under that budget: vectors lie in cells of
the block's first axes, one budget's radius wide, so partners lie in the same or a neighbouring cell.
The union of what the blocks find is verified with the original components in double precision.
Nothing within the threshold is missed.

Vectors are dealt into parts, and every two parts meet in one unit of work, in which all blocks are
joined; so a vector is sent once per part, not once per block, cell and neighbour. Parts are few while
they fit a task's memory (``PARTS``, ``MOST_ROWS``): up to 786,432 vectors what is sent is six times them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, durable

THRESHOLD = 0.9
#: Blocks of the rotated axes, and axes per block that make a cell.
BLOCKS, CELL_AXES = 4, 2
#: Rows of a part at least, parts up to which that holds, and rows of a part at most.
SIDE_ROWS, PARTS, MOST_ROWS = 2000, 6, 1 << 17
_TILE = 384  # so that a tile's distances stay in a core's cache


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(20240101).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def bounds(dims: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int).tolist()
    return list(zip(edges, edges[1:]))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _budget(a: int, b: int, dims: int, threshold: float) -> float:
    return (2 - 2 * threshold) * (b - a) / dims


def _rotated(x: np.ndarray) -> np.ndarray:
    """Unit vectors on the rotated axes, some thousand rows at a time."""
    q = rotation(x.shape[1])
    out = np.empty(x.shape, dtype=np.float32)
    for k in range(0, len(x), 8192):
        out[k : k + 8192] = unit(x[k : k + 8192].astype(np.float64)) @ q
    return out


class Cells:
    """Rows of one block of the rotated axes, in the order of their cells."""

    def __init__(self, r: np.ndarray, side: float):
        cell = np.floor(r[:, :CELL_AXES] / np.float32(side)).astype(np.int64)
        first, second = cell[:, 0], cell[:, 1] if cell.shape[1] > 1 else np.zeros(len(cell), np.int64)
        self.order = np.lexsort((second, first))
        self.rows = r[self.order]
        self.square = (self.rows * self.rows).sum(axis=1)
        self.key = self.name(first, second)[self.order]
        self.begin = np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1]))
        self.end = np.append(self.begin[1:], len(self.key))
        self.names = list(zip(first[self.order[self.begin]].tolist(), second[self.order[self.begin]].tolist(), strict=True))

    @staticmethod
    def name(first, second):
        return (first << 32) + second

    def span(self, first: int, low: int, high: int) -> tuple[int, int]:
        """Where the cells from (first, low) to (first, high) begin and end."""
        return int(np.searchsorted(self.key, self.name(first, low))), int(np.searchsorted(self.key, self.name(first, high), side="right"))


def _tiles(x: Cells, y: Cells) -> Iterator[tuple[int, int, int, int]]:
    """Rows of x and rows of y that may be partners: those of each cell, and those of its neighbours; of one set with itself, half of them."""
    for (c1, c2), begin, end in zip(x.names, x.begin.tolist(), x.end.tolist(), strict=True):
        spans = [(begin, y.span(c1, c2 + 1, c2 + 1)[1]), y.span(c1 + 1, c2 - 1, c2 + 1)] if x is y else [y.span(c1 + d, c2 - 1, c2 + 1) for d in (-1, 0, 1)]
        for low, high in spans:
            for i in range(begin, end, _TILE):
                for j in range(low, high, _TILE):
                    yield i, min(i + _TILE, end), j, min(j + _TILE, high)


def _pairs(x: Cells, y: Cells, cut: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of rows whose squared distance is at most ``cut``, a little more included: float32 tiles."""
    one = lambda c: np.ones((len(c.rows), 1), np.float32)
    left = np.hstack([-2 * x.rows, x.square[:, None], one(x)])
    right = np.ascontiguousarray(np.hstack([y.rows, one(y), y.square[:, None]]).T)
    for i, i_end, j, j_end in _tiles(x, y):
        near = np.flatnonzero(left[i:i_end] @ right[:, j:j_end] <= np.float32(cut + 1e-5))
        if len(near):
            a, b = near // (j_end - j) + i, near % (j_end - j) + j
            if x is y:
                a, b = a[a < b], b[a < b]
            yield x.order[a], y.order[b]


def verify(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, block: int, threshold: float) -> np.ndarray:
    """Of candidate pairs: those of cosine >= threshold that ``block`` is the first to find."""
    good = (x * y).sum(axis=1) >= threshold * np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    dims = x.shape[1]
    d = rx.astype(np.float64) - ry
    for k, (a, b) in enumerate(bounds(dims)[: block + 1]):
        inside = (d[:, a:b] ** 2).sum(axis=1) <= _budget(a, b, dims, threshold) + 2e-6  # axes are rounded to float32
        good &= inside if k == block else ~inside
    return good


def _join(table: pa.Table, threshold: float) -> pa.Table:
    """Links within one unit of work: per vector their number, weighted by copies, and a tie to its group."""
    table = table.combine_chunks()
    dims, i, j = (table[c][0].as_py() for c in ("dims", "i", "j"))
    cls, copies, part = (table[c].to_numpy() for c in ("cls", "copies", "part"))
    x = np.concatenate([c.flatten().to_numpy() for c in table["embedding"].chunks]).reshape(-1, dims)
    del table
    most = np.abs(x).max(axis=1, keepdims=True).astype(np.float64)  # so that no square overflows or vanishes
    r = _rotated(x)
    of = [np.flatnonzero(part == k) for k in sorted({i, j})]
    links = np.zeros(len(cls), dtype=np.int64)
    root = np.arange(len(cls))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for block, (a, b) in enumerate(bounds(dims)):
        side = np.sqrt(_budget(a, b, dims, threshold)) * (1 + 1e-5) + 1e-6
        cells = [Cells(r[o, a:b], side) for o in of]
        for p_, q_ in _pairs(cells[0], cells[-1], _budget(a, b, dims, threshold)):
            p_, q_ = of[0][p_], of[-1][q_]
            k, step = 0, 4096
            while k < len(p_):  # steps double, so that most pairs of a dense group find their group tied already
                p, q = p_[k : k + step], q_[k : k + step]
                k, step = k + step, min(2 * step, 1 << 16)
                good = verify(x[p] / most[p], x[q] / most[q], r[p], r[q], block, threshold)
                p, q = p[good], q[good]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                while not np.array_equal(root, root[root]):
                    root = root[root]
                u, v = root[p], root[q]
                for a_, b_ in np.unique(np.stack([u, v])[:, u != v], axis=1).T.tolist():
                    a_, b_ = find(a_), find(b_)
                    if a_ != b_:
                        root[max(a_, b_)] = min(a_, b_)
    touched = np.flatnonzero(links)
    ties = np.array([find(k) for k in touched.tolist()], dtype=np.int64)
    return pa.table({"cls": cls[touched], "links": links[touched], "root": cls[ties]}, schema=pa.schema([(c, pa.int64()) for c in ("cls", "links", "root")]))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    ``n_links`` counts the other rows of cosine >= ``threshold`` in double precision, ``component_id``
    is the least id reachable over links, ``kept`` says that this is the row's own id. Vectors that
    are null, empty, zero or hold a null or non-finite component link with nothing, and vectors of
    different lengths do not link. Equal vectors are one node with a number of copies, so copies cost
    no pairs; a dense group's links are counted where they are found and tied to one member, never
    sent as pairs. Repeated ids count as rows of their own; rows with a null id link and count, but
    get ``kept`` false; other columns are ignored; an empty table gives an empty result. A task holds
    two parts of the vectors, of ``MOST_ROWS`` at most.
    """
    c = F.col("embedding")
    kind = vectors.select(vec_col).schema[0].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"  # floats stay as they are, which is half the bytes
    usable = (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(c, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("embedding"))
    double = c.cast("array<double>")
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("k1", F.xxhash64(double)).withColumn("k2", F.xxhash64(F.lit(1), F.reverse(double)))
    classes = rows.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = durable(classes.select(F.monotonically_increasing_id().alias("cls"), F.size("embedding").alias("dims"), "*"))
    rows = durable(rows.drop("embedding"))
    most = classes.groupBy("dims").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    parts = max(1, -(-most // MOST_ROWS), min(PARTS, -(-most // SIDE_ROWS)))
    part, other = F.pmod(F.xxhash64("cls"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    work = classes.select("dims", "cls", "copies", "embedding", part.alias("part"), other.alias("other"))
    work = work.select("dims", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cls", "copies", "embedding")
    found = work.groupBy("dims", "i", "j").applyInArrow(lambda table: _join(table, threshold), "cls long, links long, root long")
    found = durable(found)
    comp = durable(connected_components(found.select(F.col("cls").alias("src"), F.col("root").alias("dst")))).withColumnRenamed("node", "cls")
    counted = found.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.drop("embedding").join(counted, "cls", "left").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    result = named.join(least, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("usable").join(result, ["k1", "k2"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def sql(threshold: float = THRESHOLD) -> str:
    """The op9 query over ``embeddings`` in DuckDB: every pair, then reachability along links."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e, coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS good FROM embeddings),
s AS (SELECT r, len(e) AS n, list_transform(e, lambda x: x::DOUBLE) AS e, list_max(list_transform(e, lambda x: abs(x::DOUBLE))) AS m FROM v WHERE good),
u AS (SELECT r, n, list_transform(e, lambda x: x / m) AS e FROM s), w AS (SELECT r, n, e, list_dot_product(e, e) AS q FROM u),
link AS (SELECT a.r AS x, b.r AS y FROM w a JOIN w b ON a.n = b.n AND a.r <> b.r AND list_dot_product(a.e, b.e) >= {threshold}::DOUBLE * sqrt(a.q * b.q)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
count_ AS (SELECT x, count(*) AS n FROM link GROUP BY 1), least_ AS (SELECT x, min(vec_id) AS c FROM reach JOIN v ON v.r = reach.y GROUP BY 1)
SELECT v.vec_id::BIGINT AS vec_id, coalesce(n, 0)::BIGINT AS n_links, (CASE WHEN c IS NULL THEN v.vec_id ELSE least(c, coalesce(v.vec_id, c)) END)::BIGINT AS component_id, coalesce(v.vec_id = (CASE WHEN c IS NULL THEN v.vec_id ELSE least(c, v.vec_id) END), false) AS kept
FROM v LEFT JOIN count_ ON count_.x = v.r LEFT JOIN least_ ON least_.x = v.r
"""
