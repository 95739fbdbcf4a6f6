"""Operator 12: hard negatives from vantage-point trees over norm-augmented vectors.

A row x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm of its block, and an anchor
a gets zero there. Then the squared distance of a and x is |a|^2 + M^2 - 2 a.x: the order by score is
the order by distance, and a window of scores is an annulus around the anchor. Rows are dealt into
blocks by a hash of their id, so a vector with any number of copies is spread over all of them; each
block is a vantage-point tree, which anchors search together, nodes that lie nearest to the annulus'
inner edge first. An anchor leaves a node alone if the triangle inequality keeps the node outside its
annulus, whose outer edge moves in with every better row found. Bounds are compared with some slack,
and rows are judged by integer scores, so nothing is missed. The best of all blocks are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Rows and anchors of one unit of work; rows of a leaf; anchors that search together.
BLOCK_ROWS, BLOCK_ANCHORS, LEAF, TOGETHER = 16_384, 4096, 256, 128


def vantage_tree(x: np.ndarray, rows: np.ndarray):
    """A leaf (row numbers), or (vantage row, ((least, largest distance, subtree), twice)), halved by rank so that ties don't matter."""
    if len(rows) <= LEAF:
        return rows
    v = rows[len(rows) // 2]
    d = np.sqrt(np.maximum(((x[rows] - x[v]) ** 2).sum(axis=1), 0))
    order = np.argsort(d, kind="stable")
    halves = (order[: len(order) // 2], order[len(order) // 2 :])
    return v, tuple((d[h[0]], d[h[-1]], vantage_tree(x, rows[h])) for h in halves)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in double precision as far as that is exact, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class _Best:
    """The first k (score descending, id ascending) of each query; ``least`` is the score that a new row needs."""

    def __init__(self, low: np.ndarray, k: int):
        self.least, self.k, self.held = low.copy(), k, 0
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, q: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        self.rows.append((q, score, id_))
        self.held += len(q)
        if self.held > 3 * self.k * len(self.least):
            self.kept()

    def kept(self) -> tuple[np.ndarray, ...]:
        q, score, id_ = (np.concatenate(c) for c in zip(*self.rows)) if self.rows else (np.empty(0, np.int64),) * 3
        order = np.lexsort((id_, -score, q))
        q, score, id_ = q[order], score[order], id_[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        full = rank == self.k - 1
        self.least[q[full]] = score[full]
        good = rank < self.k
        self.rows, self.held = [(q[good], score[good], id_[good])], int(good.sum())
        return self.rows[0]


def search(tree, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, big: float, a: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """``(query, score, id)``: per query the first k rows of scores from low to high whose label is the anchor's (or is not).

    ``x`` are integer rows, ``big`` is M^2, ``a`` the anchors; query i belongs to anchor ``of[i]``.
    """
    norm = (a.astype(np.float64) ** 2).sum(axis=1)[of] + big
    slack = 1e-6 * np.sqrt(norm + 1)
    inner = np.sqrt(np.maximum(norm - 2.0 * high, 0)) - slack
    best, turn = _Best(low, k), 0
    heap = [(0.0, turn, tree, np.zeros(len(of)), np.full(len(of), np.inf))]
    while heap:
        _, _, node, near, far = heapq.heappop(heap)
        outer = np.sqrt(np.maximum(norm - 2.0 * best.least, 0)) + slack
        open_ = np.flatnonzero((near <= outer) & (far >= inner) & (low <= high))
        if not len(open_):
            continue
        if isinstance(node, np.ndarray):
            anchors, at = np.unique(of[open_], return_inverse=True)
            score = _dot(a[anchors], x[node])
            fits = ((labels[node][None, :] == a_labels[anchors][:, None]) == same) & (ids[node][None, :] != a_ids[anchors][:, None])
            score_q = score[at]
            good = fits[at] & (score_q >= best.least[open_, None]) & (score_q <= high[open_, None])
            q, r = np.nonzero(good)
            if len(q):
                best.add(open_[q], score_q[q, r], ids[node][r])
            continue
        v, children = node
        d = np.sqrt(np.maximum(norm - 2.0 * _dot(a, x[v][None, :])[of, 0], 0))
        for least, most, child in children:
            n, f = np.maximum(near, np.maximum(d - most, least - d)), np.minimum(far, d + most)
            turn += 1
            heapq.heappush(heap, (float(np.maximum(n - inner, 0)[open_].min()), turn, child, n, f))
    return best.kept()


def _unit(pdf: pd.DataFrame, k: int, same: bool) -> Iterator[pd.DataFrame]:
    """One block of rows under one block of anchors: ``anchor_id, p, score, cand_id``."""
    out = {"anchor_id": "int64", "p": "int32", "score": "int64", "cand_id": "int64"}
    asks = pdf["windows"].notna().to_numpy(bool)
    rows, anchors = pdf[~asks], pdf[asks]
    if not len(rows) or not len(anchors):
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in out.items()})
    x = np.stack(rows["q"].to_numpy()).astype(np.int64)
    ids, labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
    square = (x.astype(np.float64) ** 2).sum(axis=1)
    big = float(square.max())
    tree = vantage_tree(np.column_stack([x, np.sqrt(big - square)]), np.arange(len(x)))
    a = np.stack(anchors["q"].to_numpy()).astype(np.int64)
    a_ids, a_labels = anchors["vec_id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)
    windows = [np.asarray([list(w) if isinstance(w, (tuple, list)) else [w["p"], w["low"], w["high"]] for w in ws], dtype=np.int64).reshape(-1, 3) for ws in anchors["windows"]]
    order = np.argsort(_dot(a, x[:1])[:, 0], kind="stable")  # anchors of like direction search together
    found = []
    for i in range(0, len(order), TOGETHER):
        part = order[i : i + TOGETHER]
        w = np.concatenate([windows[j] for j in part])
        of = np.repeat(np.arange(len(part)), [len(windows[j]) for j in part])
        if len(of):
            q, score, id_ = search(tree, x, ids, labels, big, a[part], a_ids[part], a_labels[part], of, w[:, 1], w[:, 2], k, same)
            found.append(pd.DataFrame({"anchor_id": a_ids[part][of[q]], "p": w[q, 0], "score": score, "cand_id": id_}))
    return pd.concat(found).astype(out) if found else pd.DataFrame({c: pd.Series(dtype=t) for c, t in out.items()})


def _searched(rows: DataFrame, asks: DataFrame, blocks: int, askers: int, k: int, same: bool) -> DataFrame:
    """``anchor_id, p, rank, score, cand_id``: the first k of all blocks for each anchor and window."""
    none = F.lit(None).cast("array<struct<p:bigint,low:bigint,high:bigint>>").alias("windows")
    side = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    other = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(askers)).cast("int").alias("asker")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    home = rows.select("dims", side, every(askers).alias("asker"), "vec_id", "label", "q", none)
    came = asks.select("dims", every(blocks).alias("block"), other, "vec_id", "label", "q", "windows")
    work = home.unionByName(came).groupBy("dims", "block", "asker")
    found = work.applyInPandas(lambda pdf: _unit(pdf, k, same), "anchor_id long, p int, score long, cand_id long")
    first = F.row_number().over(Window.partitionBy("anchor_id", "p").orderBy(F.desc("score"), "cand_id"))
    return found.withColumn("rank", first).where(F.col("rank") <= k)


def quantised(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, dims, q)``: rows that take part, components as integers ``floor(scale * x)``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("e"))
    sound = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & F.coalesce(sound, F.lit(False)))
    return rows.select("vec_id", "label", F.size("e").alias("dims"), F.transform("e", lambda v: F.floor(v * scale)).alias("q"))


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchor`` is a condition on ``vec_id`` that says which rows are anchors. Scores are integer inner
    products of ``floor(256 x)``; an anchor's positives are its ``positives`` best other rows of the
    same label; for each of them the ``negatives`` best rows of other labels with low/100 of the
    positive's score <= score <= high/100 of it. Higher scores come first, ties by the smaller id.

    Rows with a null id, label or vector, with an empty vector, or with a null or non-finite component
    take no part; vectors of different lengths have no score. Rows that repeat an id are candidates of
    their own, but never of an anchor of that id; of anchors that share an id, the one of the least
    label and vector asks. Anchors without positives, or positives without a row in the window, give
    no rows; other columns are ignored; an empty table gives an empty result. Scores are 64-bit integers.
    """
    rows = durable(quantised(vectors, id_col, label_col, vec_col))
    one = rows.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "dims", "q")).alias("a"))
    anchors = durable(one.select("vec_id", "a.*"))
    blocks, askers = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-anchors.count() // BLOCK_ANCHORS))
    limit = (1 << 62) - 1
    window = lambda p, a, b: F.struct(F.lit(p).cast("long").alias("p"), a.alias("low"), b.alias("high"))
    asks = anchors.withColumn("windows", F.array(window(0, F.lit(-limit), F.lit(limit))))
    best = durable(_searched(rows, asks, blocks, askers, positives, True).select("anchor_id", F.col("rank").alias("p"), F.col("cand_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # a negative score has no window, since low/100 of it lies above high/100 of it
    s = "cast(positive_score as decimal(20, 0))"
    edges = F.expr(f"struct(cast(p as bigint) as p, ({low} * {s} + 99) div 100 as low, {high} * {s} div 100 as high)")
    asked = best.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(edges).alias("windows"))  # at most ``positives`` each
    asks = durable(anchors.join(asked, anchors.vec_id == asked.anchor_id).drop("anchor_id"))
    found = _searched(rows, asks, blocks, askers, negatives, False)
    return found.join(best, ["anchor_id", "p"]).select("anchor_id", "positive_id", "rank", F.col("cand_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def sql(positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> str:
    """The op12 query over ``embeddings`` in DuckDB: every anchor against every row."""
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {positives})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score
QUALIFY rank <= {negatives}
"""
