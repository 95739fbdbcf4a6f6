"""Operator 1: language identification, family first and then one language against another.

A text becomes a vector of hashed byte n-grams (orders one to three) of its lower-cased letters.
Linear support vector machines tell language families apart (one against the rest); within the
family that wins, one machine per pair of languages votes. The machines are fitted on the driver
from a bounded sample of labelled rows; prediction runs over every whole text where it lies.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, named

#: Hashed dimensions; labelled documents per language and in all that the machines are fitted on.
DIMS, PER_LANG, AT_MOST = 8192, 400, 4000
UNDECIDED = "und"
#: Families of ISO 639-1 codes. A code that is not listed belongs to the family "other".
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "indo-aryan": "bn gu hi mr ne pa sa ur".split(),
    "semitic": "am ar he mt".split(),
}
_FAMILY = {c: f for f, codes in FAMILIES.items() for c in codes}
_LETTER = regex.compile(r"\p{L}")
_KEEP = np.arange(256, dtype=np.uint32)
_KEEP[:128] = 32
_KEEP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of n-gram shares, plus a constant."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.zeros(DIMS, dtype=np.int64)
    for a in range(0, len(data), _PIECE):  # whole text, in pieces that overlap by two bytes
        d = _KEEP[data[max(0, a - 2) : a + _PIECE]]
        d = d[(d != 32) | np.concatenate(([True], d[:-1] != 32))]
        g = d
        for order in (1, 2, 3):
            if order > 1:
                g = g[:-1] * np.uint32(0x01000193) + d[order - 1 :]
            counts += np.bincount((g * np.uint32(0x9E3779B1) + np.uint32(order)) >> np.uint32(19), minlength=DIMS)
    return np.append(np.sqrt(counts / max(1, counts.sum())), 1.0)


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 100) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, classes weighted alike; y is +1 or -1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = z = np.zeros(x.shape[1])
    step, t = 1 / (4 + ridge), 1.0
    for _ in range(rounds):  # accelerated gradient
        slack = np.maximum(0.0, 1 - y * (x @ z))
        new = z - step * (ridge * z - 2 * ((share * y * slack) @ x))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z = new + (before - 1) / t * (new - w)
        w = new
    return w


class Model:
    """Families with their machines, and each family's languages with theirs."""

    def __init__(self, labels: list[str], x: np.ndarray):
        lang = np.array(labels, dtype=object)
        fam = np.array([_FAMILY.get(c, "other") for c in labels], dtype=object)
        self.families = sorted(set(fam))
        self.langs = {f: sorted(set(lang[fam == f])) for f in self.families}
        rest = self.families if len(self.families) > 2 else self.families[:1] if len(self.families) == 2 else []
        self.family_w = np.array([fit_svm(x, np.where(fam == f, 1.0, -1.0)) for f in rest])
        if len(self.families) == 2:
            self.family_w = np.vstack([self.family_w, -self.family_w])
        self.pairs: dict[str, tuple[list, np.ndarray]] = {}
        for f in self.families:
            pairs = list(itertools.combinations(range(len(self.langs[f])), 2))
            weights = []
            for i, j in pairs:
                a, b = lang == self.langs[f][i], lang == self.langs[f][j]
                weights.append(fit_svm(x[a | b], np.where(a, 1.0, -1.0)[a | b]))
            self.pairs[f] = pairs, np.array(weights)

    def predict(self, text: str | None) -> tuple[str, float, str | None]:
        """(language, score, family). The score multiplies the confidence in family and language."""
        if not self.families or not has_letter(text):
            return UNDECIDED, 0.0, None
        x = features(text)
        family, score = self.families[0], 1.0
        if len(self.families) > 1:
            m = self.family_w @ x
            best = int(np.argmax(m))
            others = np.delete(m, best)
            family, score = self.families[best], _sure(m[best] - others.max())
        langs = self.langs[family]
        if len(langs) > 1:
            pairs, w = self.pairs[family]
            votes, total, worst = np.zeros(len(langs)), np.zeros(len(langs)), np.full(len(langs), np.inf)
            for (i, j), m in zip(pairs, w @ x, strict=True):
                votes[i if m > 0 else j] += 1
                for k, v in ((i, m), (j, -m)):
                    total[k] += v
                    worst[k] = min(worst[k], v)
            best = max(range(len(langs)), key=lambda k: (votes[k], total[k]))
            return langs[best], score * _sure(2 * worst[best]), family
        return langs[0], score, family


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(2 * margin, -30, 30))))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, at_most: int = AT_MOST) -> Model:
    """Fit a model on a bounded sample: the first ``per_lang`` labelled rows of each language by hash
    of their id and text, and ``at_most`` rows in all. Null labels, null ids, null texts and texts
    without letters teach nothing and take no place in the sample; without labelled rows the model
    answers ``und`` to everything. Rows that share an id are sampled one by one, rows equal in id,
    text and label as one. The sample does not hang on partitions.

    A language of any size sends few rows to the task that ranks them: its rows are counted first,
    only hashes below ``8 per_lang`` in that number take part, and equal rows are one by then.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    # no more than ``at_most`` languages can be in the sample, which bounds what is broadcast
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(at_most)
    known = known.where(F.col("text").rlike(r"\p{L}")).withColumn("key", F.xxhash64("doc_id", "text"))
    share = F.pmod("key", F.lit(1 << 40)) / float(1 << 40)
    near = known.select("doc_id", "lang", "key", share.alias("h")).join(F.broadcast(counts), "lang").where(F.col("h") * F.col("n") < 8 * per_lang)
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id", "key")
    chosen = near.select("lang", "h", "doc_id", "key").distinct().withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= per_lang)
    picked = chosen.orderBy("k", "lang", "doc_id").limit(at_most).select("doc_id", "lang", "key")  # bounded, so it may be broadcast

    def run(texts: list) -> dict:
        vectors = [features(t).astype(np.float32) for t in texts]
        at = [np.flatnonzero(v).astype(np.int32) for v in vectors]
        return {"at": [a.tobytes() for a in at], "v": [v[a].tobytes() for v, a in zip(vectors, at, strict=True)]}

    sample = map_texts(known.join(F.broadcast(picked), ["doc_id", "lang", "key"], "left_semi").select("doc_id", "lang", "key", "text"), run, "at binary, v binary")
    rows = sample.groupBy("doc_id", "lang", "key").agg(F.first("at").alias("at"), F.first("v").alias("v")).collect()  # one row for each that was picked
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["v"]))
    x = np.zeros((len(rows), DIMS + 1), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], dtype=np.int32)] = np.frombuffer(r["v"], dtype=np.float32)
    return Model([r["lang"] for r in rows], x)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, family)``, one row per input row, from the whole text alone.

    ``und`` with score 0 if the text is null or has no letter. Repeated rows come out repeated,
    other columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by languages and dimensions, not by rows

    def make(texts: list) -> dict:
        found = [shared.value.predict(t) for t in texts]
        return dict(zip(("lang_pred", "score", "family"), map(list, zip(*found, strict=True)), strict=True))

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(kept, make, "lang_pred string, score double, family string")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.2) -> DataFrame:
    """Rows of ``docs`` whose language is told: not ``und``, and with at least ``min_score`` (below
    that neither family nor language is better than a guess). Columns pass through, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> pa.Array:
        m = shared.value
        found = (m.predict(t.as_py()) for t in text)  # one text at a time, however many a batch holds
        return pa.array([f[0] != UNDECIDED and f[1] >= min_score for f in found], pa.bool_())

    return docs.where(F.arrow_udf(run, "boolean")(named(text_col)))
