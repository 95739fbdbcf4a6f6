"""Operator 7: language-model scoring with a log-frequency Bloom filter.

All n-grams (words and pairs, those seen once included) of the training documents are counted:
every task adds up what it holds and sends sorted keys and counts, packed by bucket of the key, so
one shuffle brings each n-gram's counts together. A bucket's counts are quantised on a logarithmic
scale and an n-gram of level q is entered q times into the bucket's Bloom filter, once with each of
1 to q; what is missing at level q + 1 has level q, so a count is read back by repeated membership
probes, and a false positive can only raise it a step. Buckets are as many as the text asks for and
each filter is as long as its entries ask for, so the filter grows with the corpus and leaves no
n-gram out. Filter and exact word counts are broadcast while they are small (``BROADCAST_BYTES``);
beyond that the keys of the documents are sent to the buckets and their levels come back. Both ways
give the same scores.

The model is a pair model with a Dirichlet prior: P(w | h) = (c(h, w) + PRIOR p(w)) / (c(h) + PRIOR),
p the smoothed word frequency. A history is followed by one token each time it occurs, so the
probabilities after it add up to one, up to quantisation and false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _cut, durable, map_texts, slices

#: Largest filter and word table that are broadcast, and how much of them one broadcast holds.
BROADCAST_BYTES, PART_BYTES = 192 << 20, 8 << 20
#: Bytes of text per bucket of n-grams; bits of the filter per entry; the prior's weight in tokens.
BUCKET_BYTES, ENTRY_BITS, PRIOR = 2 << 20, 7.0, 100.0
#: Factor between levels of counts; raw keys that a counting task holds; bytes of text that are cut into words at once.
STEP, HELD, PIECE = 1.3, 4_000_000, 1 << 18
#: Tokens of a chunk of documents whose keys are sent to the buckets.
CHUNK_TOKENS = 1_000_000
#: Of tables whose rows are megabytes: bytes of a row group, and rows after which a writer looks at its size.
SMALL_GROUPS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)
#: Hashes of the end of a text, and of what stands before its first word.
END, START = U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B)
_BASE = 0x5851F42D4C957F2D
_LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def levels() -> tuple[np.ndarray, np.ndarray]:
    """(least count of each level from 1, the count that a level stands for; 0 for level 0)."""
    least = [1]
    while least[-1] < 1 << 52:
        least.append(max(least[-1] + 1, int(least[-1] * STEP)))
    low = np.array(least, dtype=np.int64)
    value = np.concatenate(([0.0], (low[:-1] + low[1:] - 1) / 2, [float(low[-1])]))
    return low, value


_LOW, _VALUE = levels()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of a pair of word hashes."""
    return mix(left * _GOLD + right)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key, rising with the key."""
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


_power: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, both modulo 2^64."""
    if len(_power[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _power[k] = np.multiply.accumulate(row)
    return _power


class Tokens:
    """The tokens of some texts as 64-bit hashes: polynomials over the bytes of lower-cased words, then the end."""

    def __init__(self, texts):
        raw = [(t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")).lower() if t else b"" for t in texts]
        data = np.frombuffer(b" ".join([b"", *raw, b""]), dtype=np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # starts and ends of words, in turn
        start, end = edge[::2], edge[1::2]
        up, down = _powers(len(data) + 1)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_LETTERS[data] * up[: len(data)], dtype=np.uint64)))
        words = mix((total[end] - total[start]) * down[start])
        doc_end = np.cumsum(np.array([len(r) for r in raw], dtype=np.int64) + 1)
        doc = np.searchsorted(doc_end, start, side="left")
        self.count = np.bincount(doc, minlength=len(raw)).astype(np.int64) + 1
        self.at = np.cumsum(self.count) - self.count
        self.hash = np.full(len(words) + len(raw), END, dtype=np.uint64)
        self.hash[np.arange(len(words)) + doc] = words

    def left(self) -> np.ndarray:
        """Hash of what stands before each token."""
        out = np.empty_like(self.hash)
        out[1:] = self.hash[:-1]
        out[self.at] = START
        return out

    def pairs(self) -> np.ndarray:
        return pair_key(self.left(), self.hash)

    @classmethod
    def by_pieces(cls, texts: list) -> Tokens:
        """The same tokens, made of some texts at a time: what is held besides them does not grow with the texts."""
        t, parts = object.__new__(cls), [cls(texts[at]) for at in slices(texts, PIECE)]
        t.hash, t.count = np.concatenate([p.hash for p in parts]), np.concatenate([p.count for p in parts])
        t.at = np.cumsum(t.count) - t.count
        return t


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n[order], first)


def count_ngrams(docs: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, kind, keys, n)`` over the texts of ``docs(text)``: kind 1 words, 2 pairs, keys and counts packed.

    Each task adds up what it holds, in bounded memory, before anything is shuffled; within what it
    holds a key occurs once, so that no key is more than a small part of the rows.
    """

    def out(held: dict[int, list]) -> Iterator[pd.DataFrame]:
        for kind in held:
            if not held[kind]:
                continue
            key, n = np.unique(np.concatenate(held[kind]), return_counts=True)
            held[kind] = []
            n = n.astype("<u4")
            cut = np.flatnonzero(np.diff(bucket_of(key, buckets))) + 1
            for some in np.array_split(np.arange(len(cut) + 1), max(1, len(key) * 12 >> 22)):
                ends = [0, *cut.tolist(), len(key)]
                of = [(ends[k], ends[k + 1]) for k in some.tolist()]
                yield pd.DataFrame(
                    {
                        "bucket": bucket_of(key[[a for a, _ in of]], buckets),
                        "kind": np.int8(kind),
                        "keys": [key[a:b].astype("<u8").tobytes() for a, b in of],
                        "n": [n[a:b].tobytes() for a, b in of],
                    }
                )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {1: [], 2: []}
        size = 0
        for b in batches:
            texts = b["text"].tolist()
            for at in slices(texts, PIECE):
                t = Tokens(texts[at])
                held[1].append(t.hash)
                held[2].append(t.pairs())
                size += 2 * len(t.hash)
                if size > HELD:
                    yield from out(held)
                    size = 0
        yield from out(held)

    return docs.select("text").mapInPandas(run, "bucket long, kind byte, keys binary, n binary")


def places(key: np.ndarray, level: int, size) -> tuple[np.ndarray, np.ndarray]:
    """(word of the bucket's filter, bits in it) of keys at one level; all bits of an entry lie in one word."""
    h = mix(key + U(level * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
    bits = (U(1) << (h & U(63))) | (U(1) << (h >> U(6) & U(63))) | (U(1) << (h >> U(12) & U(63))) | (U(1) << (h >> U(18) & U(63)))
    return ((h >> U(32)) * size >> U(32)).astype(np.int64), bits


def fill(key: np.ndarray, level: np.ndarray) -> np.ndarray:
    """One bucket's filter, as long as its entries ask for."""
    size = max(1, int(np.ceil(level.sum() * ENTRY_BITS / 64)))
    words = np.zeros(size, dtype=np.uint64)
    for at in range(1, int(level.max(initial=0)) + 1):
        key, level = key[level >= at], level[level >= at]
        where, bits = places(key, at, U(size))
        np.bitwise_or.at(words, where, bits)
    return words


def build_model(docs: DataFrame) -> DataFrame:
    """``(bucket, buckets, filter, words, counts, total, distinct)`` from ``docs(text)``, one row per bucket that has n-grams.

    ``filter`` packs the bucket's filter, ``words`` and ``counts`` its words' hashes in order and
    their exact counts; ``total`` and ``distinct`` add up over the rows to N and V. Durable.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(1 << 31, max(1, -(-size // BUCKET_BYTES)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"bucket": [int(pdf["bucket"].iloc[0])], "buckets": [buckets]}
        keys, counts = {}, {}
        for kind, part in pdf.groupby("kind"):
            keys[kind], counts[kind] = _summed([np.frombuffer(k, dtype="<u8") for k in part["keys"]], [np.frombuffer(n, dtype="<u4") for n in part["n"]])
        none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        words, n = keys.get(1, none[0]), counts.get(1, none[1])
        key = np.concatenate([words, keys.get(2, none[0])])
        level = np.searchsorted(_LOW, np.concatenate([n, counts.get(2, none[1])]), side="right")
        row |= {"filter": [fill(key, level).astype("<u8").tobytes()], "words": [words.astype("<u8").tobytes()], "counts": [n.astype("<i8").tobytes()]}
        return pd.DataFrame(row | {"total": [int(n.sum())], "distinct": [len(n)]})

    return durable(count_ngrams(docs, buckets).groupBy("bucket").applyInPandas(build, "bucket long, buckets long, filter binary, words binary, counts binary, total long, distinct long"), options=SMALL_GROUPS)


class Part:
    """Some neighbouring buckets: their filters end to end, and their words in order of hash."""

    def __init__(self, rows: list):
        self.first = rows[0]["bucket"]
        self.count = rows[-1]["bucket"] - self.first + 1
        self.buckets = rows[0]["buckets"]
        parts = [np.frombuffer(r["filter"], dtype="<u8") for r in rows]
        self.size = np.zeros(self.count, dtype=np.uint64)  # a bucket without n-grams has no filter
        self.size[[r["bucket"] - self.first for r in rows]] = [len(p) for p in parts]
        self.base = (np.cumsum(self.size) - self.size).astype(np.int64)
        self.bits = np.concatenate(parts)
        self.words = np.concatenate([np.frombuffer(r["words"], dtype="<u8") for r in rows])
        n = np.concatenate([np.frombuffer(r["counts"], dtype="<i8") for r in rows])
        self.counts = n.astype(np.uint32) if n.max(initial=0) < 1 << 32 else n

    def level(self, key: np.ndarray) -> np.ndarray:
        """Level of each key of these buckets, by probes at 1, 2, ... until one fails."""
        bucket = bucket_of(key, self.buckets) - self.first
        base, size = self.base[bucket], self.size[bucket]
        out, at = np.zeros(len(key), dtype=np.uint8), 1
        live = np.flatnonzero(size)
        key, base, size = key[live], base[live], size[live]
        while len(live) and at <= len(_LOW):  # a filter that is full would never fail
            where, bits = places(key, at, size)
            hit = np.flatnonzero(self.bits[base + where] & bits == bits)
            live, key, base, size = live[hit], key[hit], base[hit], size[hit]
            out[live] = at
            at += 1
        return out

    def exact(self, key: np.ndarray) -> np.ndarray:
        """Exact count of each word."""
        if not len(self.words):
            return np.zeros(len(key), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
        return np.where(self.words[at] == key, self.counts[at], 0).astype(np.int64)


def _joined(parts: Iterator[Part], entries: int, words: int) -> Part | None:
    """Parts that follow one another, as one; each is dropped when it is copied."""
    one, b, w = object.__new__(Part), 0, 0
    one.first, one.bits, one.words, one.counts = 0, np.zeros(entries, np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint32)
    for p in parts:
        if not b:
            one.buckets, one.size = p.buckets, np.zeros(p.buckets, dtype=np.uint64)
        one.size[p.first : p.first + p.count] = p.size
        if p.counts.dtype == np.int64:
            one.counts = one.counts.astype(np.int64)
        one.bits[b : b + len(p.bits)], one.words[w : w + len(p.words)], one.counts[w : w + len(p.words)] = p.bits, p.words, p.counts
        b, w = b + len(p.bits), w + len(p.words)
    if not b:
        return None
    one.base = (np.cumsum(one.size) - one.size).astype(np.int64)
    return one


class Scorer:
    """Scores texts by the levels of their n-grams and the totals of the training tokens."""

    def __init__(self, total: int, vocabulary: int):
        self.total = total
        self.floor = total + 0.1 * (vocabulary + 1)

    def rows(self, t: Tokens, which: np.ndarray, exact: np.ndarray, word_level: np.ndarray, pair_level: np.ndarray) -> dict:
        """Columns of the result for each text; ``which`` numbers each token's word, ``pair_level`` is per token."""
        if not len(t.count):
            return {c: np.zeros(0) for c in ("n_tokens", "n_known", "base_score", "score")}
        p = ((_VALUE[word_level] + 0.1) / self.floor)[which]
        # a history is as frequent as its word; what stands before a text is as frequent as its end
        end = which[t.at[0] + t.count[0] - 1]
        before = np.concatenate(([end], which[:-1]))
        before[t.at] = end
        history = _VALUE[word_level][before]
        logs = np.log10((_VALUE[pair_level] + PRIOR * p) / (np.maximum(history, _VALUE[pair_level]) + PRIOR))
        return {
            "n_tokens": t.count,
            "n_known": np.add.reduceat((exact > 0)[which].astype(np.int64), t.at),
            "base_score": np.add.reduceat(np.log10(exact + 0.1)[which], t.at) - t.count * np.log10(self.floor),
            "score": np.add.reduceat(logs, t.at),
        }


_MADE = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: The model that this worker process has put together.
_assembled: dict = {}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    Training takes the documents whose crc32 of the id as text leaves a remainder other than 0 by
    ``held`` (a null id counts as training: it has no remainder). Texts are whole, null counts as
    empty; A-Z are lower-cased, tokens are the words and one end. ``base_score`` is the log10
    probability under add-0.1 smoothed exact word counts, ``score`` under the model, both over all
    tokens. Repeated rows are trained on and scored as often as they occur; other columns are
    ignored, whatever their names; an empty table gives an empty result. Words are told apart by
    64-bit hash. One whole text is held at a time, at the least.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % held == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    model = build_model(rows.where("not held_out"))
    size, total, vocabulary = model.agg(F.sum(F.octet_length("filter") + F.octet_length("words") + F.octet_length("counts")), F.sum("total"), F.sum("distinct")).first()
    scorer = Scorer(total or 0, vocabulary or 0)
    if (size or 0) > broadcast_bytes:
        return _score_by_bucket(rows, model, scorer)
    return _score_by_broadcast(rows, model, scorer, size or 0)


def _score_by_broadcast(rows: DataFrame, model: DataFrame, scorer: Scorer, size: int) -> DataFrame:
    """The whole model, of a size that was checked, goes to every worker, in parts that pass the driver one at a time."""
    spark = rows.sparkSession
    count = max(1, -(-size // PART_BYTES))
    buckets, entries, words = model.agg(F.coalesce(F.max("buckets"), F.lit(1)), F.coalesce(F.sum(F.octet_length("filter")), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    shared = []
    for k in range(count):
        some = model.where((F.col("bucket") >= k * buckets // count) & (F.col("bucket") < (k + 1) * buckets // count)).collect()
        if some:
            shared.append(spark.sparkContext.broadcast(Part(sorted(some, key=lambda r: r["bucket"]))))
        del some
    name = object()

    def values() -> Iterator[Part]:
        for s in shared:
            yield s.value
            s.__dict__.pop("_value", None)  # its copy is in the joined part

    def whole() -> Part | None:
        key = [s._path for s in shared] if shared else id(name)
        if _assembled.get("key") != key:
            _assembled.clear()
            _assembled["part"] = _joined(values(), entries // 8, words)
            _assembled["key"] = key
        return _assembled["part"]

    def make(texts: list) -> dict:
        part, t = whole(), Tokens(texts)
        word, which = np.unique(t.hash, return_inverse=True)
        if part is None:
            found = scorer.rows(t, which, np.zeros(len(word), np.int64), np.zeros(len(word), np.uint8), np.zeros(len(t.hash), np.uint8))
        else:
            found = scorer.rows(t, which, part.exact(word), part.level(word), part.level(t.pairs()))
        return found | {"train_tokens": np.full(len(texts), scorer.total)}

    return map_texts(rows, make, _MADE, characters=PIECE)


def _score_by_bucket(rows: DataFrame, model: DataFrame, scorer: Scorer) -> DataFrame:
    """The documents' keys go to the buckets, and levels come back.

    Documents are taken in chunks of about ``CHUNK_TOKENS``, whose texts are stored compressed. A chunk asks
    for each of its keys once, packed by bucket, so a frequent key costs a bucket one entry per chunk, and
    a bucket looks all its keys up at once. A chunk is a few megabytes in one row; row groups stay small, so
    that writers and readers hold some chunks, not the hundred rows that Parquet waits for by default.
    """
    buckets = model.agg(F.max("buckets")).first()[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        for b in batches:
            whole = b.column("text")
            size = pc.fill_null(pc.binary_length(whole), 0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in _cut(size.tolist(), 6 * CHUNK_TOKENS, len(size)):
                some = lambda c, at=at: b.column(c).slice(at.start, at.stop - at.start)  # noqa: B023, E731
                row = {
                    "chunk": n,
                    "doc_id": some("doc_id").fill_null(0).to_numpy().astype("<i8").tobytes(),
                    "no_id": some("doc_id").is_null().to_numpy(zero_copy_only=False).tobytes(),
                    "held_out": some("held_out").to_numpy(zero_copy_only=False).tobytes(),
                    "size": size[at].tobytes(),
                    "z": zstandard.ZstdCompressor(level=3).compress(b"".join(t.as_buffer() or b"" for t in some("text").cast(pa.binary()))),
                }
                yield pa.RecordBatch.from_pylist([row])
                n += 1

    chunks = durable(rows.mapInArrow(cut, "chunk long, doc_id binary, no_id binary, held_out binary, size binary, z binary"), options=SMALL_GROUPS)

    def tokens(size: bytes, z: bytes) -> Tokens:
        ends = np.cumsum(np.frombuffer(size, dtype="<i8")).tolist()
        raw = zstandard.ZstdDecompressor().decompress(z, max_output_size=max(1, ends[-1]))
        return Tokens.by_pieces([raw[a:z] for a, z in zip([0, *ends], ends)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, size, z in zip(*b.columns, strict=True):
                t = tokens(size.as_py(), z.as_py())
                for kind, key in ((1, np.unique(t.hash)), (2, np.unique(t.pairs()))):
                    home = bucket_of(key, buckets)
                    first = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
                    edge = pa.array(np.append(first, len(key)) * 8, pa.int32())
                    keys = pa.Array.from_buffers(pa.binary(), len(first), [None, edge.buffers()[1], pa.py_buffer(key.astype("<u8"))])
                    yield pa.RecordBatch.from_arrays([pa.array(home[first]), pa.array(np.full(len(first), chunk.as_py())), pa.array(np.full(len(first), kind, np.int8)), keys], ["bucket", "chunk", "kind", "keys"])

    asked = chunks.select("chunk", "size", "z").mapInArrow(ask, "bucket long, chunk long, kind byte, keys binary")

    def answer(asks: pa.Table, part: pa.Table) -> pa.Table:
        """All keys of a bucket are looked up together; exact counts are told of words only."""
        if not len(asks):
            return pa.Table.from_pylist([], schema=told)
        raw = asks["keys"].to_pylist()
        key, ends = np.frombuffer(b"".join(raw), dtype="<u8"), np.cumsum([len(k) // 8 for k in raw]).tolist()
        one = Part(part.to_pylist()) if len(part) else None
        word = np.repeat(asks["kind"].to_numpy() == 1, np.diff([0, *ends]))
        level, exact = np.zeros(len(key), dtype=np.uint8), np.zeros(len(key), dtype="<i8")
        if one:
            level[:], exact[word] = one.level(key), one.exact(key[word])
        spans = list(zip([0, *ends], ends, asks["kind"].to_pylist()))
        return pa.table([asks["bucket"], asks["chunk"], asks["kind"], pa.array([level[a:z].tobytes() for a, z, _ in spans]), pa.array([exact[a:z].tobytes() if kind == 1 else None for a, z, kind in spans], pa.binary())], schema=told)

    names = "bucket long, chunk long, kind byte, level binary, exact binary"
    told = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int8()), ("level", pa.binary()), ("exact", pa.binary())])
    answers = asked.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(answer, names)

    def finish(some: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in some.to_dict("records"):
            t = tokens(r["size"], r["z"])
            _, which = np.unique(t.hash, return_inverse=True)
            mine = found.sort_values("bucket")
            words, pairs = mine[mine["kind"] == 1], mine[mine["kind"] == 2]
            exact = np.frombuffer(b"".join(words["exact"]), dtype="<i8")
            word_level = np.frombuffer(b"".join(words["level"]), dtype=np.uint8)
            _, back = np.unique(t.pairs(), return_inverse=True)
            pair_level = np.frombuffer(b"".join(pairs["level"]), dtype=np.uint8)[back]
            ids = pd.arrays.IntegerArray(np.frombuffer(r["doc_id"], dtype="<i8").copy(), np.frombuffer(r["no_id"], dtype=bool).copy())
            out.append(pd.DataFrame({"doc_id": ids, "held_out": np.frombuffer(r["held_out"], dtype=bool), "train_tokens": scorer.total} | scorer.rows(t, which, exact, word_level, pair_level)))
        return pd.concat(out)[["doc_id", "held_out", *[c.split()[0] for c in _MADE.split(", ")]]]

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(finish, "doc_id long, held_out boolean, " + _MADE)
