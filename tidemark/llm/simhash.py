"""Operator 5: SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into six blocks of 10 or 11. Two fingerprints that differ in at most
four bits agree wholly in two of the six blocks. The other 42 to 44 bits are cut into two segments of
21 or 22 bits, of which one differs in at most two bits. Such a segment is decoded with the perfect
binary Golay code (23, 12, 7): its keys are the indices of all code words within distance four, which
is one or six of them. If two segments differ in at most two bits, a vector between them lies within
three bits of some code word, and so both lie within four bits of it: they share a key. A pair that
must be found therefore shares the bits of two blocks and a code word's index in at least one of the
thirty (pair of blocks, segment) tables; each candidate is then verified by counting the differing
bits. No pair within four bits is missed. Keys have 32 to 34 bits, so few fingerprints share one by
chance up to some billions of them, and the work grows with the rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, durable, map_texts, named, row_hash, whole_row

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: First bit and number of bits of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of each 23-bit vector's low 12 and high 11 bits, error patterns of each syndrome).

    ``patterns[s]`` holds the vectors of weight at most four with syndrome ``s``, padded by
    repeating the first; xor-ing one onto a vector gives a code word within distance four.
    """
    rem = np.zeros(23, dtype=np.uint32)
    for i in range(23):
        x = 1 << i
        for j in range(i, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        rem[i] = x

    def table(bits: range) -> np.ndarray:
        out = np.zeros(1 << len(bits), dtype=np.uint32)
        for k, b in enumerate(bits):
            out[1 << k : 2 << k] = out[: 1 << k] ^ rem[b]
        return out

    found: list[list[int]] = [[] for _ in range(2048)]
    vectors = [(0, 0, -1)]
    for _ in range(5):
        for v, s, _top in vectors:
            found[s].append(v)
        vectors = [(v | 1 << b, s ^ int(rem[b]), b) for v, s, top in vectors for b in range(top + 1, 23)]
    patterns = np.array([(f + f[:1] * 6)[:6] for f in found], dtype=np.uint32)
    return table(range(12)), table(range(12, 23)), patterns


def segment_keys(seg: np.ndarray, tables=None) -> np.ndarray:
    """Indices (0 to 4095) of the code words within distance four of each 23-bit vector: n x 6, with repeats."""
    low, high, patterns = tables or golay_tables()
    words = seg[:, None].astype(np.uint32) ^ patterns[low[seg & 0xFFF] ^ high[seg >> 12]]
    return words >> 11  # the code is systematic: the upper 12 bits of a code word name it


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the whole text; null or no words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - SHINGLE].tolist()]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)), np.uint64, n - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(texts: list) -> np.ndarray:
    return np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, one row per input row; ``fp`` is the fingerprint as a signed 64-bit integer."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(kept, lambda texts: {"fp": _signed(texts)}, "fp long")


def golay_keys(prints: DataFrame) -> DataFrame:
    """``(key, fp)``: the keys of each distinct fingerprint in the thirty (pair of blocks, segment) tables."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = golay_tables()
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for i in range(0, len(fp), 20_000):
                part = fp[i : i + 20_000]
                yield from _keys_of(part, tables)

    return prints.select("fp").mapInPandas(run, "key long, fp long")


def _keys_of(signed: np.ndarray, tables) -> Iterator[pd.DataFrame]:
    bits = signed.view(np.uint64)
    part = [(bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in BLOCKS]
    for t, pair in enumerate(itertools.combinations(range(len(BLOCKS)), 2)):
        exact = part[pair[0]] << BLOCKS[pair[1]][1] | part[pair[1]]
        rest = [k for k in range(len(BLOCKS)) if k not in pair]
        for s, (one, two) in enumerate((rest[:2], rest[2:])):
            idx = np.sort(segment_keys(part[one] << BLOCKS[two][1] | part[two], tables).astype(np.int64), axis=1)
            new = np.ones(idx.shape, dtype=bool)
            new[:, 1:] = idx[:, 1:] != idx[:, :-1]
            key = (np.int64(2 * t + s) << 34 | exact[:, None] << 12) | idx
            yield pd.DataFrame({"key": key[new], "fp": np.repeat(signed, 6).reshape(idx.shape)[new]})


def _close(a: str, b: str) -> str:
    return f"bit_count({a} ^ {b}) <= {MAX_BITS}"


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` that connect exactly the fingerprints that distance <= 4 connects.

    First every fingerprint is tied to the least one that shares a key with it (if within four bits):
    at most one link per key, so a dense ball of near-copies costs no pairs. Where a key's members
    still lie in several components, those outside the key's most frequent component are joined with
    all of the key's members in other components and verified. A pair in different components has
    such a member at one end at least, so nothing is lost, and a large group of copies, which is one
    component by then, is never joined with itself.
    """
    # the keys are made twice, which costs less than to write them; a merge join behaves alike at every size
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = golay_keys(prints.repartition(parts, "fp"))
    buckets = keys.groupBy("key").agg(F.min("fp").alias("pivot"), F.max("fp").alias("other"), F.count("*").alias("n"))
    # a key of two members is verified from the aggregate alone; only fuller keys are joined with their members
    buckets = durable(buckets.where("n > 2 or n = 2 and " + _close("pivot", "other")))
    pairs = buckets.where("n = 2").select(F.col("other").alias("src"), F.col("pivot").alias("dst"))
    shared = durable(keys.join(buckets.where("n > 2").select("key", "pivot").hint("merge"), "key"))
    stars = shared.where("fp <> pivot and " + _close("fp", "pivot")).select(F.col("fp").alias("src"), F.col("pivot").alias("dst"))
    first = durable(pairs.unionByName(stars).distinct())
    comp = durable(connected_components(first)).withColumnRenamed("node", "fp")
    named = durable(shared.select("key", "fp").join(comp, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("comp")))
    # The most frequent component of each key, from pre-aggregated counts; keys of one component are done.
    counts = named.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    open_ = named.join(main, "key")
    few = open_.where("comp <> main").select("key", F.col("fp").alias("src"), F.col("comp").alias("c1"))
    more = few.join(open_.select("key", F.col("fp").alias("dst"), F.col("comp").alias("c2")), "key").where("c1 <> c2 and " + _close("src", "dst"))
    return first.unionByName(more.select("src", "dst").distinct())


def _grouped(rows: DataFrame) -> DataFrame:
    """``(fp, comp, component_id)``: the group of each fingerprint of a durable ``(doc_id, fp)``; ``comp`` names the group, ids or not."""
    prints = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    comp = durable(connected_components(fingerprint_links(prints))).withColumnRenamed("node", "fp")
    named = prints.join(comp, "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("comp"))
    root = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    return named.join(root, "comp").select("fp", "comp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)``, one row per input row.

    Fingerprints over 4-word shingles (A-Z lower-cased, repeats included) link at four or fewer
    differing bits; ``component_id`` is the least ``doc_id`` reachable over links. Equal fingerprints
    are one node, so exact copies and documents without words (fingerprint zero, linked like any
    other) cost one row each. Null texts count as empty; rows with a null ``doc_id`` get a
    fingerprint and their group's component (null if the group has no id); repeated rows come out
    repeated; other columns are ignored; an empty table gives an empty result.
    """
    rows = durable(fingerprints(docs, id_col, text_col))
    classes = _grouped(rows).select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` of which one per near-duplicate group stays: the one with the least id.

    Among a group's rows that share the least id, the one with the least text hash stays, and among
    these the one with the least hash of the whole row; rows equal in all columns are one row. A
    group whose ids are all null keeps one row, by text hash. Groups are told apart by their
    fingerprints, so documents of different groups may share an id, or have none. Null and empty
    texts are one group; an empty table gives an empty result; columns pass through, whatever their
    names (each row travels as one struct, and meets the keepers once).
    """
    # null and empty texts differ in nothing here
    key = (F.coalesce(named(id_col).cast("long"), F.lit(0)).alias("id"), named(id_col).cast("long").isNull().alias("nil"), F.xxhash64(F.coalesce(named(text_col), F.lit(""))).alias("h"), row_hash(docs).alias("rh"))
    rows = durable(map_texts(docs.select(*key, named(text_col).alias("text")), lambda texts: {"fp": _signed(texts)}, "fp long"))
    groups = _grouped(rows.select(F.when(~F.col("nil"), F.col("id")).alias("doc_id"), "fp")).select("fp", "comp")
    # a group's keeper is chosen by partial aggregation, so a group of any size is one row per task
    keepers = rows.join(groups, "fp").groupBy("comp").agg(F.min(F.struct("nil", "id", "h", "rh")).alias("k")).select("k.*")
    # equal texts are in one group, so id and hashes name the keeper of one group only
    kept = docs.select(*key, whole_row(docs).alias("row")).join(durable(keepers), ["id", "nil", "h", "rh"], "left_semi")
    return kept.groupBy("id", "nil", "h", "rh").agg(F.first("row").alias("row")).select("row.*")  # equal rows, one of them
