"""Operator 11: exact substring deduplication with suffix arrays of shards.

A byte goes if a string of 50 bytes covers it that also starts in a document with a smaller id. Texts
are held in chunks of some megabytes. Each 50-byte window is named by its anchor, the least hash of
the 16-byte strings in it; equal windows have equal anchors, and windows in a row share one. A window
can repeat only if its anchor does, so the anchors' hashes are exchanged first, packed. Then the
stretches of text whose windows share an anchor that documents share, each distinct one of a chunk
once, go to the anchor's shard, so that all occurrences of any 50-byte string meet in one shard. There
induced sorting gives the suffix array (``suffixes``), permuted common prefixes cut it into classes of
equal windows, and the least document id of each class goes back to the chunks that asked.

What a chunk sends is bounded by its text, and a passage that every document holds is sent once per
chunk, not per document; a shard holds distinct stretches, and a few numbers per chunk that holds one.
Texts that a smaller id has word for word go as a whole and send nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .suffixes import permuted_common_prefixes, suffix_array

#: Bytes of a string whose repetition counts, of the strings that anchors are hashed from, and windows of a stretch at most.
LENGTH, GRAM, RUN = 50, 16, 64
#: Bytes of a chunk, windows that are looked at together, bytes of a shard's suffix array, and anchors of a bucket at least.
CHUNK, SLICE, SHARD, BUCKET = 8 << 20, 1 << 16, 3 << 20, 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_KEY = np.uint64((1 << 48) - 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of several megabytes: ids, where each text ends, its digest, and the texts in one compressed piece."""
    base, no = TaskContext.get().partitionId() << 32, 0
    ids: list[int] = []
    texts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal ids, texts, held, no
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        digests = b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts)
        out = [[base + no], [held], [np.array(ids, np.int64).tobytes()], [ends.tobytes()], [digests], [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))]]
        ids, texts, held, no = [], [], 0, no + 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["chunk", "size", "ids", "ends", "digests", "z"])

    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            t = t.as_py() or b""
            if ids and (held + len(t) > CHUNK or len(ids) >= 1 << 16):
                yield flush()
            ids.append(i)
            texts.append(t)
            held += len(t)
    if ids:
        yield flush()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(chunk, at, doc_id, digest)`` of each text of a chunk."""
    for b in batches:
        for row in b.to_pylist():
            ids, d = np.frombuffer(row["ids"], np.int64), row["digests"]
            digests = [d[i : i + 16] for i in range(0, len(d), 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["chunk"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids), pa.array(digests, pa.binary())], ["chunk", "at", "doc_id", "digest"])


def _copies(chunks: DataFrame) -> DataFrame:
    """``(chunk, copies)``: of each chunk, the places of texts that a smaller id has word for word."""
    texts = chunks.select("chunk", "ids", "digests").mapInArrow(_texts, "chunk long, at int, doc_id long, digest binary")
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    return texts.join(first, "digest").where("doc_id > least").groupBy("chunk").agg(F.collect_list("at").alias("copies"))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends, bytes) of a chunk."""
    raw = zstandard.ZstdDecompressor().decompress(row["z"], max_output_size=max(1, row["size"])) if row["size"] else b""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64), np.frombuffer(raw, np.uint8)


def anchors(x: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A 48-bit name for each window of ``length`` bytes: its least hash of GRAM bytes, mixed once more."""
    h = (x.astype(np.uint64) + np.uint64(1)) * _A
    span = 1
    while span < GRAM:
        h = h[:-span] * _B + (h[span:] ^ (h[span:] >> np.uint64(31)))
        span *= 2
    h ^= h >> np.uint64(29)
    h *= _A
    h ^= h >> np.uint64(32)
    width, n = length - GRAM + 1, len(x) - length + 1
    least, span = h, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    least = (least ^ (least >> np.uint64(30))) * _B
    return (least ^ (least >> np.uint64(27))) & _KEY


def stretches(x: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document number, first window, windows, anchor) of each stretch, slice by slice of the windows of a chunk."""
    for a in range(0, len(x) - length + 1, SLICE):
        key = anchors(x[a : a + SLICE + length - 1], length)
        whole = np.ones(len(key), dtype=bool)
        near = ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, a + len(key) + length)] - a
        out = (near[:, None] - np.arange(1, length)).ravel()  # a window that leaves its document is none
        whole[out[(out >= 0) & (out < len(key))]] = False
        same = key[1:] == key[:-1]
        first, last = whole.copy(), whole.copy()
        first[1:] &= ~(whole[:-1] & same)
        last[:-1] &= ~(whole[1:] & same)
        begin = np.flatnonzero(first)
        n = np.flatnonzero(last) + 1 - begin
        if len(n) and n.max() > RUN:
            parts = -(-n // RUN)
            no = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, n = np.repeat(begin, parts) + RUN * no, np.minimum(RUN, np.repeat(n, parts) - RUN * no)
        yield np.searchsorted(ends, begin + a, side="right"), begin + a, n, key[begin]


def _six(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _keys(six: bytes) -> np.ndarray:
    out = np.zeros((len(six) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _send_anchors(buckets: int, length: int):
    """Each chunk's distinct anchors by bucket: those of one of its documents, and those of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, ends, x = _unpacked(row)
                docs, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for d, _, _, k in stretches(x, ends, length):
                    docs.append(d)
                    keys.append(k)
                d, k = np.concatenate(docs), np.concatenate(keys)
                if not len(k):
                    continue
                order = np.lexsort((d, k))
                d, k = d[order], k[order]
                first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                last = np.append(first[1:], len(k)) - 1
                several = d[first] != d[last]
                k = k[first]
                home = (k % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                k, several, home = k[order], several[order], home[order]
                found = np.unique(home)
                cut = list(zip(np.searchsorted(home, found), np.searchsorted(home, found, side="right"), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([row["chunk"]] * len(found), pa.int64()), pa.array([_six(k[i:j][~several[i:j]]) for i, j in cut], pa.binary()), pa.array([_six(k[i:j][several[i:j]]) for i, j in cut], pa.binary())], ["bucket", "chunk", "once", "more"])

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket: to each chunk, those of its anchors that several documents hold."""
    once, more = [_keys(x) for x in table["once"].to_pylist()], [_keys(x) for x in table["more"].to_pylist()]
    every = np.sort(np.concatenate(once))
    shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *more]))
    del every
    out = []
    for a, b in zip(once, more, strict=True):
        both = np.concatenate([a, b])
        at = np.minimum(np.searchsorted(shared, both), max(0, len(shared) - 1))
        out.append(_six(both[shared[at] == both]) if len(shared) else b"")
    kept = [k for k, x in enumerate(out) if x]
    return pa.table({"chunk": table["chunk"].take(pa.array(kept, pa.int64())), "shared": pa.array([out[k] for k in kept], pa.binary())})


def _numbered(row: dict, length: int) -> Iterator[tuple]:
    """Slices of a chunk's stretches that may repeat: (bytes, document numbers, first windows, windows, content's number, its anchor, contents so far).

    Contents are numbered by first occurrence, alike in every pass over the chunk. Texts that a
    smaller id has word for word are left out: they go as a whole.
    """
    _, ends, x = _unpacked(row)
    raw = x.tobytes()
    shared = np.sort(np.concatenate([_keys(s) for s in row["shared"]]))
    first = np.ones(len(ends), dtype=bool)
    first[row["copies"] or []] = False
    numbers: dict[bytes, int] = {}
    for d, at, n, k in stretches(x, ends, length):
        good = np.flatnonzero((shared[np.minimum(np.searchsorted(shared, k), len(shared) - 1)] == k) & first[d])
        d, at, n, k = d[good], at[good], n[good], k[good]
        no = np.fromiter((numbers.setdefault(raw[i:j], len(numbers)) for i, j in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)), np.int64, len(at))
        yield x, d, at, n, no, k, numbers


def _send_stretches(shards: int, length: int):
    """Each chunk's distinct stretches that may repeat, to their anchors' shards, with the least and the largest id that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, parts, numbers = np.frombuffer(row["ids"], np.int64), [], {}
                for _, d, _, _, no, k, numbers in _numbered(row, length):
                    parts.append((ids[d], no, k))
                if not numbers:
                    continue
                i, no, k = (np.concatenate(c) for c in zip(*parts, strict=True))
                least, most = np.full(len(numbers), np.iinfo(np.int64).max), np.full(len(numbers), np.iinfo(np.int64).min)
                np.minimum.at(least, no, i)
                np.maximum.at(most, no, i)
                home = np.zeros(len(numbers), dtype=np.int64)
                home[no] = (k % np.uint64(shards)).astype(np.int64)
                contents = list(numbers)
                order = np.argsort(home, kind="stable")
                found, first = np.unique(home[order], return_index=True)
                packed = []
                for a, z in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                    own = order[a:z]
                    texts = [contents[i] for i in own.tolist()]
                    head = np.concatenate([[len(own)], own, [len(t) for t in texts], least[own], most[own]]).astype(np.int64)
                    packed.append(zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(texts)))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), row["chunk"], np.int64)), pa.array(packed, pa.binary())], ["shard", "chunk", "sent"])

    return run


def first_anchors(contents: list[bytes], length: int = LENGTH) -> np.ndarray:
    """The anchor that all windows of each stretch share."""
    size = np.array([len(c) for c in contents], dtype=np.int64)
    return anchors(np.frombuffer(b"".join(contents), np.uint8), length)[np.cumsum(size) - size]


def least_of_windows(contents: list[bytes], least: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(least id of each window's class, where each content's windows begin): suffix array, common prefixes, classes."""
    size = np.array([len(c) for c in contents], dtype=np.int64)
    text = np.frombuffer(b"\0".join([*contents, b""]), np.uint8).astype(np.int16)
    start = np.cumsum(size + 1) - size - 1
    of = np.repeat(np.arange(len(size)), size + 1)
    text += 2
    text[start + size] = 1  # ends every match
    s = np.append(text, 0).astype(np.int16)
    order = suffix_array(s, 258)
    shared = permuted_common_prefixes(s, order, 1)
    new = shared[order] < length
    ranked = order[:-1] if order[-1] == len(text) else order[order < len(text)]
    new = new[order < len(text)]
    room = (start + size)[of[ranked]] - ranked
    is_window = room >= length
    group = np.cumsum(new)[is_window]
    at = ranked[is_window]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    low = np.minimum.reduceat(least[of[at]], first)
    out = np.empty(len(text), dtype=np.int64)
    out[at] = np.repeat(low, np.diff(np.append(first, len(group))))
    windows = size - length + 1
    begin = np.cumsum(windows) - windows
    return out[np.repeat(start - begin, windows) + np.arange(int(windows.sum()))], np.append(begin, windows.sum())


def _answer(length: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one shard: to each chunk, the least id of each window's class, for the stretches in which that makes a difference."""
        chunk, no, low_id, most, which = [], [], [], [], []
        numbers: dict[bytes, int] = {}
        for c, z in zip(table["chunk"].to_pylist(), table["sent"].to_pylist(), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(z)
            n = int(np.frombuffer(raw[:8], np.int64)[0])
            head = np.frombuffer(raw[8 : 8 + 32 * n], np.int64).reshape(4, n)
            edge = (8 + 32 * n + np.append(0, np.cumsum(head[1]))).tolist()
            chunk.append(np.full(n, c))
            no.append(head[0])
            low_id.append(head[2])
            most.append(head[3])
            which.append(np.fromiter((numbers.setdefault(raw[i:j], len(numbers)) for i, j in zip(edge, edge[1:])), np.int64, n))
        chunk, no, low_id, most, which = map(np.concatenate, (chunk, no, low_id, most, which))
        contents, bottom = list(numbers), np.iinfo(np.int64)
        del numbers
        least, top = np.full(len(contents), bottom.max), np.full(len(contents), bottom.min)
        np.minimum.at(least, which, low_id)
        np.maximum.at(top, which, most)
        # stretches that differ under one anchor are sorted; one that stands alone under its anchor equals itself only, and matters if two ids hold it
        _, same, held = np.unique(first_anchors(contents, length), return_inverse=True, return_counts=True)
        sorted_, alone = np.flatnonzero(held[same] > 1), np.flatnonzero((held[same] == 1) & (least < top))
        place = np.full(len(contents), -1)
        place[sorted_], place[alone] = np.arange(len(sorted_)), len(sorted_) + np.arange(len(alone))
        kept = place[which] >= 0
        if not kept.any():
            return pa.table({"chunk": pa.array([], pa.int64()), "answer": pa.array([], pa.binary())})
        chunk, no, most, which = chunk[kept], no[kept], most[kept], place[which[kept]]
        low, begin = least_of_windows([contents[i] for i in sorted_.tolist()], least[sorted_], length) if len(sorted_) else (np.empty(0, np.int64), np.zeros(1, np.int64))
        windows = np.fromiter((len(contents[i]) - length + 1 for i in alone.tolist()), np.int64, len(alone))
        low, begin = np.concatenate([low, np.repeat(least[alone], windows)]), np.concatenate([begin, begin[-1] + np.cumsum(windows)])
        lowest = np.minimum.reduceat(low, begin[:-1])
        told = np.flatnonzero(lowest[which] < most)
        told = told[np.argsort(chunk[told], kind="stable")]
        found, first = np.unique(chunk[told], return_index=True)
        packed = []
        for i, j in zip(first, np.append(first[1:], len(told)), strict=True):
            w = which[told[i:j]]
            n = (begin[1:] - begin[:-1])[w]
            flat = low[np.repeat(begin[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            packed.append(zstandard.ZstdCompressor(level=1).compress(np.concatenate([[len(w)], no[told[i:j]].astype(np.int64), n, flat]).tobytes()))
        return pa.table({"chunk": pa.array(found, pa.int64()), "answer": pa.array(packed, pa.binary())})

    return run


def _cut(length: int):
    """Spans and what is left, of each document of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            for row in b.to_pylist():
                ids, ends, x = _unpacked(row)
                gone = np.zeros(len(x) + 1, dtype=np.int32)
                starts = ends - np.diff(np.append(0, ends))
                copies = np.array(row["copies"] or [], dtype=np.int64)
                copies = copies[ends[copies] - starts[copies] >= length]
                gone[starts[copies]] += 1
                np.subtract.at(gone, ends[copies], 1)
                if row["answers"]:
                    told = [np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.int64) for z in row["answers"]]
                    no = np.concatenate([t[1 : 1 + t[0]] for t in told])
                    windows = np.concatenate([t[1 + t[0] : 1 + 2 * t[0]] for t in told])
                    low = np.concatenate([t[1 + 2 * t[0] :] for t in told])
                    begin = np.full(int(no.max()) + 1, -1)
                    begin[no] = np.cumsum(windows) - windows
                    for _, d, at, n, which, _, _ in _numbered(row, length):
                        asked = np.flatnonzero(np.append(begin, -1)[np.minimum(which, len(begin))] >= 0)
                        d, at, n, which = d[asked], at[asked], n[asked], which[asked]
                        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        later = low[np.repeat(begin[which], n) + step] < np.repeat(ids[d], n)
                        window = (np.repeat(at, n) + step)[later]
                        gone[window] += 1  # a window stands in one stretch
                        gone[window + length] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                edge[starts[starts < len(x)]] |= gone[starts[starts < len(x)]]  # runs end with their document
                stop = gone.copy()
                stop[:-1] &= ~gone[1:]
                stop[ends[ends > starts] - 1] |= gone[ends[ends > starts] - 1]
                begin, end = np.flatnonzero(edge), np.flatnonzero(stop) + 1
                of = np.searchsorted(ends, begin, side="right")
                offsets = pa.array(np.searchsorted(of, np.arange(len(ids) + 1)).astype(np.int32))
                spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(begin - starts[of]), pa.array(end - starts[of])], fields=list(span)))
                left, kept = x[~gone].tobytes(), np.append(0, np.cumsum(~gone))
                rest = [left[kept[i] : kept[j]] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ends - starts), spans, pa.array(rest, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``, one row per input row.

    ``spans`` are the maximal runs of removed bytes of the UTF-8 text, as offsets ``start`` and ``end``
    from 0, in order; ``kept`` is the rest, as bytes. A byte goes if a string of ``length`` bytes that
    covers it also starts in a document with a smaller id, judged on the whole input; matches never
    cross documents. Null texts are empty; texts shorter than ``length`` stay. Rows that share an id
    are equal in rank, so none of them takes bytes of another; a null id is neither smaller nor
    larger, so such rows keep all and take nothing. Other columns are ignored, whatever their names;
    an empty table gives an empty result. ``length`` is at least twice 16, less one.
    """
    if length < 2 * GRAM - 1:
        raise ValueError("length is too short for the anchors")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    nobody = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.col("text").alias("kept"))
    chunks = durable(rows.where("doc_id is not null").mapInArrow(_chunks, "chunk long, size long, ids binary, ends binary, digests binary, z binary"))
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    expected = 2 * size // (length - GRAM + 2) + 1
    # buckets and shards in proportion to the texts; buckets grow to 16 million anchors first, so that a chunk's rows stay well filled
    buckets = max(1, expected // min(16 << 20, max(BUCKET, expected // 2000)))
    sent = chunks.mapInArrow(_send_anchors(buckets, length), "bucket long, chunk long, once binary, more binary")
    shared = sent.groupBy("bucket").applyInArrow(_shared_anchors, "chunk long, shared binary").groupBy("chunk").agg(F.collect_list("shared").alias("shared"))
    shared = durable(shared)  # of each chunk, some of its own anchors
    taken = shared.agg(F.coalesce(F.sum(F.aggregate("shared", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))), F.lit(0))).first()[0]
    shards = max(1, taken // 6 * (length + RUN // 3) // (2 * SHARD))
    copies = durable(_copies(chunks))
    asking = chunks.drop("digests").join(shared, "chunk").join(copies, "chunk", "left")
    wanted = asking.mapInArrow(_send_stretches(shards, length), "shard long, chunk long, sent binary")
    answers = wanted.groupBy("shard").applyInArrow(_answer(length), "chunk long, answer binary").groupBy("chunk").agg(F.collect_list("answer").alias("answers"))
    done = chunks.drop("digests").join(shared, "chunk", "left").join(copies, "chunk", "left").join(durable(answers), "chunk", "left").mapInArrow(_cut(length), "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return done.unionByName(nobody)
