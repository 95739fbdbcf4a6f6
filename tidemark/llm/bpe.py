"""Operator 2: BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks at places that depend on the content
alone, so copied passages give the same chunks in every document. A worker encodes each distinct
chunk once and keeps it in a bounded store (evicting an entry costs time, never a result). A chunk's
encoding is put together from its words', which the library gives and a store keeps, too: white space
never enters a token, which is checked when the tokenizer is loaded.

A cut may fall inside a word, so a chunk's first and last piece of word are left open. Such joins are
repaired by encoding a window around the cut as one text: one whole word on each side and the joined
word between. If the window's outer words agree exactly with the chunks' own encodings, its middle is
the repair. If not, the window is widened, first to all whole words of both chunks, at last to the
text. Decoding goes from the ids alone.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: A cut follows a byte where the low bits of the rolling hash are all zero: one in 2,048.
CUT_BITS = 11
#: Bytes of ids and tokens that a worker keeps for chunks, and for words.
CHUNK_BYTES, WORD_BYTES = 32 << 20, 128 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MIX = np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint32)
#: A plain word's pieces: a run of letters, one digit, a run of marks (no apostrophe, no "<").
_RUN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:;=>?@\[-`{-~]+")


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of chunks in an array of bytes, by a rolling hash over the last 16 bytes (log-many passes)."""
    h, power = _MIX[data], 0x9E3779B1
    for step in (1, 2, 4, 8):
        prev = h
        h = prev.copy()
        h[step:] += prev[:-step] * np.uint32(power)
        power = power * power & 0xFFFFFFFF
    return np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1


class _Store:
    """Two generations of entries; when the newer is full it becomes the older, which is dropped."""

    def __init__(self, bound: int):
        self.bound, self.held = bound // 2, 0
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key: bytes):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value, 0)
        return value

    def put(self, key: bytes, value, size: int) -> None:
        self.new[key] = value
        self.held += 250 + len(key) + size
        if self.held > self.bound:
            self.old, self.new, self.held = self.new, {}, 0


class Chunk(NamedTuple):
    """A chunk's encoding but for the pieces of words at its ends."""

    head: bytes  # up to the first white space; empty if the chunk begins with it
    tail: bytes
    ids: bytes  # of the whole words between
    words: bytes  # these words, one space between
    first: tuple[bytes, bytes]  # the first and the last of them, with their ids
    last: tuple[bytes, bytes]
    spaced: bool  # has white space at all


class ChunkCoder:
    """Encodes and decodes texts exactly as one tokenizers file does, reusing chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        if self.tok.decoder is not None:
            raise ValueError("a tokenizer with a decoder of its own is not supported: tokens are joined by spaces")
        names = {i: n.encode("utf-8") for n, i in self.tok.get_vocab().items()}
        self.names = [names.get(i, b"") for i in range(max(names) + 1)]
        self.ends = np.array([n.endswith(b"</w>") for n in self.names])
        self.words, self.chunks = _Store(WORD_BYTES), _Store(CHUNK_BYTES)
        self.reused = self.encoded = self.widened = self.whole = 0
        self._check_white_space()

    def _check_white_space(self) -> None:
        """White space must part tokens and leave none behind, whatever stands around it."""
        sides = ["a", "don't", "Z9", "'s", "12", "#!", "é", "e\u0301", "\u0301", "中文", "🙂", "</w>", *(t.content for t in self.tok.get_added_tokens_decoder().values())]
        one = dict(zip(sides, self.encode_whole([x.encode() for x in sides]), strict=True))
        for gap in (" ", "\n", "\t \r\x0b\x0c"):
            pairs = [(x, y) for x in sides for y in sides]
            found = self.encode_whole([f"{gap}{x}{gap}{y}{gap}".encode() for x, y in pairs])
            if any(f != one[x] + one[y] for f, (x, y) in zip(found, pairs, strict=True)):
                raise ValueError("a tokenizer whose tokens hold or cross white space is not supported")

    def encode_whole(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, by the library alone."""
        return [_packed(e.ids) for e in self.tok.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """As ``encode_whole``, with plain words going to the library many at a time.

        A plain word is made of Latin letters, digits and ASCII marks, so the number of pieces that
        the library cuts it into is known, and each piece ends with a token that says so. A group
        whose pieces do not add up is encoded word by word.
        """
        out: list = [None] * len(words)
        plain, pieces, odd = [], [], []
        for k, w in enumerate(words):
            t = w.decode("utf-8", "surrogatepass")
            runs = _RUN.findall(t)
            if sum(map(len, runs)) == len(t):
                plain.append((k, t))
                pieces.append(len(runs))
            else:
                odd.append(k)
        groups = [(i, " ".join([t for _, t in plain[i : i + 256]])) for i in range(0, len(plain), 256)]
        for (i, _), e in zip(groups, self.tok.encode_batch_fast([g for _, g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            ends = np.flatnonzero(self.ends[ids]) + 1 if ids else np.zeros(0, dtype=np.int64)
            want = np.cumsum(pieces[i : i + 256])
            if len(ends) != want[-1] or ends[-1] != len(ids):
                odd += [k for k, _ in plain[i : i + 256]]
                continue
            raw, a = _packed(ids), 0
            for (k, _), b in zip(plain[i : i + 256], ends[want - 1].tolist(), strict=True):
                out[k] = raw[4 * a : 4 * b]
                a = b
        for k, v in zip(odd, self.encode_whole([words[k] for k in odd]), strict=True):
            out[k] = v
        return out

    def _learn(self, words) -> dict[bytes, bytes]:
        """Encodings of distinct words, from the store or the library."""
        have, known, new = {}, self.words, []
        for w in words:
            v = known.get(w)
            if v is None:
                new.append(w)
            else:
                have[w] = v
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for w, v in zip(part, self.encode_words(part), strict=True):
                have[w] = v
                known.put(w, v, len(v))
        return have

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """As ``encode_whole``, by chunks: the same ids for every text."""
        pieces = [self._split(t) for t in texts]
        local = {c: self.chunks.get(c) for p in pieces for c in p}
        fresh = [c for c, v in local.items() if v is None]
        self.reused += sum(map(len, pieces)) - len(fresh)
        self.encoded += len(fresh)
        words = [c.split() for c in fresh]
        have = self._learn({w for ws in words for w in ws})
        for c, ws in zip(fresh, words, strict=True):
            local[c] = v = self._chunk(c, ws, have)
            self.chunks.put(c, v, 2 * len(c) + len(v.ids))
        plans = [self._plan([local[c] for c in p]) for p in pieces]
        # every open word, with its narrowest window: (text, chunk before, chunk after)
        joins = [(k, j, plan[j - 1] if j else None, x, plan[j + 1] if j + 1 < len(plan) else None) for k, plan in enumerate(plans) for j, x in enumerate(plan) if isinstance(x, bytes)]
        repairs, bad = {}, set()
        for step in ("last", "all"):
            windows = [(self._edge(left, step, -1), x, self._edge(right, step, 0)) for _, _, left, x, right in joins]
            again = []
            for i in range(0, len(joins), 5000):
                part = windows[i : i + 5000]
                for join, (left, _, right), ids in zip(joins[i : i + 5000], part, self.encode_whole([b" ".join([w for w in (left[0], x, right[0]) if w]) for left, x, right in part]), strict=True):
                    if ids.startswith(left[1]) and ids.endswith(right[1]) and len(ids) >= len(left[1]) + len(right[1]):
                        repairs[join[:2]] = ids[len(left[1]) : len(ids) - len(right[1])]
                    else:
                        again.append(join)
            joins = again
            self.widened += len(joins)
        bad = {join[0] for join in joins}
        out = [b"" if k in bad else b"".join([repairs[k, j] if isinstance(x, bytes) else x.ids for j, x in enumerate(plan)]) for k, plan in enumerate(plans)]
        for k in bad:  # the widest window is the text itself
            self.whole += 1
            out[k] = self.encode_whole([texts[k]])[0]
        return out

    @staticmethod
    def _edge(chunk: Chunk | bytes | None, step: str, side: int) -> tuple[bytes, bytes]:
        """(words, ids) of the whole words next to a join: one, or all of the chunk's; none beside another join."""
        if not isinstance(chunk, Chunk):
            return b"", b""
        return (chunk.words, chunk.ids) if step == "all" else (chunk.last if side else chunk.first)

    @staticmethod
    def _split(text: bytes) -> list[bytes]:
        if not text:
            return []
        data = np.frombuffer(text, dtype=np.uint8)
        ends = cuts(data)
        ends = ends[ends < len(data)]
        ends = ends[(data[ends] & 0xC0) != 0x80].tolist()  # never inside a character
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]

    @staticmethod
    def _chunk(c: bytes, ws: list[bytes], have) -> Chunk:
        none = b"", b""
        if not ws:
            return Chunk(b"", b"", b"", b"", none, none, True)
        first, last = not _SPACE[c[0]], not _SPACE[c[-1]]
        if first and last and len(ws) == 1:
            return Chunk(c, b"", b"", b"", none, none, False)
        mid = ws[first : len(ws) - last]
        ids = [have[w] for w in mid]
        ends = ((mid[0], ids[0]), (mid[-1], ids[-1])) if mid else (none, none)
        return Chunk(ws[0] if first else b"", ws[-1] if last else b"", b"".join(ids), b" ".join(mid), *ends, True)

    @staticmethod
    def _plan(chunks: list[Chunk]) -> list:
        """What a text is put together from: chunks that have whole words, and the open words between."""
        plan: list = []
        open_ = b""
        for c in chunks:
            if not c.spaced:
                open_ += c.head
                continue
            plan.append(open_ + c.head)
            if c.words:
                plan.append(c)
            open_ = c.tail
        plan.append(open_)
        return [x for x in plan if x != b""]

    def decode(self, ids: bytes) -> bytes:
        """Tokens of the ids, joined by spaces: what the library's decode gives without a decoder."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_coders: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    """One coder per worker process; its stores serve one task at a time."""
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
    return _coders[path]


def _forget() -> None:
    """Empty the stores: a worker that waits, or runs other operators' tasks, holds no memory for them."""
    for c in _coders.values():
        c.words, c.chunks = _Store(WORD_BYTES), _Store(CHUNK_BYTES)


def _coded(texts: list, tokenizer: str, rows: int) -> Iterator[tuple[ChunkCoder, list[bytes]]]:
    c = coder(tokenizer)
    for i in range(0, len(texts), rows):
        yield c, c.encode_batch([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts[i : i + rows]])


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``, one row per input row.

    ``tokenizer`` is the path of a tokenizers file that every worker can open. ``ids`` are the token
    ids of the whole text as little-endian unsigned 32-bit integers (binary, no special tokens
    added), ``decoded`` is their decoding in UTF-8 (binary). A null text counts as empty: no tokens.
    Rows may repeat, ids may be null or large, other columns are ignored whatever their names, an
    empty table gives an empty result. No shuffle; memory is bounded by the stores and by ``rows``
    texts at a time.
    """

    def make(texts: list) -> dict:
        done = [(ids, c.decode(ids)) for c, some in _coded(texts, tokenizer, rows) for ids in some]
        return {"n_tokens": [len(i) // 4 for i, _ in done], "ids": [i for i, _ in done], "decoded": [d for _, d in done]}

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(kept, make, "n_tokens long, ids binary, decoded binary", rows=rows, end=_forget)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``encode``'s result, hashed where it is made."""

    def make(texts: list) -> dict:
        done = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()) for c, some in _coded(texts, tokenizer, rows) for ids in some]
        return dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), map(list, zip(*done, strict=True)), strict=True))

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(kept, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows=rows, end=_forget)
