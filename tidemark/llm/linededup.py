"""Operator 8: substring dedup by hashing paragraphs of whole lines and sentences.

Each text is cut into pieces: lines, cut again after sentence ends and before capitalised words, so
that a passage pasted into the middle of a line starts a piece of its own. Words are normalised (lower
case, white space collapsed, punctuation at word edges dropped). The unit that is hashed is a
paragraph: the fewest neighbouring pieces from one piece on that hold ``UNIT_WORDS`` words. 128-bit
digests are grouped globally; the earliest occurrence, ranked by document id and then place, stays.
Later ones that overlap or follow one another are one span, and a span goes if it has ``LEAST_WORDS``
words. What goes is given by offsets into the original text.

So a passage is seen whatever the length of its pieces, and a short line that many documents share
does not touch them: in the check tables lines of 9 to 13 words stand in up to one document of eight,
and cutting single lines touched 28 % of all documents that have no longer repetition. Of a passage
less than ``UNIT_WORDS`` words may stay at its end, and what stands beside its whole pieces. In
scripts without spaces every letter counts as a word. Digests are polynomials over word hashes, so
those of all paragraphs of many texts come from two running sums.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, named, slices, whole_row

#: Words of a paragraph, and of a span that goes, at the least.
UNIT_WORDS, LEAST_WORDS = 7, 20
#: Letters of scripts without spaces; ends of sentences that need white space after them, and that need none; what may close a sentence.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿々-〇ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]")
_END, _WIDE_END, _CLOSE = ".!?…।॥؟۔", "。！？।॥؟۔", "」』”’）"
_SPACE, _ALNUM, _UPPER, _LOWER, _WIDE, _ENDS, _WIDE_ENDS, _CLOSES = (1 << k for k in range(8))
_BASES = 0x5851F42D4C957F2D, 0xDA942042E4DD58B5
U = np.uint64


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(flags, random number of the lower-case letter) of each character of the basic plane; its last two stand for those beyond."""
    flags, low = np.zeros(1 << 16, dtype=np.uint8), np.arange(1 << 16)
    for k in range(1 << 16):
        c = chr(k)
        flags[k] = _SPACE * c.isspace() | _ALNUM * (c.isalnum() or c == "_" or k == 0xFFFF) | _UPPER * c.isupper() | _LOWER * c.islower()
        small = c.lower()
        if small != c and len(small) == 1:
            low[k] = ord(small)
        if k > 0xE00 and _UNSPACED.match(c):
            flags[k] |= _WIDE
    for marks, flag in ((_END, _ENDS), (_WIDE_END, _WIDE_ENDS), (_CLOSE, _CLOSES)):
        flags[[ord(c) for c in marks]] |= flag
    return flags, (np.random.default_rng(5).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) * U(2) + U(1))[low]


_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first powers of an odd base modulo 2^64, n at the least."""
    if base not in _power or len(_power[base]) < n:
        row = np.full(1 << max(18, (n - 1).bit_length()), base, dtype=np.uint64)
        row[0] = 1
        _power[base] = np.multiply.accumulate(row)
    return _power[base]


def _ranges(values: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[a:b] for each range: a polynomial, wherever the range lies."""
    up, down = _powers(base, len(values) + 1), _powers(pow(base, -1, 1 << 64), len(values) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return _mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def pieces(texts: list) -> dict[str, np.ndarray]:
    """Pieces that have words, of all texts in order: number of the text, start and end in it, and words.

    ``a`` and ``b`` give each piece's words in ``words``, the hashes of all normalised words.
    """
    flags, letters = _tables()
    whole = "\n".join([*((t or "") for t in texts), ""])
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    beyond = np.flatnonzero(cp > 0xFFFF)
    if len(beyond):  # pictures are no letters; what else lies there is
        far, cp = cp[beyond], cp.copy()
        cp[beyond] = np.where((far >= 0x1F000) & (far < 0x20000), 0xFFFE, 0xFFFF)
    f, values = flags[cp], letters[cp]
    if len(beyond):
        values[beyond] = _mix(far.astype(np.uint64))
    space, wide = (f & _SPACE) != 0, (f & _WIDE) != 0
    begins = ~space
    if wide.any():
        begins[1:] &= space[:-1] | wide[1:] | wide[:-1]
    else:
        begins[1:] &= space[:-1]
    start = np.flatnonzero(begins)
    stop = space.copy()
    stop |= begins
    end = np.flatnonzero(stop[1:] & ~space[:-1]) + 1  # the last character is a line break
    # a cut before a word: a line break, a sentence end, or a capitalised word
    cut = np.ones(len(start), dtype=bool)
    if len(start) > 1:
        breaks = np.cumsum(cp == 10, dtype=np.int32)
        gap, last, first = start[1:] > end[:-1], f[end[:-1] - 1], f[start[1:]]
        name = (first & _UPPER) != 0
        name &= (f[np.minimum(start[1:] + 1, len(f) - 1)] & _LOWER) != 0
        cut[1:] = (breaks[start[1:]] > breaks[end[:-1] - 1]) | gap & (((last & (_ENDS | _WIDE_ENDS)) != 0) | name)
        tight = ~gap & ((last & (_WIDE_ENDS | _CLOSES)) != 0)
        if tight.any():  # an end, or what closes it after an end, with no space behind it
            ended = (last & _WIDE_ENDS) != 0
            ended |= ((last & _CLOSES) != 0) & ((f[np.maximum(end[:-1] - 2, 0)] & _WIDE_ENDS) != 0)
            cut[1:] |= tight & ended & ((first & (_WIDE_ENDS | _CLOSES)) == 0)
    # words are what letters and digits a token has from the first to the last
    some = np.flatnonzero(f & _ALNUM)
    a, b = np.searchsorted(some, start), np.searchsorted(some, end)
    real = b > a
    piece = np.cumsum(cut) - 1
    hashes = np.zeros(0, dtype=np.uint64)
    if real.any():
        hashes = _ranges(values, some[a[real]], some[b[real] - 1] + 1, _BASES[0])
    n = np.bincount(piece[real], minlength=piece[-1] + 1 if len(piece) else 0)
    heads = np.flatnonzero(cut)
    tails = np.append(heads[1:], len(start)) - 1 if len(heads) else heads
    kept = np.flatnonzero(n)
    z = np.cumsum(n[kept])
    lengths = np.array([len(t) + 1 if t else 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    from_, to = start[heads[kept]], end[tails[kept]]
    text = np.searchsorted(ends, from_, side="right")
    shift = (ends - lengths)[text]
    return {"text": text, "start": from_ - shift, "end": to - shift, "n": n[kept], "a": z - n[kept], "b": z, "words": hashes}


def paragraphs(texts: list, unit: int = UNIT_WORDS) -> dict[str, np.ndarray]:
    """Every paragraph of all texts: number of the text, first and last piece, start, end, words before, words, digests."""
    p = pieces(texts)
    total = np.concatenate(([0], np.cumsum(p["n"]))).astype(np.int64)
    k = np.arange(len(p["n"]))
    first = np.searchsorted(p["text"], np.arange(len(texts)))  # a text's first piece
    past = np.searchsorted(p["text"], np.arange(len(texts)), side="right")
    ahead = np.searchsorted(total, total[:-1] + unit)  # pieces k to ahead - 1
    fits = ahead <= past[p["text"]]
    i, j = k[fits], ahead[fits]
    a, b = p["a"][i], p["b"][j - 1]
    text = p["text"][i]
    return {
        "text": text,
        "pos": i - first[text],
        "last": j - 1 - first[text],
        "start": p["start"][i],
        "end": p["end"][j - 1],
        "before": total[i] - total[first[text]],
        "words": total[j] - total[i],
        "hi": _ranges(_mix(p["words"]), a, b, _BASES[0]).view(np.int64),
        "lo": _ranges(p["words"], a, b, _BASES[1]).view(np.int64),
    }


def unit_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT_WORDS) -> DataFrame:
    """``(doc_id, row_hash, pos, last, start, end, before, words, hi, lo)``: every paragraph of every document."""
    ints = ("pos", "last", "start", "end", "before", "words")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in slices(texts, 1 << 19):
                found = paragraphs(texts[at], unit)
                rows = pa.array(found["text"] + at.start)
                columns = [batch.column("doc_id").take(rows), batch.column("row_hash").take(rows), *(pa.array(found[c].astype(np.int32)) for c in ints), pa.array(found["hi"]), pa.array(found["lo"])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_hash", *ints, "hi", "lo"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "doc_id long, row_hash long, " + ", ".join(f"{c} int" for c in ints) + ", hi long, lo long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, unit: int = UNIT_WORDS) -> DataFrame:
    """``(doc_id, row_hash, start, end, words, kept_doc_id)``: one row per span to remove.

    ``start`` and ``end`` are character offsets into the original text, ``kept_doc_id`` the document
    that keeps the earliest occurrence of the span's first paragraph. A paragraph goes if it occurred
    before, in an earlier document or earlier in this one; what overlaps its own earliest occurrence
    stays. Spans of fewer than ``least`` words stay. Documents rank by id, null last, then by text hash; rows that agree in id and text are one
    document. Null and empty texts, and texts of fewer than ``unit`` words, have no paragraph;
    documents without repeats give no row; an empty table gives an empty result; other columns are
    ignored. Texts are cut and hashed twice, once for the digests and once for the rows that meet them,
    which costs less than a table of all paragraphs would take.
    """
    rows = unit_table(docs, id_col, text_col, unit)
    rank = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "row_hash", "start")
    # Partial aggregation folds a hot digest into one row per task before the shuffle.
    place = F.struct(rank.alias("rank"), F.col("end").alias("to"), F.col("last").alias("last"), (F.col("before") + F.col("words")).alias("past"))
    first = rows.groupBy("hi", "lo").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1").select("hi", "lo", "f")
    later = rows.join(first, ["hi", "lo"]).where(rank > F.col("f.rank"))
    own = F.col("f.rank.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("f.rank.row_hash") == F.col("row_hash")) & (F.col("f.to") > F.col("start"))
    found = later.select(
        "doc_id",
        "row_hash",
        F.when(own, F.col("f.last") + 1).otherwise(F.col("pos")).alias("pos"),
        "last",
        F.when(own, F.col("f.to")).otherwise(F.col("start")).alias("start"),
        "end",
        F.when(own, F.col("f.past")).otherwise(F.col("before")).cast("long").alias("before"),
        (F.col("before") + F.col("words")).cast("long").alias("past"),
        F.col("f.rank.doc_id").alias("kept_doc_id"),
    ).where("pos <= last")
    in_order = Window.partitionBy("doc_id", "row_hash").orderBy("pos", "last", "kept_doc_id")
    reach = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce((F.col("pos") > reach + 1).cast("int"), F.lit(0)))
    found = found.withColumn("span", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = found.groupBy("doc_id", "row_hash", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("past") - F.min("before")).alias("words"), F.min_by("kept_doc_id", F.struct("pos", "last")).alias("kept_doc_id"))
    return spans.where(F.col("words") >= least).drop("span")


def cut_spans(text: str | None, starts, ends) -> str | None:
    """The text without the spans; where a whole line went, its line break goes too."""
    if text is None or starts is None or not len(starts):
        return text
    out, at = [], 0
    for a, b in sorted(zip(starts, ends, strict=True)):
        out.append(text[at:a])
        at = b
        whole_line = (a == 0 or text[a - 1] == "\n") and (b == len(text) or text[b] == "\n")
        if whole_line and b < len(text):
            at += 1
    out.append(text[at:])
    return "".join(out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, unit: int = UNIT_WORDS) -> DataFrame:
    """``docs`` with later occurrences of repeated passages cut out of the text; no row is dropped.

    A document of which nothing is left keeps its row with an empty text. Rows with a null id are
    matched by null-safe equality, null texts stay null, other columns pass through, whatever their
    names (each row travels as one struct). Repeated rows are cut alike.
    """

    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        both = ((t.as_py(), s.as_py()) for t, s in zip(text, spans, strict=True))  # one text at a time, however many a batch holds
        return pa.array([t if s is None else cut_spans(t, [x["start"] for x in s], [x["end"] for x in s]) for t, s in both], pa.string())

    spans = repeated_spans(docs, id_col, text_col, least, unit)
    spans = durable(spans.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    rows = docs.select(whole_row(docs).alias("row"), named(id_col).cast("long").alias("id"), F.xxhash64(named(text_col)).alias("h"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("row_hash")), "left")
    text = F.col("row")[text_col]
    cut = F.when(F.col("spans").isNull(), text).otherwise(F.arrow_udf(run, "string")(text, "spans"))
    return joined.select(*[cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
