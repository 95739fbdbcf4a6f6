"""Operator 10: media columns; audio with log-mel features and active spans.

Bytes become the samples of an 8-bit mono WAV file in a binary column. Features are computed from
the file that is read back: the signal is resampled by a polyphase filter, overlapping frames go
through a mel filterbank, and a frame energy with hysteresis cuts out active spans. Every span is cut
into consecutive windows, each a time span and a tensor of fixed shape, so that all its frames are
kept; a row's tensors are stored as an Arrow IPC stream whose column is of Arrow's fixed-shape tensor
type, beside the windows' times. A long signal is resampled and framed in pieces.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

UNIT, RATE, UP, DOWN, TAPS = 64, 16_000, 5, 8, 16
FRAME, HOP, MELS, SLOTS = 256, 128, 20, 8
#: A span opens at a frame this many deviations above the mean log energy and closes as far below it.
OPEN, CLOSE = 0.25, 0.25
#: Frames of a piece of a signal, a multiple of UP; bytes of signals whose results are held together.
_PIECE, _BATCH = 5120, 1 << 20


def payload(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes with zero bytes up to a positive multiple of 64, number of bytes before that)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit mono WAV file."""
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("an 8-bit mono file is expected")
        return w.readframes(w.getnframes()), w.getframerate()


@functools.cache
def _phases() -> np.ndarray:
    """A windowed-sinc low-pass filter, one row of taps for each of the UP phases."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    h *= UP / h.sum()
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1])


def resample(x: np.ndarray, first: int = 0, count: int | None = None) -> np.ndarray:
    """``x`` at UP / DOWN of its rate: output m takes phase (m DOWN) mod UP around input m DOWN / UP.

    ``first``, a multiple of UP, and ``count`` ask for some of the outputs; only what they need is read.
    """
    n = -(-len(x) * UP // DOWN) - first if count is None else count
    base = first // UP * DOWN - TAPS // 2
    part = x[max(0, base) : base + -(-n * DOWN // UP) + DOWN + TAPS]
    padded = np.concatenate([np.zeros(max(0, -base)), part, np.zeros(DOWN + 2 * TAPS)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n)
    for k in range(min(UP, n)):  # outputs k, k + UP, ... share a phase
        at, phase = divmod(k * DOWN, UP)
        some = len(range(k, n, UP))
        out[k::UP] = windows[at : at + (some - 1) * DOWN + 1 : DOWN] @ _phases()[phase]
    return out


@functools.cache
def _mel_bank() -> np.ndarray:
    """Triangular filters, evenly spaced in mel from 0 to half the resampled rate."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    rise = (f - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    fall = (points[2:, None] - f) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.copy()


def log_mel(y: np.ndarray) -> np.ndarray:
    """Frames x MELS: log10 of mel energies of half-overlapping windowed frames; the end is padded with zeros."""
    n = _frames(len(y))
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y))])
    spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * np.hanning(FRAME), axis=1)
    return np.log10((spectrum.real**2 + spectrum.imag**2) @ _mel_bank() + 1e-6).astype(np.float32)


def _frames(n: int) -> int:
    return max(1, -(-max(0, n - FRAME) // HOP) + 1)


def mel_frames(samples: bytes) -> np.ndarray:
    """Frames x MELS of the whole signal of 8-bit samples, in pieces of ``_PIECE`` frames."""
    x = np.frombuffer(samples, dtype=np.uint8)
    length = -(-len(x) * UP // DOWN)
    n = _frames(length)
    out = np.empty((n, MELS), dtype=np.float32)
    for f in range(0, n, _PIECE):
        last = min(f + _PIECE, n)
        first, past = f * HOP, min((last - 1) * HOP + FRAME, length)
        # a piece of the samples holds what its outputs reach, and its own start is a whole number of phases
        lo = max(0, first // UP * DOWN - DOWN * TAPS) // DOWN * DOWN
        some = (x[lo : past * DOWN // UP + DOWN * TAPS].astype(np.float64) - 128) / 128
        out[f:last] = log_mel(resample(some, first - lo // DOWN * UP, past - first))
    return out


def spans(energy: np.ndarray) -> np.ndarray:
    """(first, past last) frames of the spans that open above and close below the two thresholds."""
    mean, dev = energy.mean(), energy.std()
    mark = np.where(energy >= mean + OPEN * dev, 1, np.where(energy < mean - CLOSE * dev, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    edge = np.diff(np.concatenate(([0], on, [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


_TENSOR = pa.fixed_shape_tensor(pa.float32(), [SLOTS, MELS])
_SCHEMA = pa.schema([("start_us", pa.int64()), ("end_us", pa.int64()), ("log_mel", _TENSOR), ("frames", pa.int32())])


def windows(found: np.ndarray) -> np.ndarray:
    """(first, past last) frames of consecutive windows of SLOTS frames over each span; a span's last may be shorter."""
    count = -(-(found[:, 1] - found[:, 0]) // SLOTS)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(found[:, 0], count) + nth * SLOTS
    return np.stack([first, np.minimum(first + SLOTS, np.repeat(found[:, 1], count))], axis=1)


def span_tensors(mel: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Windows x SLOTS x MELS: all frames of each window; zeros after a window's end."""
    place = cut[:, :1] + np.arange(SLOTS)
    out = mel[np.minimum(place, len(mel) - 1)]
    out[place >= cut[:, 1:]] = 0
    return out


def to_ipc(found: np.ndarray, tensors: np.ndarray) -> bytes:
    """An Arrow IPC stream of (start_us, end_us, fixed-shape tensor, frames in it), one row per window."""
    us = 1e6 * DOWN / UP / RATE
    storage = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), SLOTS * MELS)
    columns = [pa.array((found[:, 0] * HOP * us).astype(np.int64)), pa.array((((found[:, 1] - 1) * HOP + FRAME) * us).astype(np.int64)), pa.ExtensionArray.from_storage(_TENSOR, storage), pa.array((found[:, 1] - found[:, 0]).astype(np.int32))]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SCHEMA) as w:
        w.write_batch(pa.record_batch(columns, schema=_SCHEMA))
    return sink.getvalue().to_pybytes()


def from_ipc(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


def features(stored: bytes) -> tuple[bytes, bytes, str]:
    """(samples read back, Arrow stream of tensors and spans, summary)."""
    samples, _ = from_wav(stored)
    mel = mel_frames(samples)
    energy = mel.mean(axis=1, dtype=np.float64)
    active = spans(energy)
    found = windows(active)
    tensors = span_tensors(mel, found)
    shape = hashlib.sha256(np.round(tensors, 3).tobytes()).hexdigest()[:16]
    return samples, to_ipc(found, tensors), f"frames={len(mel)};active={len(active)};spans={len(found)};energy={energy.mean():.3f};tensors={shape}"


def to_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text's bytes as a WAV file, one row per input row."""

    def make(texts: list) -> dict:
        made = [payload(t) for t in texts]
        return {"n_bytes": [n for _, n in made], "media": [to_wav(p) for p, _ in made]}

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(kept, make, "n_bytes long, media binary", characters=_BATCH)


def audio_features(audio: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32, tensors, feature)``.

    One row per row of ``to_audio``; everything is computed from the stored file. ``tensors`` is an
    Arrow IPC stream (``from_ipc``) with one fixed-shape tensor, time span and number of valid frames
    per window of an active span, ``feature`` a summary (``active`` counts the active spans, ``spans``
    the time spans stored). A null or empty text is 64 zero bytes, one silent frame and no span; equal
    texts give equal values; ids may repeat, be null or large; other columns are ignored; an empty
    table gives an empty result. Rows are independent: no shuffle. What is held is one file with its
    features, or files of about a megabyte together, whatever the size of Arrow's batches.
    """

    def make(files: list) -> dict:
        out: dict[str, list] = {c: [] for c in ("media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "tensors", "feature")}
        for m in files:
            samples, tensors, feature = features(m)
            row = (len(m), hashlib.sha256(m).hexdigest(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), tensors, feature)
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        return out

    kept = audio.select("doc_id", "n_bytes", "media")
    return map_texts(kept, make, "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, tensors binary, feature string", text="media", characters=_BATCH)
