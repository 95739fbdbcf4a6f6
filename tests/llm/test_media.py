import hashlib
import zlib

import duckdb
import numpy as np
from tidemark.llm import media
from tidemark.llm.queries import queries


def test_round_trip_and_features(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries()["op10_audio_features"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        p = (t or "").encode()
        n = len(p)
        p += bytes(max(64, -(-n // 64) * 64) - n)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_bytes == len(p) + 44 and r.media_sha256 == hashlib.sha256(media.to_wav(p)).hexdigest()
    by_text = {}
    for d, t in docs:
        assert by_text.setdefault(t, got[d].feature) == got[d].feature


def test_edges_and_tensors(spark):
    rows = [(None, "x" * 64, 1), (1, None, 1), (1, None, 1), (2, "", 1), (3, "é" * 200_000, 1), (4, "quiet " * 300 + "ÿ\x00~" * 900 + "quiet " * 300, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature int")
    got = media.audio_features(media.to_audio(df)).collect()
    assert len(got) == 6
    for r in got:
        t = media.from_ipc(bytes(r.tensors))
        assert t.schema.field("log_mel").type == media._TENSOR
        assert f"spans={t.num_rows};" in r.feature
        starts, ends = t["start_us"].to_pylist(), t["end_us"].to_pylist()
        assert all(a < b for a, b in zip(starts, ends)) and starts == sorted(starts)
    assert {r.feature for r in got if r.doc_id in (1, 2)} == {next(r.feature for r in got if r.doc_id == 2)}
    assert media.audio_features(media.to_audio(df.limit(0))).count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(16_000) / 16_000
    y = media.resample(np.sin(2 * np.pi * 440 * t))
    assert len(y) == 10_000
    peak = np.argmax(np.abs(np.fft.rfft(y[1000:9000] * np.hanning(8000)))) * 10_000 / 8000
    assert abs(peak - 440) < 3
    high = media.resample(np.sin(2 * np.pi * 7000 * t))
    assert np.abs(high[100:-100]).max() < 0.05


def test_hysteresis():
    e = np.array([0, 0, 0.5, 3, 1.4, 3, 0.5, 0, 0, 0, 3, 3, 0.0])
    mean, dev = e.mean(), e.std()
    state, want = False, []
    for k, v in enumerate(e):
        new = v >= mean + 0.25 * dev or (state and v >= mean - 0.25 * dev)
        if new and not state:
            want.append([k, len(e)])
        if state and not new:
            want[-1][1] = k
        state = new
    assert media.spans(e).tolist() == want


def test_all_frames_of_all_spans_are_stored():
    rng = np.random.default_rng(3)
    for n in (1, 64, 5_000, 200_000):
        loud = rng.integers(0, 256, n, dtype=np.uint8)
        loud[n // 3 : n // 2] = 128
        _, stored, feature = media.features(media.to_wav(loud.tobytes()))
        mel = media.log_mel(media.resample((loud.astype(np.float64) - 128) / 128))
        found = media.spans(mel.mean(axis=1, dtype=np.float64))
        t = media.from_ipc(stored)
        tensors = t["log_mel"].combine_chunks().storage.flatten().to_numpy().reshape(-1, media.SLOTS, media.MELS)
        valid = t["frames"].to_pylist()
        got = [x[:k] for x, k in zip(tensors, valid)]
        want = [mel[a:b] for a, b in found]
        assert np.array_equal(np.concatenate([mel[:0], *got]), np.concatenate([mel[:0], *want])) and f"active={len(found)};spans={len(valid)};" in feature
        assert all(not x[k:].any() for x, k in zip(tensors, valid))


def test_log_mel_agrees_with_a_direct_transform():
    rng = np.random.default_rng(7)
    y = rng.standard_normal(900)
    got = media.log_mel(y)
    n, rate = media.FRAME, media.RATE * media.UP / media.DOWN
    count = -(-(len(y) - n) // media.HOP) + 1
    y = np.concatenate([y, np.zeros((count - 1) * media.HOP + n - len(y))])
    k, t = np.arange(n // 2 + 1)[:, None], np.arange(n)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / (n - 1))
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), media.MELS + 2)]
    assert got.shape == (count, media.MELS)
    for f in range(count):
        x = y[f * media.HOP : f * media.HOP + n] * window
        power = (x * np.cos(2 * np.pi * k * t / n)).sum(axis=1) ** 2 + (x * np.sin(2 * np.pi * k * t / n)).sum(axis=1) ** 2
        for m in range(media.MELS):
            a, b, c = edges[m : m + 3]
            weight = [max(0.0, min((h - a) / (b - a), (c - h) / (c - b))) for h in np.arange(n // 2 + 1) * rate / n]
            assert abs(got[f, m] - np.log10(np.dot(weight, power) + 1e-6)) < 1e-4


def test_pieces_give_what_the_whole_gives(monkeypatch):
    rng = np.random.default_rng(8)
    for n in (64, 640, 20_032, 70_016):
        x = rng.integers(0, 256, n, dtype=np.uint8)
        y = media.resample((x.astype(np.float64) - 128) / 128)
        direct = [sum(media._phases()[m * media.DOWN % media.UP][j] * ((int(x[i]) - 128) / 128) for j in range(media.TAPS) if 0 <= (i := m * media.DOWN // media.UP - media.TAPS // 2 + j) < n) for m in range(40)]
        assert np.allclose(y[:40], direct[: len(y)])
        for piece in (5, 20, 5120):
            monkeypatch.setattr(media, "_PIECE", piece)
            assert np.allclose(media.mel_frames(x.tobytes()), media.log_mel(y), atol=1e-4)


def test_large_ids_stay(spark):
    rows = [(2**53 + 1, "a"), (None, "b"), (-(2**62) - 1, None)]
    got = media.audio_features(media.to_audio(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
