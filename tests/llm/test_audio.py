import math
import struct

import numpy as np
import pyarrow as pa
from conftest_llm import rows
from pyspark.sql import functions as F

from quillon.llm import audio


def wave(x, rate, bits=16, channels=1):
    data = (np.round(x * 32767).astype("<i2") if bits == 16 else np.round(x * 127 + 128).astype(np.uint8)).tobytes()
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", len(head) + 12 + len(data)) + head + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data


def tone(f, seconds, rate, level=0.5):
    return level * np.sin(2 * np.pi * f * np.arange(int(seconds * rate)) / rate)


def test_wave_files():
    x = tone(440, 0.1, 8000)
    for bits in (8, 16):
        rate, got = audio.samples(wave(x, 8000, bits))
        assert rate == 8000 and len(got) == len(x) and np.abs(got.part(0, len(x)) - x).max() < 0.02
        assert np.abs(got.part(-5, len(x) + 5) - np.r_[np.zeros(5), x, np.zeros(5)]).max() < 0.02
    stereo = np.stack([x, -x], 1).ravel()
    assert np.abs(audio.samples(wave(stereo, 8000, 16, 2))[1].part(0, len(x))).max() < 1e-3
    for broken in (b"", b"RIFF", b"RIFFxxxxWAVE", wave(x, 8000)[:30], b"no wave at all, but long enough to be one"):
        assert audio.samples(broken) is None


def resampled(x, rate):
    return audio.resample(audio.Samples.of(x), rate, 0, audio.resampled_length(len(x), rate))


def test_resampling_is_polyphase_convolution():
    rng = np.random.default_rng(0)
    for rate in (8000, 11_025, 22_050, 44_100, 48_000, 16_000):
        x = rng.normal(size=500).astype(np.float32)
        y = resampled(x, rate)
        assert len(y) == math.ceil(500 * audio.RATE / rate)
        if rate == audio.RATE:
            continue
        up, down, taps = audio.bank(rate)
        half = taps.shape[1] // 2
        for n in (0, 7, len(y) // 2, len(y) - 1):
            i = n * down // up
            want = sum(taps[n * down % up][j] * x[i + j - half + 1] for j in range(2 * half) if 0 <= i + j - half + 1 < 500)
            assert abs(y[n] - want) < 1e-4
        for a, b in ((0, 3), (100, 101), (37, len(y)), (len(y) - 2, len(y) + 9), (len(y) + 1, len(y) + 4)):
            assert np.allclose(audio.resample(audio.Samples.of(x), rate, a, b), np.r_[y, np.zeros(20)][a:b], atol=1e-5)
        t = tone(300, 0.5, rate).astype(np.float32)
        assert np.abs(resampled(t, rate)[200:-200] - tone(300, 0.5, audio.RATE)[200 : len(resampled(t, rate)) - 200]).max() < 0.02


def test_log_mel_by_definition():
    x = np.random.default_rng(1).normal(size=900).astype(np.float32)
    f = audio.frames(audio.Samples.of(x), audio.RATE)
    assert f.shape == (math.ceil((900 - 400) / 160) + 1, 400)
    got = audio.log_mel(f)
    window, mel = audio.filters()
    k, n = np.arange(257)[:, None], np.arange(400)[None, :]
    spectrum = (f[2] * window * np.exp(-2j * np.pi * k * n / 512)).sum(1)
    assert np.allclose(got[2], np.log(np.maximum((np.abs(spectrum) ** 2) @ mel, 1e-10)), atol=1e-3)
    # a pure tone is loudest in the filter around it
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 42) / 2595) - 1)
    band = audio.log_mel(audio.frames(audio.Samples.of(tone(1000, 0.2, 16_000)), audio.RATE))[5].argmax()
    assert edges[band] < 1000 < edges[band + 2]


def test_hysteresis_by_loop():
    rng = np.random.default_rng(2)
    for _ in range(200):
        db = rng.choice([-70.0, -40.0, -29.0, -25.0, -15.0, -10.0], size=rng.integers(1, 30))
        want, on = [], None
        for i, e in enumerate([*db, -1000.0]):
            if on is None and e >= max(db) - audio.ON and e >= audio.FLOOR:
                on = i
            elif on is not None and e < max(db) - audio.OFF:
                want.append((on, i))
                on = None
        assert audio.hysteresis(db) == want


def test_segments_and_tensors(spark):
    quiet = np.zeros(16_000)
    clip = np.concatenate([quiet, tone(500, 0.5, 16_000), quiet, tone(2000, 1.0, 16_000)])
    media = spark.createDataFrame([(1, bytearray(wave(clip, 16_000))), (2, bytearray(wave(quiet, 16_000))), (3, None), (4, bytearray(b"")), (5, bytearray(b"junk")), (None, bytearray(wave(tone(300, 0.01, 8000), 8000))), (1, bytearray(wave(clip, 16_000)))], "doc_id long, audio binary")
    got = audio.features(media.withColumns({c: F.lit("clash") for c in ("mel", "segment", "window", "start_s", "n_frames", "id", "value")})).collect()
    assert {r.doc_id for r in got} == {1, None}
    one = sorted({(r.segment, r.window, round(r.start_s, 2), round(r.end_s, 2)) for r in got if r.doc_id == 1})
    assert {s for s, *_ in one} == {0, 1}
    assert abs(one[0][2] - 1.0) < 0.05 and abs(max(e for s, _, _, e in one if s == 0) - 1.5) < 0.05
    assert len([r for r in got if r.doc_id == 1]) == 2 * len(one)
    assert all(len(r.mel) == audio.WINDOW * audio.MELS for r in got)
    short = next(r for r in got if r.doc_id is None)
    assert short.n_frames == 1 and np.allclose(short.mel[audio.MELS :], audio.SILENCE)
    assert rows(audio.features(media.limit(0))) == []


def test_arrow_tensors(spark, tmp_path):
    media = spark.createDataFrame([(i, bytearray(wave(tone(300 + i, 0.6, 16_000), 16_000))) for i in range(5)], "doc_id long, audio binary")
    found = audio.features(media)
    manifest = audio.store(found, str(tmp_path)).collect()
    tables = [pa.ipc.open_file(str(tmp_path / m.file)).read_all() for m in manifest]
    assert sum(m.rows for m in manifest) == found.count() == sum(t.num_rows for t in tables)
    kind = tables[0].schema.field("mel").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [audio.WINDOW, audio.MELS]
    whole = {(r.doc_id, r.window): r.mel for r in found.collect()}
    for t in tables:
        values = t["mel"].combine_chunks().to_numpy_ndarray()
        for i, w, v in zip(t["doc_id"].to_pylist(), t["window"].to_pylist(), values, strict=True):
            assert np.allclose(v.ravel(), whole[(i, w)])


def test_long_clips_come_in_lots(monkeypatch):
    """The same windows whether a clip is taken whole or a few frames at a time."""
    rng = np.random.default_rng(4)
    loud = np.repeat(rng.choice([0.0, 0.001, 0.4], size=40), 1600)
    column = pa.array([wave(loud * rng.normal(size=len(loud)).clip(-1, 1), 22_050), wave(tone(500, 0.3, 8000), 8000), None, wave(loud, 16_000)], pa.binary())

    def every():
        out = []
        for tensors, rows_, place in audio.clips(column):
            out += [(int(i), *r, t.tobytes()) for t, r, i in zip(np.round(tensors, 2), rows_, place, strict=True)]
        return sorted(out)

    whole = every()
    assert len({r[:2] for r in whole}) > 4
    for lot in (audio.WINDOW, 100, 170):
        monkeypatch.setattr(audio, "LOT", lot)
        assert [r[:-1] for r in every()] == [r[:-1] for r in whole]
        assert all(np.allclose(np.frombuffer(a[-1], np.float32), np.frombuffer(b[-1], np.float32), atol=0.05) for a, b in zip(every(), whole, strict=True))


def test_query(spark, sf):
    """Eight lines of a text are a segment, or several; windows by the definition."""
    import re

    from quillon.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op4_audio"](spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs)
    segments = {i: {r.segment for r in got if r.doc_id == i} for i in docs}
    several = [i for i, t in docs.items() if any(len(x) > 400 for x in re.split(r"(?:[^\n]*\n){8}", t)[1:])]
    assert several and all(len(segments[i]) > 1 for i in several)
    for r in got[:5] + [r for r in got if r.segment > 0][:5]:
        text = re.sub(r"((?:[^\n]*\n){8})", lambda m: m.group() + "\x7f" * 400, docs[r.doc_id])
        x = (np.frombuffer(text.encode(), np.uint8).astype(np.float32) - 128) / 128
        f = audio.frames(audio.Samples.of(x), 8000)
        db = 10 * np.log10(np.maximum((f * f).mean(1), 1e-12))
        a, _ = audio.hysteresis(db)[r.segment]
        a += r.window * audio.WINDOW
        assert np.allclose(np.array(r.mel).reshape(audio.WINDOW, audio.MELS)[: r.n_frames], audio.log_mel(f[a : a + r.n_frames]), atol=1e-3)
        assert abs(r.start_s - a * 0.01) < 1e-9
