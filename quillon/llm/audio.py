"""Audio features of a media column: log-mel filterbanks and active segments, as tensors of one fixed shape.

A clip is a RIFF/WAVE file in a binary column: PCM of 8 or 16 bits, any channels (their mean counts), any rate.  It is
resampled to RATE by a polyphase bank of a Kaiser-windowed sinc; framed, each frame of FRAME samples overlapping
the next by FRAME - HOP; and each frame's power spectrum goes through MELS triangular mel filters to a logarithm.

Segments come from the frames' energies by hysteresis: one opens at a frame within ON decibels of the clip's loudest and
goes on until a frame falls short by more than OFF; frames below FLOOR decibels of full scale never open one.  Each
segment is cut into windows of WINDOW frames; the last is filled up with the value of silence.

A row is one window: a tensor of shape (WINDOW, MELS), row-major in an array column of constant length, with the time
span of its frames.  ``tensors`` turns an Arrow table of such rows into Arrow's own fixed-shape tensor type
without copying, and ``store`` writes Arrow files of that type from the tasks.

Defined results: a null, empty or silent clip, or bytes that aren't such a file, have no rows; a clip shorter than a
frame is filled up with silence; rows with a null id are kept; repeated rows are repeated; an empty table gives an
empty result; other columns are ignored, whatever their names; of a long clip no more than LOT frames are resampled at once.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import blob, filesystem, prepare

RATE, FRAME, HOP, FFT, MELS, WINDOW = 16_000, 400, 160, 512, 40, 32
#: Taps of each phase's filter on either side; hysteresis in decibels below the loudest frame, and the absolute floor.
TAPS, ON, OFF, FLOOR = 8, 12.0, 18.0, -60.0
SILENCE = math.log(1e-10)
#: Frames whose spectra are taken at once.
LOT = 2048
SCHEMA = "doc_id long, segment int, window int, start_s double, end_s double, n_frames int, peak_db double, mel array<float>"


def read_aloud(text: Column, lines: int = 8, pause: int = 400) -> Column:
    """A text whose bytes, as samples, fall silent after every so many lines: for so many samples comes U+007F, which lies next to
    the zero of 8-bit samples."""
    # \G: each match begins where the one before ended, so that what has too few lines is looked at once
    return F.regexp_replace(text, rf"\G((?:[^\n]*+\n){{{lines}}})", "$1" + "\x7f" * pause)


def wav(text: Column, rate: int = 8000) -> Column:
    """The bytes of a column as a WAVE file of 8-bit mono samples, its lengths left open as in a stream."""
    head = b"RIFF\xff\xff\xff\xffWAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data\xff\xff\xff\xff"
    return F.concat(F.lit(head), text.cast("binary"))


class Samples:
    """The samples of a clip, in [-1, 1], made as they are asked for."""

    def __init__(self, body: memoryview, channels: int, bits: int) -> None:
        self.raw = np.frombuffer(body, {8: np.uint8, 16: "<i2", 32: np.float32}[bits]).reshape(-1, channels)
        self.bits = bits

    @classmethod
    def of(cls, x: np.ndarray) -> Samples:
        """From samples that are there already."""
        return cls(np.ascontiguousarray(x, np.float32).data, 1, 32)

    def __len__(self) -> int:
        return len(self.raw)

    def part(self, a: int, b: int) -> np.ndarray:
        """Samples [a, b); silence where there are none."""
        low, high = min(max(a, 0), len(self.raw)), min(max(b, 0), len(self.raw))
        x = self.raw[low:high].astype(np.float32)
        x = (x - 128) / 128 if self.bits == 8 else x / 32768 if self.bits == 16 else x
        x = x[:, 0] if x.shape[1] == 1 else x.mean(1)
        return x if (low, high) == (a, b) else np.concatenate([np.zeros(low - a if low > a else 0, np.float32), x, np.zeros(b - max(high, a), np.float32)])[: b - a]


def samples(clip: bytes | memoryview) -> tuple[int, Samples] | None:
    """Rate and samples of a WAVE file, or None."""
    if len(clip) < 12 or clip[:4] != b"RIFF" or clip[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(clip):
        name, size = bytes(clip[at : at + 4]), int.from_bytes(clip[at + 4 : at + 8], "little")
        at += 8
        if name == b"fmt " and at + 16 <= len(clip):
            form = struct.unpack_from("<HHIIHH", clip, at)
        elif name == b"data" and form:
            code, channels, rate, _, _, bits = form
            if code != 1 or bits not in (8, 16) or not channels or not rate:
                return None
            body = clip[at : at + min(size, len(clip) - at)]
            step = channels * bits // 8
            return rate, Samples(body[: len(body) // step * step], channels, bits)
        at += size + size % 2
    return None


@lru_cache(16)
def bank(rate: int) -> tuple[int, int, np.ndarray]:
    """Up and down factors, and each phase's taps (up, 2 * TAPS * widening), for a rate."""
    g = math.gcd(rate, RATE)
    up, down = RATE // g, rate // g
    wide = max(1.0, down / up)  # below the input's rate the filter is wider and cuts lower
    half = math.ceil(TAPS * wide)
    place = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    window = np.i0(6.0 * np.sqrt(np.maximum(0, 1 - (place / half) ** 2))) / np.i0(6.0)
    taps = np.sinc(place / wide) / wide * window
    return up, down, (taps / taps.sum(1, keepdims=True)).astype(np.float32)


def resampled_length(n: int, rate: int) -> int:
    g = math.gcd(rate, RATE)
    return -(-n * (RATE // g) // (rate // g))


def resample(x: Samples, rate: int, a: int, b: int) -> np.ndarray:
    """Outputs [a, b) of polyphase resampling: output n comes from phase n * down % up at input n * down // up; silence beyond the end."""
    end = min(b, resampled_length(len(x), rate))
    if rate == RATE or a >= end:
        out = x.part(a, max(a, end)) if rate == RATE else np.zeros(0, np.float32)
        return np.concatenate([out, np.zeros(b - a - len(out), np.float32)])
    up, down, taps = bank(rate)
    half, first = taps.shape[1] // 2, a * down // up
    view = np.lib.stride_tricks.sliding_window_view(x.part(first - half + 1, (end - 1) * down // up + half + 1), 2 * half)
    out = np.zeros(b - a, np.float32)
    for p in range(min(up, end - a)):  # outputs a + p, a + p + up, ... share a phase
        at = np.arange(a + p, end, up)
        out[at - a] = view[at * down // up - first] @ taps[(a + p) * down % up]
    return out


@lru_cache(1)
def filters() -> tuple[np.ndarray, np.ndarray]:
    """The frame's window and the mel filters (bins, MELS)."""
    mel = np.linspace(0, 2595 * np.log10(1 + RATE / 2 / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * RATE / FFT
    rise = (f[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2])
    fall = (edge[2:] - f[:, None]) / (edge[2:] - edge[1:-1])
    return np.hanning(FRAME + 1)[:-1].astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def frame_count(x: Samples, rate: int) -> int:
    """Overlapping frames, as many as begin before the end, and one at least."""
    return max(1, -(-(resampled_length(len(x), rate) - FRAME) // HOP) + 1)


def frames(x: Samples, rate: int, a: int = 0, b: int | None = None) -> np.ndarray:
    """(b - a, FRAME) frames [a, b); what they lack is silence."""
    b = frame_count(x, rate) if b is None else b
    return np.lib.stride_tricks.sliding_window_view(resample(x, rate, a * HOP, (b - 1) * HOP + FRAME), FRAME)[::HOP]


def log_mel(frame: np.ndarray) -> np.ndarray:
    """(n, MELS) log filterbank energies."""
    window, mel = filters()
    spectrum = np.fft.rfft(frame * window, FFT, axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    return np.log(np.maximum(power @ mel, np.float32(1e-10)))


def hysteresis(db: np.ndarray, on: float = ON, off: float = OFF, floor: float = FLOOR) -> list[tuple[int, int]]:
    """Segments [a, b) of frames."""
    if not len(db):
        return []
    high = (db >= db.max() - on) & (db >= floor)
    low = db < db.max() - off
    # the last frame that opened or closed decides
    state = np.where(high, 1, np.where(low, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(db)), -1))
    active = np.r_[0, np.where(last >= 0, state[np.maximum(last, 0)], 0), 0]
    turn = np.diff(active)
    return list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True))


def energies(frame: np.ndarray) -> np.ndarray:
    return 10 * np.log10(np.maximum((frame * frame).mean(1), 1e-12))


def windows(mel: np.ndarray, db: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple]]]:
    """Tensors (n, WINDOW * MELS) and (segment, window, start, end, frames, peak) of one clip, in lots."""
    spans = [(k, w, s, min(s + WINDOW, b)) for k, (a, b) in enumerate(hysteresis(db)) for w, s in enumerate(range(a, b, WINDOW))]
    for at in range(0, len(spans), LOT // WINDOW):
        lot = spans[at : at + LOT // WINDOW]
        out = np.full((len(lot), WINDOW, MELS), SILENCE, np.float32)
        rows = []
        for i, (k, w, s, e) in enumerate(lot):
            out[i, : e - s] = mel[s:e]
            rows.append((k, w, s * HOP / RATE, ((e - 1) * HOP + FRAME) / RATE, e - s, round(float(db[s:e].max()), 3)))
        yield out.reshape(len(lot), WINDOW * MELS), rows


def clips(column: pa.Array) -> Iterator[tuple[np.ndarray, list[tuple], np.ndarray]]:
    """(tensors, rows, place in the column of each row).  Short clips go in lots of LOT frames, so that the spectra are
    vectorised over many; a longer one by itself, LOT frames at a time, of which the filterbanks and energies are held."""
    data, offsets = blob(column)
    lot: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> tuple[np.ndarray, list[tuple], np.ndarray]:
        every = np.concatenate([f for _, f in lot])
        mel, db = np.concatenate([log_mel(every[i : i + LOT]) for i in range(0, len(every), LOT)]), energies(every)
        tensors, rows, place, at = [], [], [], 0
        for i, f in lot:
            for t, r in windows(mel[at : at + len(f)], db[at : at + len(f)]):
                tensors.append(t)
                rows += r
                place += [i] * len(r)
            at += len(f)
        return (np.concatenate(tensors) if tensors else np.zeros((0, WINDOW * MELS), np.float32)), rows, np.array(place, np.int64)

    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        found = samples(data[a:b].data) if b > a else None
        if found is None or not len(found[1]):
            continue
        rate, x = found
        n = frame_count(x, rate)
        if n > LOT:
            mel, db = np.empty((n, MELS), np.float32), np.empty(n)
            for f in range(0, n, LOT):
                part = frames(x, rate, f, min(n, f + LOT))
                mel[f : f + LOT], db[f : f + LOT] = log_mel(part), energies(part)
            for t, r in windows(mel, db):
                yield t, r, np.full(len(r), i)
            continue
        lot.append((i, frames(x, rate)))
        held += n
        if held >= LOT:
            yield flush()
            lot, held = [], 0
    if lot:
        yield flush()


def features(media: DataFrame, id_col: str = "doc_id", audio_col: str = "audio") -> DataFrame:
    """The windows of all clips: (doc_id, segment, window, start_s, end_s, n_frames, peak_db, mel); one narrow pass, no shuffle."""
    prepare(media.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tensor, rows, place in clips(batch.column(1)):
                if not rows:
                    continue
                mel = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (WINDOW * MELS)), pa.array(tensor.ravel()))
                kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), *columns, mel], names)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(audio_col).alias("audio")).mapInArrow(run, SCHEMA)


def tensors(table: pa.Table, column: str = "mel") -> pa.Table:
    """The table with its array column as Arrow fixed-shape tensors of (WINDOW, MELS)."""
    kind = pa.fixed_shape_tensor(pa.float32(), (WINDOW, MELS), dim_names=("frame", "mel"))
    values = table[column].combine_chunks()
    flat = values.flatten().cast(pa.float32())
    made = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, WINDOW * MELS))
    return table.set_column(table.schema.get_field_index(column), pa.field(column, kind), made)


def store(rows: DataFrame, folder: str) -> DataFrame:
    """Write the windows as Arrow files of fixed-shape tensors, one a task, renamed into place when complete; the
    manifest (file, rows, bytes).  The folder must be one that all executors share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = filesystem(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.arrow"
        part, out, count = f"{base}/{name}.{uuid.uuid4().hex}.part", None, 0
        for batch in batches:
            table = tensors(pa.Table.from_batches([batch]))
            if out is None:
                system.create_dir(base, recursive=True)
                stream = system.open_output_stream(part)
                out = pa.ipc.new_file(stream, table.schema)
            out.write_table(table)
            count += batch.num_rows
        if out is not None:
            out.close()
            size = stream.tell()
            stream.close()
            system.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count]), pa.array([size])], ["file", "rows", "bytes"])

    return rows.mapInArrow(run, "file string, rows long, bytes long")
