"""What the operators of this subpackage share: shared-folder checkpoints, Arrow batches as byte arrays,
vectorised words and hashes, and connected components.

Conventions that hold for every operator:

* input columns are named by parameters and everything else is ignored, so extra columns never clash;
* identifiers are integers; a table whose identifiers are addresses or other strings needs a column of numbers first (a cast that
  fails is an error, not a lost row);
* a null text counts as an empty one unless an operator says otherwise;
* texts are always processed whole; batches are cut into chunks of about ``CHUNK`` bytes only to bound
  memory, and a text longer than that is taken in pieces, cut where it changes nothing, whose results are put
  together, so that memory beside the text itself doesn't grow with it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 1 << 20
BATCH_BYTES = 8 << 20
U64 = np.uint64


def prepare(spark: SparkSession) -> None:
    """Arrow batches are bounded in bytes too, so that long texts don't pile up in one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, where that is unset and one machine does it all
    (tests), a temporary one of our own.  A cluster has to name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder, without lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def blob(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of about ``size`` bytes, never fewer than one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every bit depends on every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, for n up to CHUNK + 1."""
    if len(_powers.get(base, ())) < n:
        x = np.full(max(n, CHUNK + 1), base, U64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
    return _powers[base][:n]


def power(base: int, at: np.ndarray) -> np.ndarray:
    """base**at modulo 2**64, from two tables of at most CHUNK + 1 entries."""
    if not len(at):
        return np.zeros(0, U64)
    top = int(at.max()) // CHUNK
    low = powers(base, CHUNK)[at % CHUNK] if top else powers(base, int(at.max()) + 1)[at]
    if not top:
        return low
    high = np.full(top + 1, pow(base, CHUNK, 1 << 64), U64)
    high[0] = 1
    return low * np.multiply.accumulate(high)[at // CHUNK]


def prefix_sums(values: np.ndarray, base: int, at: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of places: the sums of values[i] * base**i over i below the place; block by block, so that memory doesn't
    grow with the values."""
    if len(values) <= CHUNK:
        total = np.zeros(len(values) + 1, U64)
        np.cumsum(values.astype(U64) * powers(base, len(values)), out=total[1:])
        return [total[x] for x in at]
    out, before = [np.zeros(len(x), U64) for x in at], U64(0)
    for a in range(0, len(values) + 1, CHUNK):
        part = values[a : a + CHUNK].astype(U64)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part * powers(base, len(part)), out=total[1:])
        total = total * U64(pow(base, a, 1 << 64)) + before
        for x, y in zip(at, out, strict=True):
            here = np.flatnonzero((x >= a) & (x < a + CHUNK))
            y[here] = total[x[here] - a]
        before = total[-1]
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span of bytes; equal spans hash alike wherever they stand."""
    if len(values) <= CHUNK:
        low, high = prefix_sums(values.astype(np.uint16) + np.uint16(1), _BASE, [starts, ends])
    else:  # sums of bytes and of ones are apart, so that no copy of the values is made
        (low, high), (a, b) = prefix_sums(values, _BASE, [starts, ends]), prefix_sums(np.broadcast_to(np.uint8(1), len(values)), _BASE, [starts, ends])
        low, high = low + a, high + b
    return mix((high - low) * power(_BACK, starts) + (ends - starts).astype(U64))


def stretches(offsets: np.ndarray, data: np.ndarray, stop: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, int, int]]:
    """(a, b, low, high): rows [a, b) and their bytes, as chunks has them; but a row of more than size bytes comes in pieces of at
    most that, each but the last ending behind a byte of the table ``stop``.  A piece is longer only where the row has no
    such byte."""
    for a, b in chunks(offsets, size):
        low, end = int(offsets[a]), int(offsets[b])
        while end - low > size:
            high = _cut(data, low, low + size, end, stop)
            yield a, b, low, high
            low = high
        if low < end or low == offsets[a]:
            yield a, b, low, end


def _cut(data: np.ndarray, low: int, high: int, end: int, stop: np.ndarray, step: int = 1 << 16) -> int:
    """The last place behind a stop byte in (low, high], or the first beyond, or the end."""
    at = high
    while at > low:
        found = np.flatnonzero(stop[data[max(low, at - step) : at]])
        if len(found):
            return max(low, at - step) + int(found[-1]) + 1
        at -= step
    while high < end:
        found = np.flatnonzero(stop[data[high : min(end, high + step)]])
        if len(found):
            return high + int(found[0]) + 1
        high += step
    return end


def char_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many characters begin before each of the ascending places; memory doesn't grow with the data."""
    out, before, done = np.zeros(len(at), np.int64), 0, 0
    for a in range(0, len(data) + 1, CHUNK):
        part = np.cumsum((data[a : a + CHUNK] & 0xC0) != 0x80, dtype=np.int64)
        upto = int(np.searchsorted(at, min(a + CHUNK, len(data) + 1), "left"))
        out[done:upto] = before + np.r_[0, part][at[done:upto] - a]
        before, done = before + (int(part[-1]) if len(part) else 0), upto
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
NO_WORD = ~WORD


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word: a longest run of ASCII letters, digits and bytes from 128 on
    that crosses no row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = WORD[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    cuts = offsets[:-1]
    before[cuts[cuts < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _kinds() -> np.ndarray:
    """By code point: 1 is punctuation or space, 2 a character of a script without spaces, 0 any other; the last stands for all beyond."""
    kinds = np.zeros(0x40000, np.uint8)
    for a, b in ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3040, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFE)):
        kinds[a : b + 1] = 2
    for a, b in ((0xA0, 0xA1), (0xAB, 0xAB), (0xBB, 0xBB), (0xBF, 0xBF), (0x2000, 0x206F), (0x3000, 0x3004), (0x3008, 0x3020), (0x30FB, 0x30FB), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)):
        kinds[a : b + 1] = 1
    return kinds


KINDS = _kinds()


def script_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like words, but each character of a script without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer, Tibetan)
    is a word of its own, and punctuation beyond ASCII stands between words."""
    at = np.flatnonzero(data >= 0xC2)
    if not len(at):
        return words(data, offsets)
    lead, size = data[at].astype(np.int64), 2 + (data[at] >= 0xE0) + (data[at] >= 0xF0)
    point = lead & np.array([0x1F, 0x0F, 0x07])[size - 2]
    for j in (1, 2, 3):
        point = np.where(size > j, point << 6 | (data[np.minimum(at + j, len(data) - 1)] & 0x3F), point)
    kind = KINDS[np.minimum(point, len(KINDS) - 1)]
    inside = WORD[data]
    for j in range(4):
        inside[at[(kind == 1) & (size > j)] + j] = False
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    begins[at[kind == 2]] = begins[at[kind == 2] + size[kind == 2]] = True
    starts = np.flatnonzero(inside & (begins[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (begins[1:] | ~np.r_[inside[1:], False])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Connected components: (node, root) for every node of an edge but the roots, a root being the least node of its component.

    Alternating large-star and small-star steps, each one shuffle; lineage is cut in the shared folder after
    every round.  Null ends and loops are dropped.  Raises if ``most`` rounds don't suffice."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, last = cut(now), None
    by = Window.partitionBy("u")
    for _ in range(most):
        both = now.union(now.select(F.col("v"), F.col("u")))
        large = both.withColumn("m", F.least(F.min("v").over(by), F.col("u"))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.withColumn("m", F.min("v").over(by))
        now = cut(low.select("u", F.col("m").alias("v")).union(low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = sign
    raise RuntimeError(f"components: no end after {most} rounds")


_folders: list[tuple] = []


def _sweep() -> None:
    """Remove the tables that this session wrote between jobs."""
    for path, conf in _folders:
        try:
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001, S110 - the JVM may have gone before us
            pass


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when this session's Python ends."""
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_sweep)
    sc = spark.sparkContext
    _folders.append((sc._jvm.org.apache.hadoop.fs.Path(where), sc._jsc.hadoopConfiguration()))
    return where


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: no lineage, and columns can be pruned."""
    where = own_folder(df.sparkSession, "table")
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address and its path there."""
    parts = urlparse(folder)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(folder)
