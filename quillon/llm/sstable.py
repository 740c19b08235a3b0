"""Sorted-string-table shards: documents keyed by identifier, for look-up by binary search.

A shard is one file, written by one task in key order:

    block*  index  bloom  footer

A block holds consecutive entries, about BLOCK bytes of them before compression (zstd).  An entry is the number of
key bytes it shares with the entry before it, the number it doesn't, the length of its value, those key bytes, and
the value; each block starts over with a whole key.  Keys are 8 bytes, big-endian, the sign flipped, so that
bytes sort as numbers do.  A value is, column by column, four bytes of length (all ones for a null) and the bytes.
The index has each block's first and last key, offset, size and entries; the Bloom filter BITS bits a
key and HASHES probes; the footer, of fixed size, where both lie, and a magic number.

A reader takes the footer, then the index and the Bloom filter; a look-up asks the filter, searches the index
for the block by bisection, and the block's keys, again by bisection.

Shards go to the folder that all executors share, under the name of the shard's number, and are renamed into place
when complete, so that a repeated task or a lost executor leaves no partial shard; the manifest tells the
key range of each shard.  Shards number input size / SHARD_BYTES, whatever the session's partitions.

Defined results: rows with a null key have no place in the table and are left out; rows that repeat a key are all
kept, next to each other, and a look-up returns them all; a null value stays null, an empty one empty; an empty
table gives no shard; the other columns are those named, in that order, whatever else the table has.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import U64, filesystem, mix, own_folder, prepare

#: Bytes of a block before compression; Bloom bits a key and probes (1 % false positives); input bytes of a shard.
BLOCK, BITS, HASHES, SHARD_BYTES = 64 << 10, 10, 7, 32 << 20
UNKNOWN = 1 << 52
MAGIC, FOOTER = b"QSST0001", struct.Struct("<QQQQQ8s")
INDEX = np.dtype([("first", "<i8"), ("last", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("entries", "<u4")])
MANIFEST = "shard int, file string, first_key long, last_key long, entries long, blocks long, bytes long"


def key_bytes(key: int) -> bytes:
    return (key + (1 << 63)).to_bytes(8, "big")


def pack(columns: list[bytes | None]) -> bytes:
    return b"".join(b"\xff\xff\xff\xff" if c is None else len(c).to_bytes(4, "little") + c for c in columns)


def unpack(value: bytes, n: int) -> list[bytes | None]:
    out, at = [], 0
    for _ in range(n):
        size = int.from_bytes(value[at : at + 4], "little")
        at += 4
        if size == 0xFFFFFFFF:
            out.append(None)
        else:
            out.append(value[at : at + size])
            at += size
    return out


def probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """(HASHES, n) bit positions, by double hashing."""
    a = mix(keys.astype(np.int64).view(U64))
    b = mix(a ^ U64(0x9E3779B97F4A7C15)) | U64(1)
    return np.stack([(a + b * U64(i)) % U64(bits) for i in range(HASHES)])


class Writer:
    """One shard, written as entries arrive in key order."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.system, self.path, self.part = system, path, f"{path}.{uuid.uuid4().hex}.part"
        system.create_dir(os.path.dirname(path), recursive=True)
        self.out = system.open_output_stream(self.part)
        self.zip = zstandard.ZstdCompressor(level=1)
        self.index: list[tuple] = []
        self.keys: list[int] = []
        self.at = 0
        self.open_block()

    def open_block(self) -> None:
        self.block, self.size, self.before, self.first = [], 0, b"", len(self.keys)

    def add(self, key: int, value: bytes) -> None:
        raw = key_bytes(key)
        shared = 0
        while shared < len(self.before) and raw[shared] == self.before[shared]:
            shared += 1
        self.block.append(struct.pack("<BBI", shared, 8 - shared, len(value)) + raw[shared:] + value)
        self.size += len(self.block[-1])
        self.before = raw
        self.keys.append(key)
        if self.size >= BLOCK:
            self.close_block()

    def close_block(self) -> None:
        if self.block:
            data = self.zip.compress(b"".join(self.block))
            self.out.write(data)
            self.index.append((self.keys[self.first], self.keys[-1], self.at, len(data), len(self.block)))
            self.at += len(data)
        self.open_block()

    def close(self) -> tuple[int, int, int, int, int]:
        """First key, last key, entries, blocks and bytes."""
        self.close_block()
        index = np.array(self.index, INDEX).tobytes()
        bits = max(64, len(self.keys) * BITS)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        at = probes(np.array(self.keys, np.int64), bits).ravel()
        np.bitwise_or.at(bloom, (at >> U64(3)).astype(np.int64), (U64(1) << (at & U64(7))).astype(np.uint8))
        tail = index + bloom.tobytes() + FOOTER.pack(self.at, len(index), len(bloom), bits, len(self.keys), MAGIC)
        self.out.write(tail)
        self.out.close()
        if self.system.get_file_info(self.path).type != fs.FileType.NotFound:
            self.system.delete_file(self.path)  # an attempt before this one got so far; its shard was the same
        self.system.move(self.part, self.path)
        return self.keys[0], self.keys[-1], len(self.keys), len(self.index), self.at + len(tail)


class Reader:
    """Look-ups in one shard."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, index, bloom, self.bits, self.entries, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        tail = self.file.read_at(index + bloom, at)
        self.index = np.frombuffer(tail[:index], INDEX)
        self.bloom = np.frombuffer(tail[index:], np.uint8)
        self.zip = zstandard.ZstdDecompressor()
        self.held: tuple[int, np.ndarray, list[bytes]] = (-1, np.zeros(0, np.int64), [])

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """False for keys that the Bloom filter rules out."""
        at = probes(keys, self.bits)
        return ((self.bloom[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1).all(0)

    def read_block(self, k: int) -> tuple[np.ndarray, list[bytes]]:
        if self.held[0] != k:
            row = self.index[k]
            data = self.zip.decompress(self.file.read_at(int(row["size"]), int(row["offset"])))
            keys, values, at, before = [], [], 0, b""
            while at < len(data):
                shared, own, size = struct.unpack_from("<BBI", data, at)
                at += 6
                before = before[:shared] + data[at : at + own]
                at += own
                keys.append(int.from_bytes(before, "big") - (1 << 63))
                values.append(data[at : at + size])
                at += size
            self.held = (k, np.array(keys, np.int64), values)
        return self.held[1], self.held[2]

    def get(self, key: int) -> list[bytes]:
        """All values of the key."""
        out: list[bytes] = []
        k = int(np.searchsorted(self.index["last"], key, "left"))
        while k < len(self.index) and self.index["first"][k] <= key:  # equal keys may run over blocks
            keys, values = self.read_block(k)
            a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            out += values[a:b]
            if b < len(keys):
                break
            k += 1
        return out


def texts(df: DataFrame, columns: list[str]) -> list:
    """Each column as the text that Spark prints of it; binary stays as it is."""
    return [F.col(c) if isinstance(df.schema[c].dataType, T.BinaryType) else F.col(c).cast("string").cast("binary") for c in columns]


def write_shards(df: DataFrame, folder: str, key: str, columns: list[str], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards and return the manifest (one row each), itself kept as Parquet in the folder.

    The one shuffle ranges the rows by key; each range is sorted and streamed into its shard."""
    spark = df.sparkSession
    prepare(spark)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > UNKNOWN:  # the planner can't tell: measure
        size = df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts(df, columns)), F.lit(8)))).first()[0] or 0
    number = max(1, -(-size // shard_bytes))
    rows = df.select(F.col(key).cast("long").alias("k"), *(c.alias(f"v{i}") for i, c in enumerate(texts(df, columns)))).where("k is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        system, base = filesystem(folder)
        name, out = f"shard-{shard:06d}.sst", None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            values = zip(*(batch.column(j).to_pylist() for j in range(1, batch.num_columns)), strict=True) if batch.num_columns > 1 else ((),) * len(keys)
            for k, v in zip(keys, values, strict=True):
                out = out or Writer(system, f"{base}/{name}")
                out.add(k, pack(list(v)))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(["shard", "file", "first_key", "last_key", "entries", "blocks", "bytes"], (shard, name, *out.close()), strict=True))], pa.schema([("shard", pa.int32()), ("file", pa.string()), *((c, pa.int64()) for c in ("first_key", "last_key", "entries", "blocks", "bytes"))]))

    ranged = rows.repartitionByRange(number, "k").sortWithinPartitions("k", *(f"v{i}" for i in range(len(columns))))
    ranged.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def look_up(keys: DataFrame, folder: str, key: str, schema: T.StructType) -> DataFrame:
    """The rows of the table with the given keys: (key, *schema).  Keys are ranged as the shards are, so that each task
    opens few of them; shards are found by bisection in the manifest's ranges, which each task reads from the folder."""
    spark = keys.sparkSession
    names = [f.name for f in schema]
    number = max(1, spark.read.parquet(f"{folder}/manifest").count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, base = filesystem(folder)
        manifest = pq.read_table(f"{base}/manifest", filesystem=system).sort_by("shard")
        first, last, files = manifest["first_key"].to_numpy(), manifest["last_key"].to_numpy(), manifest["file"].to_pylist()
        held: tuple[int, Reader | None] = (-1, None)
        found: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([f[0] for f in found], pa.int64()), *(pa.array([f[1][j] for f in found], pa.binary()) for j in range(len(names)))]
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, ["k", *(f"v{i}" for i in range(len(names)))])

        for batch in batches:
            sought = batch.column(0).to_numpy()
            at = np.searchsorted(last, sought, "left")
            for s in np.unique(at[at < len(first)]):
                mine = sought[at == s]
                shard = int(s)
                while len(mine) and shard < len(first):  # repeats of a key may run over shards
                    mine = mine[mine >= first[shard]]
                    if held[0] != shard and len(mine):
                        held = (shard, Reader(system, f"{base}/{files[shard]}"))
                    for k in mine[held[1].maybe(mine)] if len(mine) else ():
                        for v in held[1].get(int(k)):
                            found.append((int(k), unpack(v, len(names))))
                            size += len(v)
                            if size > 8 << 20:
                                yield flush()
                                size = 0
                    mine, shard = mine[mine == last[shard]], shard + 1
        if found:
            yield flush()

    wanted = keys.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    got = wanted.repartitionByRange(number, "k").sortWithinPartitions("k").mapInArrow(run, "k long, " + ", ".join(f"v{i} binary" for i in range(len(names)))) if number else None
    back = [F.col(f"v{i}").alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"v{i}").cast("string").cast(f.dataType).alias(f.name) for i, f in enumerate(schema)]
    return got.select(F.col("k").alias(key), *back)


def round_trip(df: DataFrame, key: str, columns: list[str], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the table as shards in the shared folder, then look up every key there: the table again, all from shards."""
    folder = own_folder(df.sparkSession, "sstable")
    write_shards(df, folder, key, columns, shard_bytes)
    return look_up(df, folder, key, T.StructType([df.schema[c] for c in columns]))
