"""SimHash near-duplicates by random bit sampling.

A document's fingerprint has 128 bits: each bit is the majority, over its distinct words, of that bit of the
words' hashes.  Documents with equal fingerprints are one node.  Each of several tables samples coordinates
at random; nodes that agree on a table's sample share a bucket.  A bucket above ``cap`` is divided by further
coordinates until it fits, in as many independent ways as it takes for a pair at the radius to stay together in one of
them with probability ``RECALL``; where that costs more than to compare all its pairs, all are compared.  One above ``MOST`` is
divided so before it is shuffled, so that no task holds it.  Within a
bucket or piece every pair's Hamming distance is verified, and what is verified leaves the bucket as a spanning star of each of its components, which keeps
the output linear in the bucket.  Groups are the connected components.

Defined results: a null or empty text, or one without any word, has no fingerprint and is never grouped;
a null id is dropped; repeated rows of one id are one document; ties keep the least id; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, NO_WORD, U64, blob, components, cut, filesystem, mix, own_folder, prepare, span_hashes, stretches, words, written

BITS = 128
#: Production parameters: Hamming radius, tables, sampled coordinates of a table, and largest undivided bucket.
RADIUS, TABLES, SAMPLED, CAP, SEED = 20, 30, 14, 1024, 42
#: Nodes of a bucket above which it is divided before it is shuffled; parts of the list of copies.
MOST, PARTS = 1 << 16, 4096
#: Share of the pairs at the radius that a divided bucket must keep; so 30 tables find 0.9 of them even if all are divided.
RECALL = 0.9


def fingerprint(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the blob that have a word, and their fingerprints as (n, 2) signed words."""
    rows, prints, held = [], [], []
    for a, b, low, high in stretches(offsets, data, NO_WORD):
        whole = low == offsets[a] and high == offsets[b]
        part, own = data[low:high], offsets[a : b + 1] - low if whole else np.array([0, high - low])
        starts, ends, doc = words(part, own)
        hashes = span_hashes(LOWER[part], starts, ends)
        if not whole:  # a piece of one long row: its distinct words wait for those of the other pieces
            held.append(np.unique(hashes >> U64(12)))
            if high < offsets[b]:
                continue
            hashes = np.unique(np.concatenate(held))
            held = []
            if len(hashes):
                total = sum(bits_of(hashes[i : i + (1 << 15)]).sum(0, dtype=np.int64) for i in range(0, len(hashes), 1 << 15))
                prints.append(np.packbits(total[None, :] * 2 > len(hashes), axis=1).view(np.int64))
                rows.append(np.array([a]))
            continue
        if not len(starts):
            continue
        order = np.lexsort((hashes, doc)) if b - a > 4096 else None
        if order is None:  # one sort of single words: 12 bits of row, 52 of hash
            both = np.sort((doc.astype(U64) << U64(52)) | (hashes >> U64(12)))
            both = both[np.r_[True, both[1:] != both[:-1]]]
            doc, hashes = (both >> U64(52)).astype(np.int64), both & U64((1 << 52) - 1)
        else:
            doc, hashes = doc[order], hashes[order] >> U64(12)
            new = np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]
            doc, hashes = doc[new], hashes[new]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[first, len(doc)])
        # bytes can't overflow in runs of 255 words
        runs = np.concatenate([np.arange(f, f + c, 255) for f, c in zip(first, count, strict=True)]) if (count > 255).any() else first
        totals = np.empty((len(first), BITS), np.int64)
        for half in (0, 1):
            part_sum = np.add.reduceat(half_bits(hashes, half), runs, axis=0, dtype=np.uint8)
            totals[:, half * 64 : half * 64 + 64] = np.add.reduceat(part_sum, np.searchsorted(runs, first), axis=0, dtype=np.int64) if len(runs) > len(first) else part_sum
        prints.append(np.packbits(totals * 2 > count[:, None], axis=1).view(np.int64))
        rows.append(a + doc[first])
    return (np.concatenate(rows), np.concatenate(prints)) if rows else (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))


def half_bits(hashes: np.ndarray, half: int) -> np.ndarray:
    """(n, 64) bits of words' hashes, for the first or the second half of the fingerprint."""
    word = mix(hashes + U64(0x632BE59BD9B4E019 * (half + 1) & (1 << 64) - 1))
    return np.unpackbits(word[:, None].view(np.uint8), axis=1)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate([half_bits(hashes, half) for half in (0, 1)], axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hi, lo) of every document with a word; one narrow pass over id and text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, prints = fingerprint(*blob(batch.column(1)))
            ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1])], ["doc_id", "hi", "lo"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null").mapInArrow(run, "doc_id long, hi long, lo long")


def coordinates(tables: int, seed: int) -> np.ndarray:
    """A random order of all coordinates for each table: the first are its sample, the next divide its large buckets."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BITS) for _ in range(tables)])


def spread(nodes: DataFrame, tables: int, sampled: int, seed: int) -> DataFrame:
    """(table, bucket, hi, lo, id) of each node (hi, lo, id) in each table."""
    order = coordinates(tables, seed)[:, :sampled]
    weight = 1 << np.arange(sampled, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                hi, lo, ids = (part.column(k).to_numpy() for k in range(3))
                bit = np.unpackbits(np.ascontiguousarray(np.stack([hi, lo], 1)).view(np.uint8), axis=1)
                key = np.concatenate([bit[:, o] @ weight for o in order])
                table = np.repeat(np.arange(tables, dtype=np.int32), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(table), pa.array(key.astype(np.int64)), *(pa.array(np.tile(x, tables)) for x in (hi, lo, ids))], ["table", "bucket", "hi", "lo", "id"])

    return nodes.select("hi", "lo", "id").mapInArrow(run, "table int, bucket long, hi long, lo long, id long")


def pieces(bit: np.ndarray, order: np.ndarray, rows: np.ndarray, depth: int, cap: int, cuts: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """Rows in groups of at most cap that agree on ever more coordinates, and the cuts that made each; nodes differ, so this ends."""
    while len(rows) > cap and depth < len(order):
        one = bit[rows, order[depth]] == 1
        depth += 1
        if one.all() or not one.any():
            continue
        cuts += 1
        yield from pieces(bit, order, rows[~one], depth, cap, cuts)
        rows = rows[one]
    yield rows, cuts


def divide(bit: np.ndarray, order: np.ndarray, rows: np.ndarray, depth: int, cap: int) -> Iterator[np.ndarray]:
    """The pieces of more than one row."""
    return (part for part, _ in pieces(bit, order, rows, depth, cap) if len(part) > 1)


def large(prints: np.ndarray, order: np.ndarray, radius: int, cap: int, seed: int) -> Iterator[np.ndarray]:
    """Pieces of a bucket above cap, in independent ways, until each node has been with all but 1 - RECALL of the nodes
    at the radius; at last the whole, if it costs no more."""
    n, bit = len(prints), np.unpackbits(prints.view(np.uint8), axis=1)
    count = bit.sum(0, dtype=np.int64)
    varying = order[((count > 0) & (count < n))[order]]
    m = len(varying)
    together = np.cumprod(np.r_[1.0, np.maximum(0, m - radius - np.arange(m)) / (m - np.arange(m))])  # by cuts
    rng = np.random.default_rng(seed)
    missed, cost = np.ones(n), 0
    while (missed > 1 - RECALL + 1e-9).any():
        parts = list(pieces(bit, varying, np.arange(n), 0, cap))
        cost += sum(len(rows) ** 2 for rows, _ in parts)
        for rows, cuts in parts:
            missed[rows] *= 1 - together[cuts]
        # ways still to go, as long as this one, for the node that has most before it
        ways = np.log(1 - RECALL) / min(np.log(missed.max()), -1e-9)
        if cost * max(1, ways) >= n * n:
            yield np.arange(n)
            return
        yield from (rows for rows, _ in parts if len(rows) > 1)
        varying = rng.permutation(varying)


def star(prints: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the least of its component, over all pairs within the radius."""
    n = len(ids)
    root = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # rank by id
    step = max(1, min(128, (1 << 22) // n))
    near: list[np.ndarray] = []
    held = 0
    for i in range(0, n, step):
        far = np.bitwise_count(prints[i : i + step, None, 0] ^ prints[None, i:, 0]) + np.bitwise_count(prints[i : i + step, None, 1] ^ prints[None, i:, 1])
        a, b = np.nonzero(far <= radius)
        a, b = root[a + i], root[b + i]
        near.append(np.stack([a, b])[:, a != b])
        held += near[-1].shape[1]
        if held > 1 << 20:  # what is joined already needs no more edges
            root, near, held = joined(root, np.concatenate(near, axis=1)), [], 0
    root = joined(root, np.concatenate(near, axis=1))
    least = np.sort(ids)[root]
    moved = least != ids
    return ids[moved], least[moved]


def joined(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The ranks of the members' roots after roots in pairs are joined."""
    least = np.arange(len(root))
    while pairs.shape[1]:  # least rank among neighbours, then pointer jumping, until nothing moves
        new = least.copy()
        np.minimum.at(new, pairs[0], least[pairs[1]])
        np.minimum.at(new, pairs[1], least[pairs[0]])
        new = new[new]
        if (new == least).all():
            break
        least = new
    return least[root]


def links(nodes: DataFrame, radius: int, cap: int, tables: int, sampled: int, seed: int, most: int = MOST) -> DataFrame:
    """Verified edges (a, b) of all buckets of the nodes (hi, lo, id): one shuffle by (table, bucket, way, piece), then numpy over the whole run of each."""
    order = coordinates(tables, seed)
    buckets = divided(spread(nodes, tables, sampled, seed), nodes, tables, sampled, cap, radius, seed, most)

    def verify(table: int, prints: np.ndarray, ids: np.ndarray, out: list) -> None:
        if len(ids) <= cap:
            parts = [np.arange(len(ids))] if len(ids) > 1 else []
        else:
            parts = large(prints, order[table], radius, cap, seed + table)
        for rows in parts:
            a, b = star(prints[rows].view(U64), ids[rows], radius)
            if len(a):
                out.append((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last bucket may go on in the next batch
        out: list[tuple] = []

        def close() -> None:
            if held:
                verify(held[0][0], np.ascontiguousarray(np.concatenate([h[2] for h in held])), np.concatenate([h[3] for h in held]), out)
                held.clear()

        for batch in batches:
            table, bucket, way, hi, lo, ids = (batch.column(k).to_numpy() for k in range(6))
            if not len(table):
                continue
            prints = np.stack([hi, lo], 1)
            first = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (bucket[1:] != bucket[:-1]) | (way[1:] != way[:-1])])
            for f, e in zip(first, np.r_[first[1:], len(table)], strict=True):
                key = (int(table[f]), int(bucket[f]), int(way[f]))
                if held and held[0][1] != key:
                    close()
                if e == len(table) or held:
                    held.append((int(table[f]), key, prints[f:e], ids[f:e]))
                elif e - f > 1:
                    verify(int(table[f]), np.ascontiguousarray(prints[f:e]), ids[f:e], out)
            if out:
                yield edges(out)
                out.clear()
        close()
        if out:
            yield edges(out)

    def edges(out: list) -> pa.RecordBatch:
        a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
        pairs = np.unique(np.stack([a, b], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return buckets.repartition("table", "bucket", "way").sortWithinPartitions("table", "bucket", "way").mapInArrow(run, "a long, b long")


def divided(buckets: DataFrame, nodes: DataFrame, tables: int, sampled: int, cap: int, radius: int, seed: int, most: int) -> DataFrame:
    """The buckets with a column ``way``: 0, or, where a bucket has more than ``most`` nodes, so that no task should hold it, one row for
    each of several ways of dividing it before the shuffle, by as many further coordinates as bring it down to cap on average.
    bucket then tells the
    piece too.  Large buckets are counted, with partial sums before the shuffle, and joined; their number isn't bounded, so they aren't broadcast."""
    plain = F.lit(0).cast("int").alias("way")
    if nodes.count() <= most:  # no bucket can be larger
        return buckets.select("table", "bucket", plain, "hi", "lo", "id")
    large_ones = written(buckets.groupBy("table", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > most))
    if large_ones.isEmpty():
        return buckets.select("table", "bucket", plain, "hi", "lo", "id")
    rest = coordinates(tables, seed)[:, sampled:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                table, bucket, n, hi, lo, ids = (c.to_numpy() for c in whole.slice(a, 1024).columns)
                bit = np.unpackbits(np.ascontiguousarray(np.stack([hi, lo], 1)).view(np.uint8), axis=1)
                for t, b, size in np.unique(np.stack([table.astype(np.int64), bucket, n]), axis=1).T:
                    mine = np.flatnonzero((table == t) & (bucket == b))
                    depth, ways = division(int(size), cap, radius, sampled)
                    rng = np.random.default_rng([seed, int(t), int(b)])
                    for way in range(1, ways + 1):
                        use = rng.permutation(rest[t])[:depth]
                        piece = bit[mine][:, use] @ (1 << np.arange(depth, dtype=np.int64))
                        same = np.full(len(mine), t, np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(same), pa.array(piece << sampled | b), pa.array(np.full(len(mine), way, np.int32)), *(pa.array(x[mine]) for x in (hi, lo, ids))], ["table", "bucket", "way", "hi", "lo", "id"])

    on = ["table", "bucket"]
    hot = buckets.join(large_ones, on).select("table", "bucket", "n", "hi", "lo", "id").mapInArrow(run, "table int, bucket long, way int, hi long, lo long, id long")
    return buckets.join(large_ones.select(*on), on, "left_anti").select("table", "bucket", plain, "hi", "lo", "id").unionByName(hot)


def division(n: int, cap: int, radius: int, sampled: int) -> tuple[int, int]:
    """Further coordinates that bring n nodes down to half of cap on average, and in how many ways a pair at the radius, equal on the
    sample, must be divided so to stay together in one with all but a third of the probability that RECALL leaves."""
    depth = min(40, BITS - sampled - radius - 1, max(1, int(np.ceil(np.log2(2 * n / cap)))))
    left = BITS - sampled
    together = np.prod([(left - radius - j) / (left - j) for j in range(depth)])
    return depth, max(1, int(np.ceil(np.log((1 - RECALL) / 3) / np.log(1 - together))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tables: int = TABLES, sampled: int = SAMPLED, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, kept_doc_id, distance) of every document that is a near copy of another with a lesser id in its
    group; kept_doc_id is the group's least id, distance the Hamming distance of the two fingerprints (within a
    group linked by intermediate copies it may exceed the radius).  What isn't listed stays."""
    prints = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("id")))
    roots = components(links(nodes, radius, cap, tables, sampled, seed))
    own = prints.join(nodes, ["hi", "lo"]).join(roots, F.col("id") == F.col("node"), "left")
    moved = own.select("doc_id", "hi", "lo", F.coalesce("root", "id").alias("kept_doc_id")).where("doc_id <> kept_doc_id").distinct()
    heads = nodes.join(moved.select(F.col("kept_doc_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("kept_doc_id"), F.col("hi").alias("h"), F.col("lo").alias("l"))
    far = F.bit_count(F.col("hi").bitwiseXOR(F.col("h"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("l")))
    return moved.join(heads, "kept_doc_id").groupBy("doc_id").agg(F.min("kept_doc_id").alias("kept_doc_id"), F.min_by(far, "kept_doc_id").cast("double").alias("distance"))


def row_places(docs: DataFrame) -> DataFrame:
    """The rows with where each stands: columns __file and __pos.  Rows that don't come from Parquet files are written to the shared
    folder first."""
    hidden = docs._jdf.queryExecution().analyzed().metadataOutput()
    known = any("row_index" in hidden.apply(i).dataType().json() for i in range(hidden.size()))
    return (docs if known else written(docs)).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos"))


def copies(placed: DataFrame, id_col: str, text_col: str, radius: int, tables: int, sampled: int, cap: int, seed: int) -> DataFrame:
    """(__file, __pos) of every row but one of each group.  Texts stay where they are: only fingerprints and places are shuffled."""
    prepare(placed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = blob(batch.column(3))
            rows, prints = fingerprint(data, offsets)
            plain = np.setdiff1d(np.flatnonzero(np.diff(offsets)), rows)  # texts without a word, if not empty: as they are
            rest = np.array([np.frombuffer(hashlib.blake2b(data[offsets[i] : offsets[i + 1]].data, digest_size=16).digest(), np.int64) for i in plain], np.int64).reshape(-1, 2)
            both = np.concatenate([rows, plain]).astype(np.int64)
            hi, lo = np.concatenate([prints, rest]).T
            worded = np.arange(len(both)) < len(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(both)) for k in range(3)), pa.array(hi), pa.array(lo), pa.array(worded)], ["__file", "__pos", "id", "hi", "lo", "worded"])

    rows = placed.select("__file", "__pos", F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = written(rows.mapInArrow(run, "__file string, __pos long, id long, hi long, lo long, worded boolean"))
    kinds = ["hi", "lo", "worded"]
    place = F.struct(F.col("id").isNull().alias("none"), "id", "__file", "__pos")  # the least id stays, one without an id last
    nodes = written(prints.groupBy(*kinds).agg(F.min(place).alias("first"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    found = links(nodes.where("worded").select("hi", "lo", F.col("node").alias("id")), radius, cap, tables, sampled, seed)
    every = nodes.join(components(found), "node", "left").withColumn("group", F.coalesce("root", "node"))
    kept = every.groupBy("group").agg(F.min("first").alias("kept"), F.sum("n").alias("size")).where("size > 1")
    gone = prints.join(every.join(kept, "group").select(*kinds, F.col("kept.__file").alias("f"), F.col("kept.__pos").alias("p")), kinds)
    return gone.where("not (__file = f and __pos = p)").select("__file", "__pos")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tables: int = TABLES, sampled: int = SAMPLED, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The documents with one row of each group, columns as they were: the one with the least id, of equal ids the first in the files.
    Rows are what is grouped, so repeated rows of one id and copies without an id go too; so do exact copies of a text
    without words; null and empty texts all stay.

    What goes is written to the shared folder by file, and each task reads what concerns its own files: no text is shuffled, and
    nothing is broadcast."""
    placed = row_places(docs)
    where = own_folder(docs.sparkSession, "copies")
    gone = copies(placed, id_col, text_col, radius, tables, sampled, cap, seed)
    # a folder a file of the input, or of several whose names hash alike
    gone.withColumn("part", F.pmod(F.xxhash64("__file"), F.lit(PARTS))).repartition("part").sortWithinPartitions("part", "__file").write.partitionBy("part").parquet(where)
    keep = [c for c in placed.columns if c not in ("__file", "__pos")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, base = filesystem(where)
        held: dict[str, np.ndarray] = {}

        def places(file: str, part: int) -> np.ndarray:
            if file not in held:
                held.clear()
                folder = f"{base}/part={part}"
                there = system.get_file_info(folder).type != fs.FileType.NotFound
                held[file] = np.sort(pq.read_table(folder, columns=["__pos"], filters=[("__file", "=", file)], filesystem=system)["__pos"].to_numpy()) if there else np.zeros(0, np.int64)
            return held[file]

        for batch in batches:
            file, pos = batch.column(batch.num_columns - 3), batch.column(batch.num_columns - 2).to_numpy()
            part = batch.column(batch.num_columns - 1)
            stay = np.ones(batch.num_rows, bool)
            codes = file.dictionary_encode()
            for k, name in enumerate(codes.dictionary.to_pylist()):
                mine = np.flatnonzero(codes.indices.to_numpy() == k)
                stay[mine] = ~np.isin(pos[mine], places(name, part[int(mine[0])].as_py()))
            yield batch.select(list(range(batch.num_columns - 3))).filter(pa.array(stay))

    return placed.select(*keep, "__file", "__pos", F.pmod(F.xxhash64("__file"), F.lit(PARTS)).alias("__part")).mapInArrow(run, docs.schema)
