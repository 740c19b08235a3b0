"""Benchmark decontamination with suffix arrays over the training texts.

Every task cuts its training documents into shards of about ``SHARD`` bytes.  A shard's words (runs of letters,
digits and bytes from 128 on; what stands between them doesn't count) are numbered, and the array of all its
suffixes, which begin at any word and end with their document, is sorted by prefix doubling.  Every suffix of every
benchmark item is then looked up in every shard by binary search, one word deeper at a time.  Suffixes of the
training texts that share ``min_words`` words with it are extended to their full verbatim length; words are compared by 64-bit hashes, and
what is found by their bytes.  An item shorter than ``min_words`` words must occur whole.  One of fewer than ``least_words`` isn't
looked for, since any document may hold so short a string by chance; ``skipped`` lists such items.  Documents with a match are affected.

A document longer than a shard is searched in windows that overlap by the longest item, so that each match lies whole in one.

The benchmark is what is sent to all tasks; its size is checked, and one above ``SENT`` bytes is searched for in
slices, one pass over the training texts each.

Defined results: null or empty texts on either side, and items with too few words or with a null id, match nothing; rows with a null id
are searched too and match under a null doc_id; repeated rows of one id yield its longest match once; ties go to
the first place in the document, then the first in the item; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import U64, blob, chunks, prepare, script_words, span_hashes

#: Words that must agree, least words of an item, bytes of a shard of training text, and bytes of benchmark text sent at once.
MIN_WORDS, LEAST_WORDS, SHARD, SENT = 13, 8, 2 << 20, 32 << 20


def suffix_array(ids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order: ids are word numbers from 1 on, left the words from each to its document's end."""
    n = len(ids)
    per = 3 if n < (1 << 21) - 1 else 2  # words that fit a 64-bit key
    key = first_key(ids, left, per)
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]]
    slot = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = slot + 1
    depth = per
    tied = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))  # places whose suffix isn't yet told from its neighbour
    while len(tied):
        at = order[tied]
        if depth >= left[at].max():
            break  # what is still tied is equal to its end
        far = np.where(left[at] > depth, rank[np.minimum(at + depth, n - 1)], 0)
        both = rank[at].astype(U64) << U64(32) | far.astype(U64)
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[tied] = at
        new = np.r_[True, both[1:] != both[:-1]]
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
        tied = tied[~(new & np.r_[new[1:], True])]
        depth *= 2
    return order


def first_key(ids: np.ndarray, left: np.ndarray, per: int) -> np.ndarray:
    """The first per words of each suffix in one integer; words beyond the document's end are 0."""
    bits = 63 // per
    key = np.zeros(len(ids), U64)
    for j in range(per):
        nth = np.zeros(len(ids), U64)
        nth[: len(ids) - j] = ids[j:]
        key = key << U64(bits) | np.where(left > j, nth, U64(0))
    return key


class Items:
    """The words of all benchmark items, one after another."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.ids = np.array(ids, np.int64)
        data, offsets = blob(pa.array(texts, pa.string()))
        starts, ends, self.item = script_words(data, offsets)
        self.hash = span_hashes(data, starts, ends)
        size = np.bincount(self.item, minlength=len(texts))
        first = np.r_[0, np.cumsum(size)]
        self.left = first[1:][self.item] - np.arange(len(starts))
        self.nth = np.arange(len(starts)) - first[:-1][self.item]
        self.size = size[self.item]
        self.start, self.end = starts - offsets[:-1][self.item], ends - offsets[:-1][self.item]
        self.text = [np.frombuffer(t.encode(), np.uint8) for t in texts]


def search(data: np.ndarray, offsets: np.ndarray, items: Items, min_words: int, least_words: int = LEAST_WORDS) -> Iterator[tuple]:
    """(row, item, words, start, end, item start, item end) in bytes: of each row and item the longest match, over
    all suffixes of all items and all shards of the blob."""
    need = np.where(items.size < min(least_words, min_words), np.iinfo(np.int64).max, np.minimum(min_words, items.size))
    for a, b in chunks(offsets, SHARD):
        part = data[offsets[a] : offsets[b]]
        if len(part) <= SHARD:
            for row, *hit in search_shard(part, offsets[a : b + 1] - offsets[a], items, need):
                yield a + row, *hit
        else:
            for hit in search_long(part, items, need):
                yield a, *hit


def search_long(text: np.ndarray, items: Items, need: np.ndarray) -> Iterator[tuple]:
    """The same for one text of more than a shard, without its row."""
    overlap, best, at, size = int(items.size.max(initial=1)), {}, 0, SHARD
    while True:
        end = min(len(text), at + size)
        while end < len(text) and text[end] & 0xC0 == 0x80:  # between characters
            end -= 1
        part = text[at:end]
        starts, _, _ = script_words(part, np.array([0, len(part)]))
        if end < len(text):
            if len(starts) < 2 * overlap + 2:  # the window has to go on behind what it shares with the next
                size *= 2
                continue
            part = part[: starts[-1]]  # the last word may be cut
        for _, item, n, s, e, x, y in search_shard(part, np.array([0, len(part)]), items, need):
            key = (-n, at + s, x)
            if item not in best or key < best[item][0]:
                best[item] = (key, (item, n, at + s, at + e, x, y))
        if end == len(text):
            yield from (hit for _, (_, hit) in sorted(best.items()))
            return
        at, size = at + int(starts[len(starts) - 1 - overlap]), SHARD


def search_shard(part: np.ndarray, own: np.ndarray, items: Items, need_all: np.ndarray) -> Iterator[tuple]:
    """The same for one shard."""
    starts, ends, doc = script_words(part, own)
    if not len(starts):
        return
    kinds, ids = np.unique(span_hashes(part, starts, ends), return_inverse=True)
    ids = ids.astype(np.int64) + 1
    size = np.bincount(doc, minlength=len(own) - 1)
    left = np.cumsum(size)[doc] - np.arange(len(ids))
    order = suffix_array(ids, left)
    sought = np.searchsorted(kinds, items.hash)
    known = kinds[np.minimum(sought, len(kinds) - 1)] == items.hash
    sought = np.where(known, sought + 1, -1)
    # the first words by one binary search over packed keys, then one word at a time within the interval
    able = np.flatnonzero((items.left >= need_all) & known)
    lo, hi = np.zeros(len(able), np.int64), np.full(len(able), len(order))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    depth, per = 0, 3 if len(ids) < (1 << 21) - 1 else 2
    long = able[(need_all[able] >= per)]
    if len(long):
        key = first_key(ids, left, per)[order]
        bits = U64(63 // per)
        want, whole = np.zeros(len(long), U64), np.ones(len(long), bool)
        for j in range(per):
            nth = sought[long + j]
            whole &= nth > 0
            want = want << bits | np.maximum(nth, 0).astype(U64)
        long, want = long[whole], want[whole]
        groups = [(long, np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right"), per)]
    else:
        groups = []
    short = able[need_all[able] < per]
    if len(short):
        groups.append((short, np.zeros(len(short), np.int64), np.full(len(short), len(order)), 0))
    for at, lo, hi, depth in groups:
        while True:
            live = hi > lo
            at, lo, hi = at[live], lo[live], hi[live]
            if not len(at):
                break
            full = need_all[at] == depth
            for q, x, y in zip(at[full], lo[full], hi[full], strict=True):
                found.append((np.full(y - x, q), order[x:y]))
            at, lo, hi = at[~full], lo[~full], hi[~full]
            if not len(at):
                break
            want = sought[at + depth]
            end = bound(ids, left, order, lo, hi, depth, want, True)
            lo, hi, depth = bound(ids, left, order, lo, hi, depth, want, False), end, depth + 1
    if not found:
        return
    q, p = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    # a match that goes on to the left is part of a longer one
    inner = (items.nth[q] > 0) & (p > 0) & (doc[np.maximum(p - 1, 0)] == doc[p]) & (sought[np.maximum(q - 1, 0)] == ids[np.maximum(p - 1, 0)])
    q, p = q[~inner], p[~inner]
    length = need_all[q].copy()
    room = np.minimum(left[p], items.left[q])
    grow = np.flatnonzero(length < room)
    while len(grow):
        same = ids[p[grow] + length[grow]] == sought[q[grow] + length[grow]]
        grow = grow[same]
        length[grow] += 1
        grow = grow[length[grow] < room[grow]]
    best = np.lexsort((items.nth[q], p, -length, items.item[q], doc[p]))
    q, p, length = q[best], p[best], length[best]
    new = np.r_[True, (doc[p][1:] != doc[p][:-1]) | (items.item[q][1:] != items.item[q][:-1])]
    for q1, p1, n in zip(q[new], p[new], length[new], strict=True):
        d, text = doc[p1], items.text[items.item[q1]]
        if all(np.array_equal(part[starts[p1 + j] : ends[p1 + j]], text[items.start[q1 + j] : items.end[q1 + j]]) for j in range(n)):
            yield int(d), int(items.item[q1]), int(n), int(starts[p1] - own[d]), int(ends[p1 + n - 1] - own[d]), int(items.start[q1]), int(items.end[q1 + n - 1])


def bound(ids: np.ndarray, left: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, above: bool) -> np.ndarray:
    """Within [lo, hi), whose suffixes agree on depth words: the first whose next word isn't below (or is above) want."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        p = order[mid]
        word = np.where(left[p] > depth, ids[np.minimum(p + depth, len(ids) - 1)], 0)
        on = word <= want[open_] if above else word < want[open_]
        lo[open_[on]] = mid[on] + 1
        hi[open_[~on]] = mid[~on]


def slices(benchmark: DataFrame, id_col: str, text_col: str, sent: int) -> Iterator[Items]:
    """The benchmark in parts of about sent bytes."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // sent + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()
        if part:
            yield Items([r.id for r in part], [r.text for r in part])


def skipped(benchmark: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(item_id, n_words) of the items that are too short to be looked for; those without words or with a null id too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = blob(batch.column(1))
            n = np.bincount(script_words(data, offsets)[2], minlength=batch.num_rows)
            short = pa.array((n < least_words) | batch.column(0).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["item_id", "n_words"]).filter(short)

    return benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).mapInArrow(run, "item_id long, n_words long")


def scanner(docs: DataFrame, items: Items, min_words: int, least_words: int) -> Callable[[pa.Array], tuple[list[tuple], np.ndarray, np.ndarray]]:
    held = docs.sparkSession.sparkContext.broadcast(items)

    def scan(column: pa.Array) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        data, offsets = blob(column)
        return list(search(data, offsets, held.value, min_words, least_words)), data, offsets

    return scan


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS, least_words: int = LEAST_WORDS, sent: int = SENT) -> DataFrame:
    """(doc_id, item_id, n_words, doc_start, doc_end, item_start, item_end) of every affected document and the item
    it repeats: the longest verbatim match and its places, in characters.  One pass for each slice of the benchmark;
    only matches are shuffled."""
    spark = docs.sparkSession
    prepare(spark)
    schema = "doc_id long, item_id long, n_words long, doc_start long, doc_end long, item_start long, item_end long"
    out = spark.createDataFrame([], schema)
    for items in slices(benchmark, item_id_col, item_text_col, sent):
        scan = scanner(docs, items, min_words, least_words)

        def run(batches: Iterator[pa.RecordBatch], scan=scan, texts=items.text, item_ids=items.ids) -> Iterator[pa.RecordBatch]:
            def chars(text: np.ndarray, end: int) -> int:
                return int(((text[:end] & 0xC0) != 0x80).sum())

            for batch in batches:
                hits, data, offsets = scan(batch.column(1))
                ids = batch.column(0).to_pylist() if hits else []
                rows = []
                for row, item, n, s, e, x, y in hits:
                    text = data[offsets[row] : offsets[row + 1]]
                    rows.append((ids[row], int(item_ids[item]), int(n), chars(text, s), chars(text, e), chars(texts[item], x), chars(texts[item], y)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "n_words", "doc_start", "doc_end", "item_start", "item_end"])

        out = out.unionByName(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema))
    best = F.max(F.struct("n_words", (-F.col("doc_start")).alias("a"), (-F.col("item_start")).alias("b"), "doc_end", "item_end"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.n_words", (-F.col("m.a")).alias("doc_start"), "m.doc_end", (-F.col("m.b")).alias("item_start"), "m.item_end")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS, least_words: int = LEAST_WORDS, sent: int = SENT) -> DataFrame:
    """The documents without any match; columns as they were.  Each slice of the benchmark is one narrow pass, no shuffle."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    for items in slices(benchmark, item_id_col, item_text_col, sent):
        scan = scanner(docs, items, min_words, least_words)

        def run(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[h[0] for h in scan(batch.column(at))[0]]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
