"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to ``ORDER`` is counted over a bounded sample of labelled
documents and then frozen.  A byte's code length under a language follows escape method C without exclusion:
with n the count and q the number of distinct successors of a context, a successor seen c times costs
-log2(c / (n + q)) bits; another one costs the escape -log2(q / (n + q)) plus its cost in the context that is
one byte shorter, and below order 0 every byte costs 8 bits.  A context that the language has not seen costs
nothing and gives way to the shorter one.  A text's code length is the sum over all its bytes, each with as many
preceding bytes of the same text as there are, up to ORDER.  The language with the least code length wins.

The trees of all languages are merged into one table per order whose rows hold the exact costs in every
language, so that one vectorised lookup scores a byte for all languages at once.

Defined results: a null or empty text has code length 0 everywhere and lang_pred null; ties go to the
language that sorts first; rows with a null id are kept; repeated rows are scored alike; without any labelled
document every lang_pred is null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import U64, blob, prepare, stretches

#: Longest context in bytes; labelled documents sampled per language (the bound of the training sample) and
#: bytes taken in all per language.
ORDER, SAMPLE_DOCS, SAMPLE_BYTES = 4, 150, 1 << 20
EMPTY = U64((1 << 64) - 1)
EVERY = np.ones(256, bool)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k = 0..order: the packed (k preceding bytes, byte) of each position that has k predecessors in its row."""
    since = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = data.astype(U64)
    yield 0, np.arange(len(data)), key
    for k in range(1, order + 1):
        key = key.copy()
        key[k:] |= data[:-k].astype(U64) << U64(8 * k)
        at = np.flatnonzero(since >= k)
        yield k, at, key[at]


def count(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order the sorted packed grams of the texts and their counts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
    return [np.unique(key, return_counts=True) for _, _, key in grams(data, offsets, order)]


class Lookup:
    """Packed key -> row number, by open addressing in numpy; -1 where the key is absent."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.slots, self.rows = np.full(1 << bits, EMPTY), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self.home(keys)
        while len(left):  # the first claimant of a free slot gets it, the others move on
            free = self.slots[at] == EMPTY
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.slots[at[first]], self.rows[at[first]] = keys[left[first]], left[first]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left, at = left[stay], (at[stay] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.home(keys)
        there = self.slots[at]
        out = np.where(there == keys, self.rows[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != EMPTY))
        while len(left):
            at_left = (at[left] + 1) & self.mask
            at[left] = at_left
            there = self.slots[at_left]
            out[left] = np.where(there == keys[left], self.rows[at_left], np.int32(-1))
            left = left[(there != keys[left]) & (there != EMPTY)]
        return out


class Model:
    """Merged context trees of several languages."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER) -> None:
        self.languages, self.order = sorted(samples), order
        counts = [count(samples[x], order) for x in self.languages]
        width = len(self.languages)
        self.find, self.cost, self.find_context, self.escape = [], [], [], []
        below_keys, below = np.zeros(0, U64), np.zeros((0, width), np.float32)
        for k in range(order + 1):
            keys = np.unique(np.concatenate([c[k][0] for c in counts] or [np.zeros(0, U64)]))
            contexts = np.unique(keys >> U64(8))
            cost, escape = np.zeros((len(keys), width), np.float64), np.zeros((len(contexts), width), np.float64)
            shorter = below[np.searchsorted(below_keys, keys & U64((1 << (8 * k)) - 1))].astype(np.float64) if k else np.full((len(keys), width), 8.0)
            of = np.searchsorted(contexts, keys >> U64(8))
            for j, c in enumerate(counts):
                own, times = c[k]
                at = np.searchsorted(contexts, own >> U64(8))
                n, q = np.bincount(at, times, len(contexts)), np.bincount(at, minlength=len(contexts))
                seen = q > 0
                escape[seen, j] = -np.log2(q[seen] / (n[seen] + q[seen]))
                cost[:, j] = escape[of, j] + shorter[:, j]
                cost[np.searchsorted(keys, own), j] = -np.log2(times / (n + q)[at])
            self.find.append(Lookup(keys))
            self.cost.append(cost.astype(np.float32))
            self.find_context.append(Lookup(contexts))
            self.escape.append(escape.astype(np.float32))
            below_keys, below = keys, self.cost[-1]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row in each language."""
        width, order = len(self.languages), self.order
        out = np.zeros((len(offsets) - 1, width))
        for a, b, low, high in stretches(offsets, data, EVERY, 1 << 19):
            if low == high or not width:
                continue
            before = min(order, low - int(offsets[a]))  # a piece of a long row begins with the bytes before it, as context
            part = data[low - before : high]
            own = offsets[a : b + 1] - low if b - a > 1 else np.array([0, len(part)])
            full = np.zeros(len(part), U64)
            for k in range(order + 1):
                full[k:] |= part[: len(part) - k].astype(U64) << U64(8 * k)
            history = np.minimum(np.arange(len(part)) - np.repeat(own[:-1], np.diff(own)), order)
            cost = np.zeros((len(part), width), np.float32)
            left = np.arange(before, len(part))
            for k in range(order, -1, -1):
                # those with k predecessors at least; the others wait for a shorter context
                able = left if k == 0 else left[history[left] >= k]
                wait = left[:0] if k == 0 else left[history[left] < k]
                key = full[able] & U64((1 << (8 * k + 8)) - 1)
                row = self.find[k](key)
                hit = row >= 0
                cost[able[hit]] += self.cost[k][row[hit]]
                able, key = able[~hit], key[~hit] >> U64(8)
                row = self.find_context[k](key)
                known = row >= 0
                cost[able[known]] += self.escape[k][row[known]]
                left = np.concatenate([able, wait])
            cost[left] += 8  # never seen at any order
            full_rows = np.flatnonzero(np.diff(own))
            out[a + full_rows] += np.add.reduceat(cost, own[full_rows], axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trees from, per language, the sample_docs labelled documents with any text whose ids hash least, and sample_bytes of them at
    most: of each as much from its beginning as an even share gives, what short ones leave going to the longer, and a
    sixteenth of the bytes at most.

    The choice is a pruned top-k over id and label only, of twice as many as are needed, since some may have no text; one more pass
    fetches what is used of their texts.  Only a language all of whose chosen documents are empty takes a pass over texts."""

    def pick(rows: DataFrame, most: int) -> dict[str, list[bytes]]:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
        keys = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null")
        chosen = [(r.id, r.lang) for r in keys.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "lang").distinct().collect()]
        text = F.substring(F.col(text_col), 1, max(1, sample_bytes // 16))
        fetched = docs.where(F.col(id_col).isin(sorted({i for i, _ in chosen}))).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col)).alias("place")).where("lang is not null and text <> ''").distinct().collect() if chosen else []
        found: dict[str, list[bytes]] = {lang: [] for _, lang in chosen}
        for r in sorted(fetched, key=lambda r: (r.lang, r.place, r.id, r.text)):
            found.setdefault(r.lang, []).append(r.text.encode())
        return found

    samples = pick(docs, 2 * sample_docs)
    empty = [lang for lang, texts in samples.items() if not texts]
    if empty:
        samples |= pick(docs.where(F.col(lang_col).isin(empty) & (F.col(text_col) != "")), sample_docs)
    return Model({lang: shared(texts[:sample_docs], sample_bytes) for lang, texts in samples.items() if texts and sample_bytes}, order)


def shared(texts: list[bytes], room: int) -> list[bytes]:
    """The texts, the longest cut to one length at which all of them fit the room."""
    sizes = sorted(len(t) for t in texts)
    for k, size in enumerate(sizes):
        if size * (len(sizes) - k) >= room:
            return [t[: max(1, room // (len(sizes) - k))] for t in texts]
        room -= size
    return texts


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, bits_per_byte, margin_bits) of every row: the winner, its code length per byte, and by
    how many bits in all it beats the next language.  One narrow pass, no shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model)  # its size is bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, None], dtype=object)
        for batch in batches:
            data, offsets = blob(batch.column(1))
            bits, size = model.bits(data, offsets), np.diff(offsets)
            if bits.shape[1]:
                best = np.where(size > 0, bits.argmin(1), len(names) - 1)
                low = np.sort(bits, axis=1)
                rate = np.divide(low[:, 0], size, out=np.zeros(len(size)), where=size > 0)
                margin = low[:, 1] - low[:, 0] if bits.shape[1] > 1 else np.zeros(len(size))
            else:
                best, rate, margin = np.zeros(len(size), int), np.zeros(len(size)), np.zeros(len(size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(rate), pa.array(margin)], ["doc_id", "lang_pred", "bits_per_byte", "margin_bits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, bits_per_byte double, margin_bits double")
