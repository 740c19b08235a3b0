r"""Substring deduplication by hashing lines, paragraphs or the sentences of lines.

A text is cut into units, which together are the whole text: ``line`` ends after each newline, ``paragraph``
after each blank line, ``sentence`` after each newline and after each run of ``. ! ?``, so that every line is a run of
sentences.  A unit's normal form is its words (runs of ASCII letters, digits and characters from U+0080 on, ASCII
letters in lower case), joined by one space; its digest is 128 bits of hash of that.  Units without a word are passed over.

Digests are grouped over all documents, with partial sums before the shuffle, so that a unit which is
everywhere makes no hot task.  The earliest occurrence by (rank, place) stays, in the same document or another; all others
are repeats.  Repeats that follow one another in a document are a run, and a run of ``min_words`` words or more is removed;
so common short units don't go by themselves, but do where they are part of a copied passage.  What is listed of a removed
unit is where it stood in its document, in characters, and where the one stands that was kept.

Production takes sentences: a copied passage seldom begins where a line does, and then only whole lines inside it would be found.

Defined results: a null or empty text has no units; rows with a null id are left out; the rank is the id unless a
column is named, and ties of rank go to the lesser id, then the earlier place; rows of one id with other texts are
documents of their own, those that repeat id and text are one document: where rows of one id tie in place too, all stay; an empty table
gives an empty result; other columns are ignored, whatever their names; a text of any length is taken in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, NO_WORD, U64, blob, char_counts, mix, power, prefix_sums, prepare, span_hashes, stretches, words, written

#: The unit, and the least number of words of a run of repeats that is removed.
UNIT, MIN_WORDS = "sentence", 13
#: A digest that so many times its occurrences are all units is joined without a shuffle; no more than HOT digests can be such.
HOT = 10_000
_A, _B = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def unit_marks(data: np.ndarray, begins: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes a unit ends behind; begins: where rows do, since what stands before a row isn't part of it."""
    newline = data == 10
    if unit == "line":
        return newline
    if unit == "paragraph":
        marks = newline.copy()
        marks[1:] &= newline[:-1]
        marks[begins[begins < len(data)]] = False
        marks[:-1] &= ~newline[1:]  # only the last newline of a run ends the paragraph
        return marks
    if unit == "sentence":
        marks = newline | (data == 46) | (data == 33) | (data == 63)
        marks[:-1] &= ~marks[1:]
        return marks
    raise ValueError(f"no unit is called {unit!r}")


def unit_ends(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Ends of all units, ascending; the end of a row always is one."""
    return np.union1d(np.flatnonzero(unit_marks(data, offsets[:-1], unit)) + 1, offsets[1:][np.diff(offsets) > 0])


def sums(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For the stretches between bounds: their words, and two sums of the words' hashes, each times a power of its place."""
    word_start, word_end, _ = words(part, bounds)
    of = np.searchsorted(bounds[1:], word_start, "right")
    count = np.bincount(of, minlength=len(bounds) - 1)
    first = np.r_[0, np.cumsum(count)[:-1]]
    value = span_hashes(LOWER[part], word_start, word_end)
    out = []
    for base in (_A, _B):
        low, high = prefix_sums(value, base, [first, first + count])
        out.append((high - low) * power(pow(base, -1, 1 << 64), first))
    return count, out


def digests(data: np.ndarray, offsets: np.ndarray, unit: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, unit number, number among those with words, start, end, words, words so far, digest, digest) of every unit with words; places in characters."""
    for a, b, low, high in stretches(offsets, data, NO_WORD):
        if low == high:
            continue
        part = data[low:high]
        if low == offsets[a] and high == offsets[b]:
            own = offsets[a : b + 1] - low
            ends = unit_ends(part, own, unit)
            starts = np.r_[0, ends[:-1]]
            count, pair = sums(part, np.r_[0, ends])
            use = np.flatnonzero(count)
            if not len(use):
                continue
            row = np.searchsorted(own, starts, "right") - 1
            bounds = np.r_[0, ends]
            char = char_counts(part, bounds)
            base = char[np.searchsorted(bounds, own[row[use]])]
            number = use - np.searchsorted(row, row[use])
            first = np.searchsorted(row[use], row[use])
            total = np.cumsum(count[use])
            so_far = total - (total - count[use])[first]
            yield a + row[use], number, np.arange(len(use)) - first, char[use] - base, char[use + 1] - base, count[use], so_far, *(mix(p[use] + count[use].astype(U64)).view(np.int64) for p in pair)
            continue
        # a piece of one long row: its first unit may have begun before, its last may go on
        if low == offsets[a]:
            number = nth = so_far = char = 0
            left = (0, 0, U64(0), U64(0))  # of the open unit: start, words, sums
        since, upto = max(low - 1, int(offsets[a])), min(high + 1, int(offsets[b]))
        ends = np.flatnonzero(unit_marks(data[since:upto], np.array([0]) if since == offsets[a] else np.zeros(0, np.int64), unit)[low - since : high - since]) + 1
        closed = len(ends)
        if high == offsets[b] and not (closed and ends[-1] == high - low):
            ends, closed = np.r_[ends, high - low], closed + 1
        bounds = np.r_[0, ends] if closed and ends[-1] == high - low else np.r_[0, ends, high - low]
        count, pair = sums(part, bounds)
        count = count.copy()
        pair = [p.copy() for p in pair]
        for k, base in enumerate((_A, _B)):
            pair[k][:1] = left[2 + k] + power(base, np.array([left[1]])) * pair[k][:1]
        count[0] += left[1]
        place = char + char_counts(part, bounds)
        begin = np.r_[left[0], place[1:-1]]
        use = np.flatnonzero(count[:closed])
        if len(use):
            yield np.full(len(use), a), number + use, nth + np.arange(len(use)), begin[use], place[1:][use], count[use], so_far + np.cumsum(count[use]), *(mix(p[use] + count[use].astype(U64)).view(np.int64) for p in pair)
        number, nth, so_far, char = number + closed, nth + len(use), so_far + int(count[:closed].sum()), int(place[-1])
        left = (int(begin[closed]), int(count[closed]), pair[0][closed], pair[1][closed]) if closed < len(count) else (char, 0, U64(0), U64(0))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, unit: str = UNIT) -> DataFrame:
    """(rank, doc_id, row, unit, nth, start, end, n, so_far, h1, h2), row being a hash of the text, rank only where a column is named:
    one narrow pass over the texts."""
    prepare(docs.sparkSession)
    keys = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row")]
    if rank_col:  # a null rank comes last
        keys.insert(0, F.coalesce(F.col(rank_col).cast("long"), F.lit((1 << 63) - 1)).alias("rank"))
    rows = docs.select(*keys, F.col(text_col).alias("text")).where("doc_id is not null")
    names = [*rows.columns[:-1], "unit", "nth", "start", "end", "n", "so_far", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
            for row, *rest in digests(*blob(batch.column(batch.num_columns - 1)), unit):
                yield pa.RecordBatch.from_arrays([pa.array(x[row], pa.int64()) for x in own] + [pa.array(x, pa.int64()) for x in rest], names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, unit: str = UNIT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, unit, start, end, kept_doc_id, kept_start) of every unit to remove.

    Units are written once to the shared folder as narrow rows.  Their digests are grouped; those that occur once
    drop out; the rest join back, those that are everywhere without a shuffle.  Runs are found among the repeats alone."""
    found = _found(docs, id_col, text_col, rank_col, unit, min_words)
    return found.select("doc_id", "unit", "start", "end", "kept_doc_id", "kept_start")


def _found(docs: DataFrame, id_col: str, text_col: str, rank_col: str | None, unit: str, min_words: int) -> DataFrame:
    unit_marks(np.zeros(0, np.uint8), np.zeros(0, np.int64), unit)  # the name is checked before anything runs
    order = ["rank", "doc_id", "start"] if rank_col else ["doc_id", "start"]  # without a rank of its own, the id is the rank
    every = written(units(docs, id_col, text_col, rank_col, unit))
    first = every.groupBy("h1", "h2").agg(F.min(F.struct(*order)).alias("f"), F.count("*").alias("times")).where("times > 1")
    first = written(first.select("h1", "h2", "times", *(F.col(f"f.{c}").alias(f"kept_{c}") for c in order)))
    # digests that are everywhere, of which there are HOT at most, are joined where their units are; the others are shuffled
    hot = F.broadcast(first.where(F.col("times") * HOT >= every.count()))
    rest = every.join(hot, ["h1", "h2"], "left_anti").join(first, ["h1", "h2"])
    both = every.join(hot, ["h1", "h2"]).unionByName(rest)
    both = both.where("not (" + " and ".join(f"{c} = kept_{c}" for c in order) + ")").drop("h1", "h2", "times")
    own = ["doc_id", *order[:-2], "row"]
    run = both.withColumn("run", F.col("nth") - F.dense_rank().over(Window.partitionBy(*own).orderBy("nth")))
    whole = Window.partitionBy(*own, "run")
    size = F.max("so_far").over(whole) - F.min(F.col("so_far") - F.col("n")).over(whole)
    return run.withColumn("words", size).where(F.col("words") >= min_words)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, unit: str = UNIT, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with the repeated units cut out of their texts, and a column ``kept_spans`` that retains the original
    offsets: an array of (start, end), in characters, of what is left of the original text.  A document with nothing left has
    an empty text; nulls and documents without repeats come through unchanged, with their whole span."""
    found = _found(docs, id_col, text_col, rank_col, unit, min_words)
    gone = found.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("__gone"))
    both = docs.join(gone, (docs[id_col].cast("long") == gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__row"]), "left").select(*docs.columns, "__gone")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text, cuts in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                text = text.as_py()
                edges = [(c["s"], c["e"]) for c in cuts.as_py() or []]
                kept = None if text is None else [(s, e) for s, e in zip([0, *(e for _, e in edges)], [*(s for s, _ in edges), len(text)], strict=True) if s < e]
                texts.append(text if text is None or not edges else "".join(text[s:e] for s, e in kept))
                spans.append(None if kept is None else [{"start": s, "end": e} for s, e in kept])
            columns = [pa.array(texts, batch.column(at).type) if j == at else batch.column(j) for j in range(batch.num_columns - 1)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*batch.schema.names[:-1], "kept_spans"])

    from pyspark.sql import types as T

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return both.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("kept_spans", span)]))


#: The same over ``documents`` with the production unit, for DuckDB.
ORACLE_SQL = rf"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS pieces FROM documents),
u AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS unit FROM p),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY unit) AS "end",
           regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM u),
n AS (SELECT doc_id, unit, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS nth, "end" - length(piece) AS start, "end", len(words) AS size, array_to_string(words, ' ') AS form FROM placed WHERE len(words) >= 1),
r AS (SELECT *, row_number() OVER w AS occurrence, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start FROM n WINDOW w AS (PARTITION BY form ORDER BY doc_id, start)),
i AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM r WHERE occurrence > 1),
s AS (SELECT *, sum(size) OVER (PARTITION BY doc_id, run) AS total FROM i)
SELECT doc_id, CAST(unit AS BIGINT) AS unit, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", kept_doc_id, CAST(kept_start AS BIGINT) AS kept_start FROM s WHERE total >= {MIN_WORDS}"""
