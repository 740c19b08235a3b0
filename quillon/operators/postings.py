"""Terms of many documents at once.  Spark finds the tokens; numpy drops stop words and numbers by distinct token and sorts what is
kept, in pieces of so many tokens.  What a document holds is told in one place, so no token is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import tokens

#: Tokens that are worked on together; a document isn't divided.
PIECE = 1 << 19
_HEX = frozenset("0123456789abcdef")


def _number(term: str) -> bool:
    """functions.text.is_number of a token."""
    if term.isascii() and not _HEX.issuperset(term):
        return term.startswith("0x") and len(term) > 2 and _HEX.issuperset(term[2:]) or not any(c.isalpha() and c not in _HEX for c in term)
    return not any(c.isalpha() and c not in _HEX for c in term)


def _kept(lists: pa.Array, stop: frozenset[str], drop_numbers: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place, term's number, terms) of the tokens that are kept, by row and place; terms are in order as text."""
    coded = pc.list_flatten(lists).dictionary_encode()
    by_text = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_text), np.int64)
    rank[by_text] = np.arange(len(by_text))
    good = np.fromiter((t not in stop and not (drop_numbers and _number(t)) for t in coded.dictionary.to_pylist()), bool, len(by_text))
    index = coded.indices.to_numpy()
    mask = good[index]
    row, term = pc.list_parent_indices(lists).to_numpy()[mask], rank[index[mask]]
    return row, np.arange(len(row)) - np.searchsorted(row, row), term, coded.dictionary.take(pa.array(by_text))


def _pieces(batches: Iterator[pa.RecordBatch], by_id: bool) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of about PIECE tokens; by_id, those of an id that stand together aren't divided."""
    held: list[pa.RecordBatch] = []
    n, limit = 0, PIECE
    for batch in batches:
        at, sizes = 0, pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().cumsum()
        while at < batch.num_rows:
            room = limit - n + (sizes[at - 1] if at else 0)
            end = max(at + 1, int(np.searchsorted(sizes, room, "right")))
            held.append(batch.slice(at, end - at))
            n += int(sizes[end - 1] - (sizes[at - 1] if at else 0))
            at = end
            if n >= limit or at < batch.num_rows:
                whole = pa.concat_batches(held)
                rest = whole.num_rows
                if by_id:  # the last id may go on
                    rest = int(np.flatnonzero(_first(whole.column(0)))[-1])
                if rest:
                    yield whole.slice(0, rest)
                held = [whole.slice(rest)] if rest < whole.num_rows else []
                n = sum(len(pc.list_flatten(h.column(1))) for h in held)
                limit = max(PIECE, 2 * n)  # an id that is larger isn't looked through row by row
    if held:
        yield pa.concat_batches(held)


def _first(ids: pa.Array) -> np.ndarray:
    """Whether each id differs from the one before; nulls are alike."""
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)])


def postings(docs: DataFrame, id_col: str, text_col: str, stop_words: tuple[str, ...], places: bool) -> DataFrame:
    """(term, doc_id, freq), and positions where places are wanted: places among the terms that are kept, from 0, ascending.  Rows of an
    id count as one document, each with its own places.  One shuffle, of the texts by id."""
    stop = frozenset(stop_words)
    own = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition("doc_id").sortWithinPartitions("doc_id").select("doc_id", tokens(F.col("text")).alias("tokens"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, True):
            row, place, term, terms = _kept(piece.column(1), stop, True)
            doc = np.cumsum(_first(piece.column(0)))[row]
            order = np.lexsort((place, term, doc))
            row, place, term, doc = row[order], place[order], term[order], doc[order]
            starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]))
            ends = np.append(starts, len(doc))
            columns = {"term": terms.take(pa.array(term[starts])), "doc_id": piece.column(0).take(pa.array(row[starts])), "freq": pa.array(np.diff(ends))}
            if places:
                columns["positions"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(index, f"term string, doc_id {own}, freq long" + (", positions array<int>" if places else ""))


def term_counts(docs: DataFrame, text_col: str, stop_words: tuple[str, ...]) -> DataFrame:
    """(term, freq) of each piece of documents, for sums."""
    stop = frozenset(stop_words)
    rows = docs.select(F.lit(0).alias("none"), tokens(F.col(text_col)).alias("tokens"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, False):
            _, _, term, terms = _kept(piece.column(1), stop, True)
            found, n = np.unique(term, return_counts=True)
            yield pa.RecordBatch.from_pydict({"term": terms.take(pa.array(found)), "freq": pa.array(n.astype(np.int64))})

    return rows.mapInArrow(count, "term string, freq long")


def _sums(group: np.ndarray, code: np.ndarray, size: int, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, code, sums of the weights) of each pair of group and code, in order."""
    pair, where = np.unique(group * max(1, size) + code, return_inverse=True)
    return *np.divmod(pair, max(1, size)), *(np.bincount(where, w, len(pair)).astype(np.int64) for w in weights)


def pair_counts(docs: DataFrame, text_col: str, stop_words: tuple[str, ...], both_ways: bool) -> DataFrame:
    """(t1, t2, forward, backward), t1 not behind t2 as text: how often t1 has t2 behind it, and the other way about.  A document's
    last term counts as one that has itself behind it.  Pieces of documents are counted, a row a term goes with all its neighbours to
    where that term is summed, and those not seen both ways go there if so asked."""
    stop = frozenset(stop_words)
    rows = docs.select(F.lit(0).alias("none"), tokens(F.col(text_col)).alias("tokens"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, False):
            row, _, a, terms = _kept(piece.column(1), stop, True)
            b = np.where(np.append(row[1:] == row[:-1], np.zeros(min(1, len(row)), bool)), np.append(a[1:], a[:1]), a)
            t1, t2, ahead, back = _sums(np.minimum(a, b), np.maximum(a, b), len(terms), a <= b, a > b)
            starts = np.flatnonzero(np.diff(t1, prepend=-1))
            ends = pa.array(np.append(starts, len(t1)).astype(np.int32))
            lists = {"t2": terms.take(pa.array(t2)), "forward": pa.array(ahead), "backward": pa.array(back)}
            yield pa.RecordBatch.from_pydict({"t1": terms.take(pa.array(t1[starts])), **{k: pa.ListArray.from_arrays(ends, v) for k, v in lists.items()}})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last term, which may go on, with what it has so far
        for piece in _pieces(batches, False):
            whole = pa.concat_batches([*held, piece])
            first = _first(whole.column(0))
            coded = pc.list_flatten(whole.column(1)).dictionary_encode()
            group = (np.cumsum(first) - 1)[pc.list_parent_indices(whole.column(1)).to_numpy()]
            group, code, ahead, back = _sums(group, coded.indices.to_numpy().astype(np.int64), len(coded.dictionary), *(pc.list_flatten(whole.column(k)).to_numpy() for k in (2, 3)))
            t1, t2 = whole.column(0).take(pa.array(np.flatnonzero(first)[group])), coded.dictionary.take(pa.array(code))
            found = pa.RecordBatch.from_pydict({"t1": t1, "t2": t2, "forward": pa.array(ahead), "backward": pa.array(back)})
            done = int(np.searchsorted(group, group[-1]))
            yield shown(found.slice(0, done))
            rest = found.slice(done)
            held = [pa.RecordBatch.from_arrays([rest.column(0).slice(0, 1), *(pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), pa.concat_arrays([c])) for c in rest.columns[1:])], schema=whole.schema)]
        for last in held:
            flat = [pc.list_flatten(c) for c in last.columns[1:]]
            yield shown(pa.RecordBatch.from_arrays([last.column(0).take(pa.array(np.zeros(len(flat[0]), np.int64))), *flat], names=["t1", "t2", "forward", "backward"]))

    def shown(found: pa.RecordBatch) -> pa.RecordBatch:
        return found.filter(pc.and_(pc.greater(found.column(2), 0), pc.greater(found.column(3), 0))) if both_ways else found

    counted = rows.mapInArrow(count, "t1 string, t2 array<string>, forward array<long>, backward array<long>")
    return counted.repartition("t1").sortWithinPartitions("t1").mapInArrow(total, "t1 string, t2 string, forward long, backward long")
