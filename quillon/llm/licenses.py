"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of 1 to ``LINES`` consecutive lines, since notices are wrapped.  Its set is its distinct words (runs of ASCII
letters, digits and characters from U+0080 on, ASCII letters in lower case); a template's set likewise.  A block matches a
template T when it holds at least ``THRESHOLD`` of T's words: |B & T| >= o(T) = ceil(THRESHOLD * |T|); one of several lines must
also be a notice rather than hold one by chance: it has at most ``MOST_WORDS`` times as many words as T's set.  Blocks
that match are listed unless a block within them matches too.

The join, exact by its filters:

* global order: the words of all templates, rarest first by the number of lines of the whole table they occur in;
* prefix: T shares o(T) words with B only if one of T's first |T| - o(T) + 1 words, in that order, is in B;
* length: the lines of B must have o(T) distinct words of T between them;
* position: if the rarest word of T that B has is T's i-th, counted from 0, the overlap can't exceed |T| - i;
* verification: the overlap itself, over the words as bytes, not their hashes.

Two narrow passes over the texts: one counts, one joins.  Templates are sent to all tasks; they are a fixed list, whose
size is checked.

Defined results: null or empty texts, empty lines and templates without words match nothing; rows with a null id are
scanned and listed under a null doc_id; repeated rows are listed each; ties of frequency are ordered by word; an
empty table gives an empty result; other columns are ignored, whatever their names; a text of any length is taken in pieces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, NO_WORD, U64, blob, char_counts, prepare, span_hashes, stretches, words

THRESHOLD, LINES, MOST_WORDS, MOST_TEMPLATE_BYTES = 0.8, 6, 3, 8 << 20
#: Short public notices; name -> text.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-limits": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_set(text: str) -> set[bytes]:
    return set(_WORD.findall(re.sub(rb"[A-Z]+", lambda m: m.group().lower(), text.encode())))


class Vocabulary:
    """The templates' words in global order, and each template's prefix."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int] | None = None, threshold: float = THRESHOLD) -> None:
        sets = {name: s for name, s in ((n, word_set(t)) for n, t in sorted(templates.items())) if s}
        if sum(len(t) for t in templates.values()) > MOST_TEMPLATE_BYTES:
            raise ValueError("more text in the templates than is sent to all tasks")
        counts = counts or {}
        self.names = list(sets)
        self.words = sorted(set().union(*sets.values()) if sets else (), key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(self.words)}
        flat = np.frombuffer(b"".join(self.words), np.uint8)
        ends = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        self.hashes = span_hashes(flat, np.r_[0, ends[:-1]] if len(ends) else ends, ends) if len(ends) else np.zeros(0, U64)
        self.by_hash = np.argsort(self.hashes, kind="stable")
        self.sorted = self.hashes[self.by_hash]
        self.sets = [np.array(sorted(rank[w] for w in sets[n])) for n in self.names]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.place = np.full((len(self.names), len(self.words)), -1, np.int32)  # of each word among each template's
        for t, own in enumerate(self.sets):
            self.place[t, own] = np.arange(len(own))

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word; -1 for those of no template."""
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.by_hash[at], -1)


def line_words(data: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """Words of each line, and distinct (line, rank) pairs of the vocabulary's words, ascending; bounds: where lines begin, and the end."""
    first, last, line = words(data, bounds)
    rank = vocabulary.ranks(span_hashes(LOWER[data], first, last))
    known = np.flatnonzero(rank >= 0)
    _, at = np.unique(line[known] * len(vocabulary.words) + rank[known], return_index=True)
    at = verified(data, first, last, rank, known[at], vocabulary)
    return np.bincount(line, minlength=len(bounds) - 1), line[at], rank[at]


def lines_of(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> Iterator[tuple]:
    """(first row, ends of rows, where lines begin and the last ends, words of each line, line, rank): rows of about CHUNK bytes
    at a time, places relative to the first row.  Of a longer row only lines and pairs are held beside a piece."""
    held: list[tuple] = []
    for a, b, low, high in stretches(offsets, data, NO_WORD):
        if low == high:
            continue
        part, own = data[low:high], np.clip(offsets[a : b + 1], low, high) - low
        ends = np.union1d(np.flatnonzero(part == 10) + 1, own[1:][np.diff(own) > 0])
        bounds = np.r_[0, ends]
        found = line_words(part, bounds, vocabulary)
        if low == offsets[a] and high == offsets[b]:
            yield a, own, bounds, *found
            continue
        base, before = low - int(offsets[a]), 0
        if held:
            before = held[-1][3] + len(held[-1][0]) - (not held[-1][4])  # a line that a cut divides goes on
        held.append((bounds[:-1] + base, *found[:1], (found[1] + before, found[2]), before, bool(part[-1] == 10)))
        if high == offsets[b]:
            n = before + len(bounds) - 1
            count, begins = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
            for x, c, _, k, _ in held:
                count[k : k + len(x)] += c
                begins[k : k + len(x)] = np.minimum(begins[k : k + len(x)], x)
            pairs = np.unique(np.concatenate([p[0] * len(vocabulary.words) + p[1] for _, _, p, _, _ in held]))
            held = []
            yield a, np.array([0, high - int(offsets[a])]), np.r_[begins, high - int(offsets[a])], count, pairs // max(1, len(vocabulary.words)), pairs % max(1, len(vocabulary.words))


def verified(data: np.ndarray, first: np.ndarray, last: np.ndarray, rank: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Those occurrences whose bytes, not just their hash, are the word's."""
    ok = np.zeros(len(at), bool)
    for r in np.unique(rank[at]):
        word = np.frombuffer(vocabulary.words[r], np.uint8)
        mine = np.flatnonzero(rank[at] == r)
        mine = mine[last[at[mine]] - first[at[mine]] == len(word)]
        ok[mine] = (LOWER[data[first[at[mine]][:, None] + np.arange(len(word))]] == word).all(1)
    return at[ok]


def join(own: np.ndarray, bounds: np.ndarray, count: np.ndarray, line: np.ndarray, rank: np.ndarray, vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, ...]]:
    """For each template and number of lines: (row, first line, template, lines, overlap) of the blocks that match and hold no smaller one."""
    total = np.r_[0, np.cumsum(count)]
    row = np.searchsorted(own, bounds[:-1], "right") - 1
    for t, (other, need) in enumerate(zip(vocabulary.sets, vocabulary.need, strict=True)):
        place = vocabulary.place[t][rank]
        mine = place >= 0
        at, place = line[mine], place[mine]
        rare = np.zeros(len(count), bool)
        rare[at[place <= len(other) - need]] = True  # prefix and position at once: what is rarer isn't there
        if not rare.any():
            continue
        words_of = np.r_[0, np.cumsum(np.bincount(at, minlength=len(count)))]
        rares = np.r_[0, np.cumsum(rare)]
        inside = np.zeros(len(count) + 1, bool)  # blocks of so many lines that hold a match
        for n in range(1, min(LINES, len(count)) + 1):
            first = np.arange(len(count) - n + 1)
            inner = inside[:-1] | inside[1:] if n > 1 else np.zeros(len(first), bool)
            can = ~inner & (words_of[first + n] - words_of[first] >= need) & (rares[first + n] > rares[first]) & (row[first] == row[first + n - 1])
            if n > 1:
                can &= total[first + n] - total[first] <= MOST_WORDS * len(other)
            first = first[can]
            if n == 1:
                overlap = words_of[first + 1] - words_of[first]
            else:
                low, high = np.searchsorted(at, first), np.searchsorted(at, first + n)
                overlap = np.array([len(np.unique(place[x:y])) for x, y in zip(low, high, strict=True)], np.int64)
            good = overlap >= need
            first, overlap = first[good], overlap[good]
            inside = inner
            inside[first] = True
            if len(first):
                yield row[first], first, np.full(len(first), t), np.full(len(first), n), overlap


def counts(docs: DataFrame, templates: dict[str, str], text_col: str = "text") -> dict[bytes, int]:
    """In how many lines of the whole table each template word occurs; partial sums per task, then one small aggregate."""
    prepare(docs.sparkSession)
    vocabulary = Vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            data, offsets = blob(batch.column(0))
            for *_, rank in lines_of(data, offsets, vocabulary) if vocabulary.words else ():
                total += np.bincount(rank, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.words, pa.binary()), pa.array(total)], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, block, lines, start, end, template, overlap, containment) of every block that meets the threshold; start and end
    in characters, block the number, from 0, of its first line in the document, containment = overlap / |T|."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = Vocabulary(templates, counts(docs, templates, text_col), threshold)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["doc_id", "block", "lines", "start", "end", "template", "overlap", "containment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        size = np.array([len(s) for s in vocabulary.sets])
        for batch in batches:
            data, offsets = blob(batch.column(1))
            for a, own, bounds, count, line, rank in lines_of(data, offsets, vocabulary) if vocabulary.words else ():
                found = list(join(own, bounds, count, line, rank, vocabulary))
                if not found:
                    continue
                row, first, template, n, overlap = (np.concatenate(x) for x in zip(*found, strict=True))
                part = data[offsets[a] : offsets[a] + bounds[-1]]
                edge = np.unique(np.concatenate([bounds[first], bounds[first + n], own[row]]))
                char = char_counts(part, edge)
                place = lambda x: char[np.searchsorted(edge, x)]  # noqa: B023, E731
                base = place(own[row])
                arrays = [batch.column(0).take(pa.array(a + row)).cast(pa.int64()), pa.array(first - np.searchsorted(bounds, own[row])), pa.array(n), pa.array(place(bounds[first]) - base), pa.array(place(bounds[first + n]) - base), pa.array([vocabulary.names[t] for t in template], pa.string()), pa.array(overlap), pa.array(overlap / size[template])]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, block long, lines long, start long, end long, template string, overlap long, containment double")


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
    tokens = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    return f"""
WITH t AS (SELECT template, list_distinct({tokens.format("body")}) AS words FROM (VALUES {values}) v(template, body)),
tw AS (SELECT template, unnest(words) AS word, len(words) AS size FROM t),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block FROM documents),
lines AS (SELECT *, sum(length(line) + 1) OVER w - length(line) - 1 AS start, max(block) OVER (PARTITION BY doc_id) AS last, {tokens.format("line")} AS words, sum(len({tokens.format("line")})) OVER w AS total FROM split WINDOW w AS (PARTITION BY doc_id ORDER BY block)),
lw AS (SELECT doc_id, block, unnest(list_distinct(words)) AS word FROM lines),
hit AS (SELECT doc_id, block, template, word, size FROM lw JOIN tw USING (word)),
near AS (SELECT doc_id, template, size FROM hit GROUP BY ALL HAVING count(DISTINCT word) >= ceil({THRESHOLD} * size - 1e-9)),
shift AS (SELECT n, unnest(range(0, n)) AS back FROM (SELECT unnest(range(1, {LINES + 1})) AS n)),
w AS (SELECT doc_id, template, size, block - back AS first, n, count(DISTINCT word) AS overlap FROM hit SEMI JOIN near USING (doc_id, template), shift WHERE block >= back GROUP BY ALL HAVING overlap >= ceil({THRESHOLD} * size - 1e-9)),
m AS (SELECT w.*, f.start, z.start + length(z.line) + CASE WHEN z.block < z.last THEN 1 ELSE 0 END AS "end" FROM w JOIN lines f ON w.doc_id = f.doc_id AND w.first = f.block JOIN lines z ON w.doc_id = z.doc_id AND w.first + n - 1 = z.block
      WHERE n = 1 OR z.total - f.total + len(f.words) <= {MOST_WORDS} * size)
SELECT doc_id, CAST(first AS BIGINT) AS block, CAST(n AS BIGINT) AS lines, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", template, CAST(overlap AS BIGINT) AS overlap, overlap / CAST(size AS DOUBLE) AS containment
FROM m WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.doc_id = m.doc_id AND x.template = m.template AND x.first >= m.first AND x.first + x.n <= m.first + m.n AND x.n < m.n)"""


#: The same over ``documents`` by brute force, for DuckDB.
ORACLE_SQL = _oracle()
