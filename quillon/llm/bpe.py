r"""Byte-pair encoding and decoding of long texts by tree concatenation.

A text of more than ``LEAF`` bytes is halved until its parts are no longer than that; the parts are encoded, those of texts of
``LONG`` bytes or more in parallel, and the encodings are joined upwards.  At a join a window of the last tokens of the left
and the first of the right side is encoded anew; it grows until both sides agree with it exactly.

What makes a join exact.  The vocabulary's pattern cuts a text into pieces before merging, and no piece holds a character
other than white space followed by white space; so between the two the encoding always starts afresh.  In a text, windows
begin and end at such places (ASCII on both sides) or at the text's ends, and must begin and end with the very tokens
that the two sides have there.  A stretch of more than LEAF bytes without such a place is unsplit text:
the pattern cuts it into its pieces, and a piece that is itself longer than LEAF is a tree of its own, of bytes.
There a window is right as soon as its first token is the left side's and its last one the right side's at these
places, since a sequence of tokens is the encoding of its bytes if and only if each two neighbours are the encoding of
theirs.

The vocabulary is a file of ranks (base64 token, space, rank); its path is a parameter, and its bytes, of fixed size, are
broadcast.  No special tokens: their strings are ordinary text.

Defined results: a null text has null tokens and an empty one no tokens; rows with a null id are kept; repeated rows are
encoded alike; a null list of tokens decodes to null, and tokens that aren't UTF-8 together to text with replacement
characters; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import blob, prepare

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The vocabulary, bytes of a leaf, tokens of a join's first window on either side, bytes from which a text's parts are encoded in
#: parallel, and threads for them; shorter texts, of which a task has many, are left to its own core.
VOCABULARY, LEAF, WINDOW, LONG, THREADS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 8192, 8, 1 << 18, 2
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_INK = np.zeros(256, bool)
_INK[33:127] = True


class Codec:
    """One vocabulary."""

    def __init__(self, ranks: bytes, leaf: int = LEAF, window: int = WINDOW) -> None:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.leaf, self.window, self.pattern = leaf, window, regex.compile(PATTERN)
        n = max(table.values(), default=-1) + 1
        token = [b""] * n
        for b, r in table.items():
            token[r] = b
        self.size = np.array([len(t) for t in token], np.int64)
        self.first = np.r_[0, np.cumsum(self.size)]
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.joins = 0

    # plain encoding of short parts
    def plain(self, text: bytes) -> np.ndarray:
        return self.bpe.encode_to_numpy(text.decode(), disallowed_special=()).astype(np.int32)

    def piece(self, data: bytes) -> np.ndarray:
        return np.array(self.bpe._core_bpe.encode_single_piece(data), np.int32)

    # decoding
    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of the tokens."""
        size = self.size[tokens]
        total = int(size.sum())
        begin = np.cumsum(size) - size
        return self.bytes[np.repeat(self.first[tokens] - begin, size) + np.arange(total)]

    # trees
    def leaves(self, a: int, b: int, even: Callable[[int], int]) -> list[tuple[int, int]]:
        """[a, b) halved until no part exceeds a leaf; even moves a cut to where one may be."""
        if b - a <= self.leaf:
            return [(a, b)]
        m = even((a + b) // 2)
        return [(a, b)] if m <= a or m >= b else self.leaves(a, m, even) + self.leaves(m, b, even)

    def tree(self, parts: list[tuple[int, int]], done: list[np.ndarray], join: Callable) -> np.ndarray:
        """Join neighbours, level by level, up to one sequence."""
        level = [(a, b, t) for (a, b), t in zip(parts, done, strict=True)]
        while len(level) > 1:
            level = [(level[i][0], level[i + 1][1], join(level[i], level[i + 1])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0][2]

    def join_text(self, data: bytes) -> Callable:
        """Join of two encoded parts of a text, at places where encoding starts afresh."""

        def join(left: tuple, right: tuple) -> np.ndarray:
            (a, m, x), (_, b, y) = left, right
            self.joins += 1
            k = self.window
            while True:
                s, i = self.place(data, x[::-1][:k], m, -1, a, len(x))
                e, j = self.place(data, y[:k], m, 1, b, len(y))
                if s is not None and e is not None:
                    w = self.plain(data[s:e])
                    agree_left = s == a or (i > 0 and w[0] == x[len(x) - i])
                    agree_right = e == b or (j > 0 and w[-1] == y[j - 1])
                    if agree_left and agree_right:
                        return np.concatenate([x[: len(x) - i], w, y[j:]])
                k *= 2

        return join

    def place(self, data: bytes, tokens: np.ndarray, m: int, way: int, end: int, total: int) -> tuple[int | None, int]:
        """The furthest fresh start within the given tokens away from m, and how many tokens that takes; the part's own end if all are given."""
        at = m + way * np.cumsum(self.size[tokens])
        raw = np.frombuffer(data, np.uint8)
        inner = at[at != end] if len(tokens) >= total else at
        good = np.flatnonzero((inner > 0) & (inner < len(data)))
        good = good[_INK[raw[inner[good] - 1]] & _SPACE[raw[inner[good]]]]
        if len(good):
            return int(inner[good[-1]]), int(good[-1]) + 1
        return (end, total) if len(tokens) >= total else (None, 0)

    def join_bytes(self, left: tuple, right: tuple) -> np.ndarray:
        """Join of two encoded parts of one piece."""
        (a, m, x), (_, b, y) = left, right
        self.joins += 1
        k = self.window
        while True:
            i, j = min(k, len(x)), min(k, len(y))
            w = self.piece(self.decode(np.r_[x[len(x) - i :], y[:j]]).tobytes())
            if (i == len(x) or w[0] == x[len(x) - i]) and (j == len(y) or w[-1] == y[j - 1]):
                return np.concatenate([x[: len(x) - i], w, y[j:]])
            k *= 2

    def encode_piece(self, data: bytes, each: Callable) -> np.ndarray:
        """A piece of the pattern's, a tree of bytes if it is long."""
        if len(data) <= self.leaf:
            return self.piece(data)
        parts = self.leaves(0, len(data), lambda m: m)
        return self.tree(parts, list(each(self.piece, [data[a:b] for a, b in parts])), self.join_bytes)

    def plan(self, text: bytes) -> list[tuple[str, int, int]]:
        """Segments of a text: ("text", a, b), within which a fresh start is never more than a leaf away, and unsplit ("run", a, b)."""
        if len(text) <= self.leaf:
            return [("text", 0, len(text))]
        raw = np.frombuffer(text, np.uint8)
        fresh = np.r_[0, np.flatnonzero(_INK[raw[:-1]] & _SPACE[raw[1:]]) + 1, len(text)]
        out, at = [], 0
        for k in np.flatnonzero(np.diff(fresh) > self.leaf):
            a, b = int(fresh[k]), int(fresh[k + 1])
            if a > at:
                out.append(("text", at, a))
            out.append(("run", a, b))
            at = b
        if at < len(text):
            out.append(("text", at, len(text)))
        return out

    def encode(self, texts: list[bytes], threads: int = THREADS) -> list[np.ndarray]:
        """Tokens of each text; the parts of long ones are encoded in parallel."""
        if threads > 1 and any(len(t) >= LONG for t in texts):
            with ThreadPoolExecutor(threads) as pool:
                return [self.encode_text(t, pool.map if len(t) >= LONG else map) for t in texts]
        return [self.encode_text(t, map) for t in texts]

    def encode_text(self, text: bytes, each: Callable) -> np.ndarray:
        """Tokens of one text; each applies a function to all leaves, in order."""

        def even(m: int) -> int:
            while m < len(text) and text[m] & 0xC0 == 0x80:  # between characters
                m += 1
            return m

        found = []
        for kind, a, b in self.plan(text):
            if kind == "run":
                found += [self.encode_piece(p.group().encode(), each) for p in self.pattern.finditer(text[a:b].decode())]
            else:
                parts = self.leaves(a, b, even)
                found.append(self.tree(parts, list(each(lambda p: self.plain(text[p[0] : p[1]]), parts)), self.join_text(text)))
        return found[0] if len(found) == 1 else np.concatenate(found)


_codecs: dict[tuple, Codec] = {}


def codec(ranks: bytes, leaf: int = LEAF, window: int = WINDOW) -> Codec:
    """The codec of a vocabulary, made once in a process."""
    key = (hashlib.blake2b(ranks).digest(), leaf, window)
    if key not in _codecs:
        _codecs[key] = Codec(ranks, leaf, window)
    return _codecs[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF, window: int = WINDOW, threads: int = THREADS) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of every row; round_trip says that the tokens, decoded, are the text.
    One narrow pass, no shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value, leaf, window)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                data, offsets = blob(whole.column(1).slice(at))
                rows = max(1, int(np.searchsorted(offsets, 2 << 20, "right")) - 1)
                batch = whole.slice(at, rows)
                at += rows
                offsets = offsets[: batch.num_rows + 1]
                data = data[: offsets[-1]]
                raw = data.tobytes()
                tokens = own.encode([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], threads)
                n = np.array([len(t) for t in tokens], np.int64)
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
                # decode all at once; a row is right if its bytes are, at its place
                end = np.r_[0, np.cumsum(own.size[flat])][np.r_[0, np.cumsum(n)]]
                same = np.diff(end) == np.diff(offsets)
                if (end == offsets).all():
                    wrong = np.flatnonzero(own.decode(flat) != data)
                    same[np.searchsorted(offsets, wrong, "right") - 1] = False
                else:
                    same &= [own.decode(t).tobytes() == raw[a:b] for t, a, b in zip(tokens, offsets[:-1], offsets[1:], strict=True)]
                null = pa.compute.is_null(batch.column(1)).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat), mask=pa.array(null) if null.any() else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, mask=null), lists, pa.array(same, mask=null)], ["doc_id", "n_tokens", "tokens", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>, round_trip boolean")


def decode(rows: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from lists of tokens; null tokens within a list are passed over."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value)
        for batch in batches:
            texts = [None if t is None else own.decode(np.array([x for x in t if x is not None], np.int64)).tobytes().decode(errors="replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col).alias("tokens")).mapInArrow(run, "doc_id long, text string")
