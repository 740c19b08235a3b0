"""Secret scans by a battery of randomness tests.

A candidate is a longest run of at least ``EDGES[0]`` characters of ``A-Z a-z 0-9 + / _ -`` with the one or two ``=`` that may
follow.  So is each part of a run that is as long and stands between separators, for each set of separators in
``SPLITS`` (a key after a path, a prefix or another key), and so are the digits of groups of hexadecimal joined by
``-`` (UUIDs).  Its encoding is the first of these whose alphabet holds it: hexadecimal (one case; letters and digits),
base32, upper or lower case with digits, letters of one case, letters, letters with digits, base64, base64url.
Runs of digits alone are numbers and not looked at.

Three tests ask whether it could be uniformly random over that alphabet: chi-squared uniformity of the symbols,
runs above and below the alphabet's middle, and serial correlation of neighbours.  Their least p-value,
times three, is the battery's; below ``ALPHA`` the candidate isn't random.

How often ordinary text of like length passes for random is counted, not assumed: the short words of every document,
joined with and without separators, are cut into windows of each length in ``EDGES`` in turn, and go through the
same battery, and so do the parts of the windows; words that are groups of a hexadecimal candidate aren't ordinary.
``REFERENCE`` windows per length of letters at common frequencies join them, for small tables.  A
candidate's p-value is the share of ordinary windows of its length class that have its encoding and look as
random as it does.  Within each length class Benjamini and Hochberg's step-up bounds the expected share of
false discoveries by ``Q``.  Runs and parts are judged apart, each against the like of ordinary windows.  Of discoveries of one run those inside another aren't listed; of equal
places the least p-value is.  Battery p-values are binned, so what goes to the driver is a few thousand counts, however
large the table; all documents, whole, enter the counts.

Defined results: null or empty texts have no candidates; rows with a null id are scanned and listed under a null
doc_id; repeated rows are listed each; equal p-values are accepted or not together; an empty table gives an empty
result; other columns are ignored, whatever their names.  Texts are taken in pieces of ``LONG`` bytes, cut where no candidate is;
a run longer than that is tested whole, and so are its parts within each ``LONG`` of its characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import blob, char_counts, cut, prepare, stretches

#: Lower edges of the length classes; least battery p-value of a secret; false-discovery rate; reference windows of each length.
EDGES = np.array([16, 20, 24, 32, 40, 48, 64, 96, 128, 256])
ALPHA, Q, REFERENCE = 1e-4, 0.01, 20_000
BINS, MASK = 100, b"[SECRET]"
#: Symbols that are tested at once, and bytes of a long text that are taken at once.
LONG = 1 << 20
#: Sets of characters that may separate a secret from what it is joined to; the first has all.
SPLITS = [b"+/_-", b"_-", b"+/", b"-", b"_", b"/"]
NAMES = ["hex", "base32", "upper36", "lower36", "upper", "lower", "letters", "base62", "base64", "base64url", "digits"]
_UP, _LOW, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_ALPHABETS = [_DIGIT + b"abcdef", _UP + b"234567", _DIGIT + _UP, _DIGIT + _LOW, _UP, _LOW, _UP + _LOW, _UP + _LOW + _DIGIT, _UP + _LOW + _DIGIT + b"+/", _UP + _LOW + _DIGIT + b"-_", _DIGIT]
SIZES = np.array([len(a) for a in _ALPHABETS])
CELLS = len(EDGES) * len(NAMES) * BINS
VALUES = np.zeros((len(NAMES), 256), np.int64)
for _k, _a in enumerate(_ALPHABETS):
    for _i, _c in enumerate(_a):
        VALUES[_k, _c] = _i
VALUES[0, 65:71] = np.arange(10, 16)
RUN = np.zeros(256, bool)
RUN[list(_UP + _LOW + _DIGIT + b"+/_-")] = True
#: Where a text may be cut: behind what is no part of a candidate.
BREAK = ~RUN
BREAK[61] = False
ALNUM = np.zeros(256, bool)
ALNUM[list(_UP + _LOW + _DIGIT)] = True


def has(data: np.ndarray, first: np.ndarray, members: bytes) -> np.ndarray:
    """Which tokens hold one of the characters; first: each token's place in the concatenated data."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return np.logical_or.reduceat(table[data], first)


def encodings(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of each token's inferred encoding."""
    up, low, digit = (has(data, first, x) for x in (_UP, _LOW, _DIGIT))
    plus, dash = has(data, first, b"+/"), has(data, first, b"-_")
    beyond_low, beyond_up = has(data, first, _LOW[6:]), has(data, first, _UP[6:])
    alnum = ~plus & ~dash
    hexa = alnum & digit & ((low & ~up & ~beyond_low) | (up & ~low & ~beyond_up))
    base32 = alnum & up & digit & ~low & ~has(data, first, b"0189")
    rules = [hexa, base32, alnum & up & digit & ~low, alnum & low & digit & ~up, alnum & up & ~low & ~digit, alnum & low & ~up & ~digit, alnum & up & low & ~digit, alnum & (up | low), plus & ~dash, dash & ~plus, ~(up | low)]
    out = np.full(len(first), 8)
    for k in range(len(rules) - 1, -1, -1):
        out[rules[k]] = k
    return out


def normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z), to 1e-7 absolutely and in proportion beyond, by Abramowitz and Stegun's 26.2.17."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    tail = np.exp(-a * a / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, tail, 1 - tail)


def battery(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(encoding, p-values (n, 3)) of tokens that stand one after another in data; those of more than LONG symbols one by one, the
    others in lots of about as many."""
    if len(data) <= LONG:
        return battery_of_lot(data, first)
    bounds = np.r_[first, len(data)]
    kind, p = np.zeros(len(first), np.int64), np.zeros((len(first), 3))
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + LONG, "right")) - 1)
        part = data[bounds[a] : bounds[b]]
        kind[a:b], p[a:b] = battery_of_one(part) if len(part) > LONG else battery_of_lot(part, first[a:b] - bounds[a])
        a = b
    return kind, p


def battery_of_lot(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tests from sums over whole arrays."""
    kind = encodings(data, first)
    n = np.diff(np.r_[first, len(data)])
    token = np.repeat(np.arange(len(first)), n)
    value = VALUES[kind[token], data]
    size = SIZES[kind]
    counts = np.bincount(token * 64 + value, minlength=len(first) * 64).reshape(-1, 64)
    high = value * 2 >= size[token]
    turn = np.r_[False, (high[1:] != high[:-1]) & (token[1:] == token[:-1])]
    centred = value - (np.add.reduceat(value, first) / n)[token]
    product = np.r_[centred[:-1] * centred[1:], 0]
    product[np.r_[first[1:], len(data)] - 1] = 0
    return kind, p_values(n, size, counts, np.add.reduceat(turn, first, dtype=np.int64), np.add.reduceat(high, first, dtype=np.int64), np.add.reduceat(product, first), np.add.reduceat(centred * centred, first))


def battery_of_one(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of one long token, block by block, so that memory doesn't grow with it."""
    seen = np.zeros(256, np.int64)
    for a in range(0, len(data), LONG):
        seen += np.bincount(data[a : a + LONG], minlength=256)
    there = np.flatnonzero(seen).astype(np.uint8)
    kind = encodings(there, np.array([0]))
    size, n = SIZES[kind], len(data)
    counts = np.zeros((1, 64), np.int64)
    np.add.at(counts[0], VALUES[kind[0], there], seen[there])
    mean = float((counts[0] * np.arange(64)).sum() / n)
    turns = above = 0
    product = square = 0.0
    for a in range(0, n, LONG):
        value = VALUES[kind[0], data[a : a + LONG + 1]]  # one symbol of the next block, for its neighbour
        own = value[: LONG]
        high = value * 2 >= size[0]
        turns += int((high[1:] != high[:-1]).sum())
        above += int(high[: len(own)].sum())
        centred = value - mean
        product += float((centred[:-1] * centred[1:]).sum())
        square += float((centred[: len(own)] ** 2).sum())
    return kind, p_values(np.array([n]), size, counts, np.array([turns]), np.array([above]), np.array([product]), np.array([square]))


def p_values(n: np.ndarray, size: np.ndarray, counts: np.ndarray, turns: np.ndarray, above: np.ndarray, product: np.ndarray, square: np.ndarray) -> np.ndarray:
    """(tokens, 3): of tokens with so many symbols, of alphabets of such sizes, from what is counted of them."""
    # chi-squared, by a gamma of the same mean and variance and Wilson and Hilferty's cube root
    chi = (counts * counts).sum(1) * size / n - n
    shape = (size - 1) / (2 * (n - 1) / n)
    p_chi = normal_tail((np.cbrt(chi / (size - 1)) - (1 - 1 / (9 * shape))) * 3 * np.sqrt(shape))
    # runs above and below the middle
    mean = 2 * above * (n - above) / n
    spread = np.sqrt(np.maximum(mean * (mean - 1) / (n - 1), 0))
    p_runs = np.where(spread > 0, 2 * normal_tail(np.abs(turns - mean) / np.where(spread > 0, spread, 1)), 0)
    # serial correlation of neighbours
    r = np.where(square > 0, product / np.where(square > 0, square, 1), 1)
    p_serial = np.where(square > 0, 2 * normal_tail(np.abs(r + 1 / n) * np.sqrt(n)), 0)
    return np.clip(np.stack([p_chi, p_runs, p_serial], 1), 0, 1)


def cells(kind: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
    """One number for length class, encoding and binned battery p-value; bin 0 looks most random."""
    low = np.minimum(1, 3 * p.min(1))
    level = np.minimum(BINS - 1, (-np.log10(np.maximum(low, 1e-13)) * 8).astype(np.int64))
    return ((np.searchsorted(EDGES, length, "right") - 1) * len(NAMES) + kind) * BINS + level


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that cross no row."""
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    cuts = offsets[:-1]
    before[cuts[cuts < len(inside)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after another, and where each begins."""
    size = ends - starts
    first = np.r_[0, np.cumsum(size)[:-1]]
    if len(size) and size.sum() > 256 * len(size):  # few long ones
        return (data[starts[0] : ends[0]] if len(size) == 1 else np.concatenate([data[s:e] for s, e in zip(starts, ends, strict=True)])), first
    return data[np.repeat(starts - first, size) + np.arange(size.sum())], first


def chains(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of longest rows of two groups or more, of hexadecimal digits in one case, joined by single dashes;
    the groups are whole, and have ``EDGES[0]`` digits or more between them."""
    starts, ends = runs_of(ALNUM[flat], bounds)
    if not len(starts):
        return starts, ends
    joined = np.r_[False, (starts[1:] == ends[:-1] + 1) & (flat[ends[:-1]] == 45)]
    joined[np.searchsorted(starts, bounds[:-1][bounds[:-1] <= starts[-1]])] = False  # rows are apart
    digits = np.r_[0, np.cumsum(ends - starts)]
    out = []
    for beyond in (_UP + _LOW[6:], _LOW + _UP[6:]):
        other = np.zeros(256, bool)
        other[list(beyond)] = True
        edge = np.stack([starts, ends], 1).ravel()
        hexa = ~np.logical_or.reduceat(other[flat], edge[:-1] if edge[-1] == len(flat) else edge)[::2]
        first = np.flatnonzero(hexa & ~(joined & np.r_[False, hexa[:-1]]))
        last = np.flatnonzero(hexa & ~np.r_[joined[1:] & hexa[1:], False])
        use = (last > first) & (digits[last + 1] - digits[first] >= EDGES[0])
        out.append(np.stack([starts[first[use]], ends[last[use]]]))
    starts, ends = np.unique(np.concatenate(out, axis=1), axis=1)
    return starts, ends


def parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number of the run, start, end, symbols, where each one's symbols begin) of the parts of runs."""
    number = np.arange(len(starts))
    if len(starts):
        token, first = gather(data, starts, ends)
        number = np.flatnonzero(has(token, first, SPLITS[0]))
    if not len(number):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint8), np.zeros(0, np.int64))
    flat, first = gather(data, starts[number], ends[number])
    bounds = np.r_[first, len(flat)]
    size = np.diff(bounds)
    found = []
    for members in SPLITS:
        apart = np.ones(256, bool)
        apart[list(members)] = False
        s, e = runs_of(apart[flat], bounds)
        long = (e - s >= EDGES[0]) & (e - s < size[np.searchsorted(bounds, s, "right") - 1])
        found.append(np.stack([s[long], e[long]]))
    s, e = np.unique(np.concatenate(found, axis=1), axis=1)
    cs, ce = chains(flat, bounds)
    symbols, begin = gather(flat, s, e) if len(s) else (np.zeros(0, np.uint8), s)
    if len(cs):
        more, begins = gather(flat, cs, ce)
        digit = more != 45
        begins = np.r_[0, np.cumsum(digit)][begins]
        symbols, begin = np.r_[symbols, more[digit]], np.r_[begin, len(symbols) + begins]
    s, e = np.r_[s, cs], np.r_[e, ce]
    of = np.searchsorted(bounds, s, "right") - 1
    move = starts[number[of]] - first[of]
    return number[of], s + move, e + move, symbols, begin


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, encoding, p-values, cell) of the longest runs of a chunk."""
    return tested(data, offsets, False)[:-1]


def tested(data: np.ndarray, offsets: np.ndarray, divided: bool = True) -> tuple[np.ndarray, ...]:
    """(row, start, end, encoding, p-values, cell, number of the run) of the candidates of a chunk; cells of parts are
    those from ``CELLS`` on."""
    starts, ends = runs_of(RUN[data], offsets)
    long = ends - starts >= EDGES[0]
    starts, ends = starts[long], ends[long]
    empty = np.zeros(0, np.int64)
    found = [(empty, empty, empty, np.zeros((0, 3)), empty, empty)]  # start, end, encoding, p-values, cell, number
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + LONG, "right")))
        own_starts, own_ends, number = starts[a:b], ends[a:b], np.arange(a, b)
        kind, p = battery(*gather(data, own_starts, own_ends))
        found.append((own_starts, own_ends, kind, p, cells(kind, p, own_ends - own_starts), number))
        if divided:
            # the parts of a very long run are those within each LONG of its characters in turn
            for low in range(int(own_starts[0]), int(own_ends[0]), LONG) if ends[a] - starts[a] > LONG else (None,):
                pieces = (own_starts, own_ends) if low is None else (np.array([low]), np.array([min(low + LONG, int(own_ends[0]))]))
                of, s, e, symbols, begin = parts(data, *pieces)
                if len(s):
                    kind, p = battery(symbols, begin)
                    found.append((s, e, kind, p, cells(kind, p, np.diff(np.r_[begin, len(symbols)])) + CELLS, number[of]))
        a = b
    starts, ends, kind, p, cell, number = (np.concatenate(x) for x in zip(*found, strict=True))
    use = NAMES.index("digits") != kind
    row = np.searchsorted(offsets, starts, "right") - 1
    limit = offsets[1:][row]
    for _ in range(2):
        more = (ends < limit) & (data[np.minimum(ends, len(data) - 1)] == 61) & ((kind == 7) | (kind == 8) | (kind == 9))
        ends = ends + more
    return row[use], starts[use], ends[use], kind[use], p[use], cell[use], number[use]


def ordinary(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cells of the ordinary windows of a chunk: each row's short words, cut into windows of all lengths in turn, and the windows' parts."""
    starts, ends = runs_of(ALNUM[data], offsets)
    short = ends - starts < EDGES[0]
    group, over = chains(data, offsets)
    if len(group):  # groups of hexadecimal are candidates
        before = np.searchsorted(group, starts, "right") - 1
        short &= (before < 0) | (starts >= np.maximum.accumulate(over)[np.maximum(before, 0)])
    starts, ends = starts[short], ends[short]
    if not len(starts):
        return np.zeros(0, np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    nth = np.arange(len(starts)) - np.searchsorted(row, row)
    # groups of eight words are joined by nothing, nothing, a dash, and underscore, slash and dash, in turn
    way = nth // 8 % 4
    size = ends - starts + (way >= 2)
    first = np.r_[0, np.cumsum(size)[:-1]]
    word = np.repeat(np.arange(len(starts)), size)
    at = np.arange(size.sum()) - first[word]
    joint = at == (ends - starts)[word]
    stream = np.where(joint, np.where(way[word] == 2, 45, np.array([95, 47, 45])[nth[word] % 3]), data[np.minimum(starts[word] + at, len(data) - 1)]).astype(np.uint8)
    begin = first[np.searchsorted(row, row[word])]
    t = np.arange(len(stream)) - begin
    edge = np.r_[0, np.cumsum(EDGES)]
    turn = t % edge[-1]
    opens = np.flatnonzero(np.isin(turn, edge[:-1]) | (t == 0))
    length = np.diff(np.r_[opens, len(stream)])
    whole = length == EDGES[np.searchsorted(edge, turn[opens], "right") - 1]
    opens, length = opens[whole], length[whole]
    if not len(opens):
        return np.zeros(0, np.int64)
    token, first = gather(stream, opens, opens + length)
    _, _, _, symbols, begin = parts(stream, opens, opens + length)
    token, first = np.r_[token, symbols], np.r_[first, len(token) + begin]
    cell = cells(*battery(token, first), np.diff(np.r_[first, len(token)]))
    cell[len(opens) :] += CELLS
    return cell


def reference(n: int = REFERENCE) -> np.ndarray:
    """Counts of the cells of windows drawn from common letter frequencies, one in ten words capitalised."""
    rng = np.random.default_rng(11)
    weight = np.array([8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1])
    out = np.zeros(len(EDGES) * len(NAMES) * BINS, np.int64)
    for length in EDGES:
        data = (rng.choice(26, size=n * length, p=weight / weight.sum()) + 97).astype(np.uint8)
        data[rng.random(len(data)) < 0.02] -= 32
        first = np.arange(0, n * length, length)
        out += np.bincount(cells(*battery(data, first), np.full(n, length)), minlength=len(out))
    return out


def accepted_cells(null: np.ndarray, seen: np.ndarray, q: float = Q, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Cells that are discoveries, and every cell's p-value, from the counts of ordinary windows and of candidates."""
    null, seen = (x.reshape(len(EDGES), len(NAMES), BINS) for x in (null, seen))
    p = (1 + np.cumsum(null, axis=2)) / (1 + null.sum((1, 2)))[:, None, None]
    keep = np.zeros(p.shape, bool)
    random = np.arange(BINS) < -np.log10(alpha) * 8
    for k in range(len(EDGES)):
        order = np.argsort(p[k], axis=None, kind="stable")
        value, number = p[k].ravel()[order], np.cumsum(seen[k].ravel()[order])
        if not number[-1]:
            continue
        number = number[np.searchsorted(value, value, "right") - 1]  # ties together
        good = np.flatnonzero(value <= q * number / number[-1])
        if len(good):
            keep[k] = (p[k] <= value[good[-1]]) & random
    return np.flatnonzero(keep.ravel()), p.ravel()


FOUND = "doc_id long, start long, end long, kind int, p_chi double, p_runs double, p_serial double, cell int, run long"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates (count null) and counts of ordinary windows (count set), from one narrow pass over the texts."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        null = np.zeros(2 * CELLS, np.int64)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
        runs = (TaskContext.get().partitionId() << 40) + 1  # numbers of runs; no two tasks share one
        names = [x.split()[0] for x in FOUND.split(", ")] + ["count"]
        for batch in batches:
            data, offsets = blob(batch.column(1))
            chars = 0  # of a long text, before the piece
            for a, b, low, high in stretches(offsets, data, BREAK, LONG):
                part, own = data[low:high], np.clip(offsets[a : b + 1], low, high) - low
                if not len(part):
                    continue
                if low == offsets[a]:
                    chars = 0
                for x, y, start, end in stretches(own, part, ~ALNUM, LONG):
                    null += np.bincount(ordinary(part[start:end], np.clip(own[x : y + 1], start, end) - start), minlength=len(null))
                row, start, end, kind, p, cell, number = tested(part, own)
                if len(row):
                    number += runs
                    runs = int(number.max()) + 1
                    edge = np.unique(np.concatenate([start, end, own[row]]))
                    char = char_counts(part, edge)
                    place = lambda x: char[np.searchsorted(edge, x)]  # noqa: B023, E731
                    base = place(own[row]) - chars
                    ids = batch.column(0).take(pa.array(a + row))
                    yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(x).cast(t) for x, t in zip((place(start) - base, place(end) - base, kind, p[:, 0], p[:, 1], p[:, 2], cell, number), types[1:9], strict=True)), pa.nulls(len(row), pa.int64())], names)
                if high < offsets[b]:
                    chars += int(char_counts(part, np.array([len(part)]))[0])
        at = np.flatnonzero(null)
        nothing = [pa.nulls(len(at), t) for t in types[:7]]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(at).cast(pa.int32()), pa.nulls(len(at), pa.int64()), pa.array(null[at])], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"{FOUND}, count long")


def judge(found: DataFrame, q: float = Q, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Accepted cells and all cells' p-values.  At most one count per cell and side comes to the driver."""
    null, seen = np.tile(reference(), 2), np.zeros(2 * CELLS, np.int64)
    for r in found.groupBy("cell").agg(F.sum("count").alias("null"), F.count_if(F.col("count").isNull()).alias("seen")).collect():
        null[r.cell] += r.null or 0
        seen[r.cell] += r.seen
    whole, part = (accepted_cells(null[x], seen[x], q, alpha) for x in (slice(CELLS), slice(CELLS, None)))
    return np.r_[whole[0], part[0] + CELLS], np.r_[whole[1], part[1]]


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, start, end, encoding, p_chi, p_runs, p_serial, p_value) of every discovery; places in characters.

    The candidates, narrow and few, are kept in the shared folder while the counts are judged."""
    found = cut(scan(docs, id_col, text_col))
    good, p = judge(found, q, alpha)
    rows = [(int(c), NAMES[c // BINS % len(NAMES)], float(p[c])) for c in good]  # at most one per cell, whatever the input
    table = docs.sparkSession.createDataFrame(rows, "cell int, encoding string, p_value double")
    hits = found.where(F.col("count").isNull()).join(F.broadcast(table), "cell")
    before = Window.partitionBy("run").orderBy("start", F.desc("end"), "p_value", "cell").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("reach", F.max("end").over(before)).where("reach is null or end > reach")
    return hits.select("doc_id", "start", "end", "encoding", *(F.round(c, 6).alias(c) for c in ("p_chi", "p_runs", "p_serial")), "p_value")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places, in order, those that overlap as one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] >= reach[:-1]])
    return start[first], reach[np.r_[first[1:], len(start)] - 1]


def redact(docs: DataFrame, text_col: str = "text", q: float = Q, alpha: float = ALPHA, mask: bytes = MASK) -> DataFrame:
    """The documents with every discovery replaced by the mask; all else as it was.  The counts take one pass over the
    texts, the replacing another; nothing but counts is shuffled."""
    spark = docs.sparkSession
    prepare(spark)
    good, _ = judge(scan(docs.withColumn("__none", F.lit(None).cast("long")), "__none", text_col), q, alpha)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = blob(batch.column(at))
            spans: dict[int, list[tuple[int, int]]] = {}
            for a, b, low, high in stretches(offsets, data, BREAK, LONG):
                part, own = data[low:high], np.clip(offsets[a : b + 1], low, high) - low
                if not len(part):
                    continue
                row, start, end, _, _, cell, _ = tested(part, own)
                hit = np.isin(cell, good)
                start, end = merged(start[hit], end[hit])
                row = np.searchsorted(own, start, "right") - 1
                for r, s, e in zip(row.tolist(), (start + low).tolist(), (end + low).tolist(), strict=True):
                    spans.setdefault(a + r, []).append((s, e))
            changed: dict[int, bytes] = {}
            for r, found in spans.items():
                out, last = [], int(offsets[r])
                for s, e in found:
                    out += [data[last:s].tobytes(), mask]
                    last = e
                changed[r] = b"".join([*out, data[last : offsets[r + 1]].tobytes()])
            if changed:
                rows = sorted(changed)
                mark = np.zeros(batch.num_rows, bool)
                mark[rows] = True
                column = batch.column(at)
                fresh = pa.compute.replace_with_mask(column, pa.array(mark), pa.array([changed[r].decode() for r in rows], column.type))
                batch = batch.set_column(at, batch.schema.field(at), fresh)
            yield batch

    return docs.mapInArrow(run, docs.schema)
