"""Quality classifier: a byte-level convolutional network in numpy.

The bytes of a text pass through FILTERS filters of WIDTH bytes.  Chunks of two blocks, each overlapping the next
by one block of BLOCK positions, cover the whole text; each filter is max-pooled over every chunk.  The greatest
and the mean chunk value of each filter feed a small dense layer and one logistic unit: the probability that
the text is worth keeping.  Filters are tables over bytes (a convolution of one-hot bytes); they begin at short
byte strings that tell rejected from accepted training texts apart, and all weights are learned by Adam.

Training takes a bounded sample of labelled rows (``SAMPLE`` of each class, ids that hash least, ``SPAN`` characters of each at most).  A label is
"reject" when quality is 0 or toxic is 1.  Short pieces of accepted training texts join them as accepted ones, so
that brevity alone is no fault.

Defined results: a null or empty text has probability 0 and is rejected; rows with a null id are kept in the
scores; repeated rows score alike; without labels of both classes there is nothing to learn from and every text that
isn't empty is accepted with probability 1; of several labels of one id any "reject" counts; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import U64, blob, chunks, mix, prepare

WIDTH, FILTERS, BLOCK, HIDDEN = 6, 48, 512, 16
#: Labelled rows of each class (the bound of the training sample), passes over them, steps at least (a small sample gets more
#: passes), and the least probability of an accepted text.
SAMPLE, EPOCHS, STEPS, THRESHOLD, SEED = 1500, 18, 500, 0.75, 7
#: Characters of a training text; of a longer one a span of that length is learned from, at a place that hangs on its id.  Scores
#: are always of whole texts.
SPAN = 1 << 17
#: Threads of the driver that training takes.
THREADS = 4
#: Bytes that are convolved at once: blocks that fit a processor's cache.
LOT = 64 * BLOCK


def blocks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all blocks, and the row of each; every row that isn't empty has one at least."""
    size = np.diff(offsets)
    n = (size + BLOCK - 1) // BLOCK
    row = np.repeat(np.arange(len(size)), n)
    first = np.r_[0, np.cumsum(n)[:-1]] if len(n) else n
    return offsets[:-1][row] + (np.arange(len(row)) - first[row]) * BLOCK, row


class Network:
    """The weights and the forward pass."""

    def __init__(self, filters: np.ndarray, rng: np.random.Generator) -> None:
        n = filters.shape[2]
        self.p = {"filters": filters.astype(np.float32), "bias": np.zeros(n, np.float32), "hidden": (rng.normal(size=(2 * n, HIDDEN)) / np.sqrt(2 * n)).astype(np.float32), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": (rng.normal(size=HIDDEN) / 4).astype(np.float32), "out_bias": np.zeros(1, np.float32)}

    def freeze(self) -> Network:
        """Pairs of adjacent filter columns become tables over two bytes, which halves the gathers."""
        w = self.p["filters"]
        self.pairs = [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)]
        return self

    def convolve(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at every position; beyond the end stand zero bytes."""
        padded = np.r_[data, np.zeros(WIDTH, np.uint8)].astype(np.int32)
        two = padded[:-1] << 8 | padded[1:]
        out = self.pairs[0].take(two[: len(data)], 0)
        for j in range(1, WIDTH // 2):
            out += self.pairs[j].take(two[2 * j : 2 * j + len(data)], 0)
        return out

    def head(self, x: np.ndarray) -> np.ndarray:
        # sums in an order that doesn't depend on how many rows there are, so that equal texts score alike
        h = np.maximum((x[:, :, None] * self.p["hidden"]).sum(1) + self.p["hidden_bias"], 0)
        return 1 / (1 + np.exp(-np.clip((h * self.p["out"]).sum(1, dtype=np.float64) + self.p["out_bias"], -30, 30)))

    def features(self, top: np.ndarray, row: np.ndarray) -> np.ndarray:
        """From the blocks' maxima, rows ascending: per row the greatest and the mean over its chunks of two blocks."""
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        last = np.r_[first[1:], len(row)] - 1
        chunk = top.copy()
        chunk[:-1] = np.maximum(top[:-1], top[1:])
        chunk[last] = top[last]  # a row's last block alone; where it isn't the only one, its chunk is the one before
        alone = first == last
        count = np.where(alone, 1, last - first)
        chunk = np.maximum(chunk + self.p["bias"], 0)
        total = np.add.reduceat(chunk, first, axis=0) - np.where(alone[:, None], 0, chunk[last])
        return np.concatenate([np.maximum(np.maximum.reduceat(top, first, axis=0) + self.p["bias"], 0), total / count[:, None]], axis=1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each row; empty rows have 0.  A row of more than LOT bytes is convolved in pieces of whole blocks, each
        with the bytes that its last windows reach into the next; what is held of it is a row of maxima a block."""
        out = np.zeros(len(offsets) - 1)
        for a, b in chunks(offsets, LOT):
            low, high = int(offsets[a]), int(offsets[b])
            if high - low > LOT:
                tops = []
                for x in range(low, high, LOT):
                    y = min(x + LOT, high)
                    reach = min(WIDTH - 1, high - y)
                    made = self.convolve(data[x : y + reach])[: y - x]
                    tops.append(np.maximum.reduceat(made, np.arange(0, y - x, BLOCK), axis=0))
                top = np.concatenate(tops)
                out[a] = self.head(self.features(top, np.zeros(len(top), np.int64)))[0]
                continue
            own = offsets[a : b + 1] - low
            starts, row = blocks(own)
            if not len(row):
                continue
            # windows over a row's end see zero bytes, not the next row
            out[a + np.unique(row)] = self.head(self.features(np.maximum.reduceat(self.ended(data[low:high], own), starts, axis=0), row))
        return out

    def ended(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Responses with each row followed by zero bytes."""
        out = self.convolve(data)
        ends = np.unique(offsets[1:])
        ends = ends[(ends > 0) & (ends < len(data))]
        if len(ends):
            near = np.unique((ends[:, None] - np.arange(1, WIDTH)).ravel())
            near = near[near >= 0]
            room = offsets[np.searchsorted(offsets, near, "right")] - near
            byte = [np.where(j < room, data[np.minimum(near + j, len(data) - 1)], 0).astype(np.int32) for j in range(WIDTH)]
            out[near] = self.pairs[0][byte[0] << 8 | byte[1]]
            for j in range(2, WIDTH, 2):  # in the same order as elsewhere, so that equal texts score alike
                out[near] += self.pairs[j // 2][byte[j] << 8 | byte[j + 1]]
        return out


def seeds(data: np.ndarray, offsets: np.ndarray, reject: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """First filters: byte strings of 3 and 5 bytes, greedily chosen so that they cover rejected texts, each several times, and few others; a quarter stay random."""
    filters = rng.normal(scale=0.05, size=(WIDTH, 256, FILTERS))

    def pairs(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct grams of texts [a, b) and their texts."""
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        doc = np.repeat(np.arange(b - a), np.diff(own))
        room = own[1:][doc] - np.arange(len(part))
        key = np.zeros(len(part), U64)
        found = []
        for k in range(1, min(5, len(part)) + 1):
            key[: len(part) - k + 1] |= part[k - 1 :].astype(U64) << U64(8 * k - 8)
            if k in (3, 5):
                gram = (key | U64(k) << U64(40))[room >= k]
                found.append(np.unique(gram + (doc[room >= k].astype(U64) << U64(48))))
        both = np.concatenate([np.zeros(0, U64), *found])
        return both & U64((1 << 48) - 1), (both >> U64(48)).astype(np.int64) + a

    # grams of too few rejected or too many accepted texts can't be chosen; they drop out by counts of their hashes,
    # which take little memory; the rest are counted exactly
    lots = [(a, min(a + 16, len(reject))) for a in range(0, len(reject), 16)]
    place = lambda gram: (mix(gram) >> U64(42)).astype(np.int64)
    times = np.zeros((2, 1 << 22), np.int32)
    for a, b in lots:
        gram, of = pairs(a, b)
        np.add.at(times, (reject[of].astype(np.int64), place(gram)), 1)
    use = (times[1] >= max(2, 0.005 * reject.sum())) & (times[1] / max(1, reject.sum()) > 2 * times[0] / max(1, (~reject).sum()))
    found = []
    for a, b in lots:
        gram, of = pairs(a, b)
        often = use[place(gram)]
        found.append((gram[often], of[often].astype(np.int32)))
    gram, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    del found, times, use
    if not len(gram):
        return filters
    kinds, at = np.unique(gram, return_inverse=True)
    del gram
    good = np.bincount(at, ~reject[doc], len(kinds)) / max(1, (~reject).sum())
    worth = reject / max(1, reject.sum())
    order = np.argsort(at, kind="stable")
    edge = np.searchsorted(at[order], np.arange(len(kinds) + 1))
    chosen: list[int] = []
    while len(chosen) < min(FILTERS * 3 // 4, len(kinds)):
        gain = np.bincount(at, worth[doc], len(kinds)) - 2 * good
        gain[chosen] = -1
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        chosen.append(best)
        worth[doc[order[edge[best] : edge[best + 1]]]] *= 0.35  # what is covered counts less
    for f, g in enumerate(chosen):
        k = int(kinds[g] >> U64(40))
        filters[:, :, f] = 0
        for j in range(k):
            filters[j, int(kinds[g] >> U64(8 * j)) & 255, f] = 1
    return filters


def fit(texts: list[bytes], reject: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the balanced logistic loss; the gradient reaches the filters through the maxima of the pools."""
    rng = np.random.default_rng(seed)
    for t in [t for t, r in zip(texts, reject, strict=True) if not r and len(t) > 40]:
        size = int(np.exp(rng.uniform(np.log(12), np.log(400))))
        at = int(rng.integers(0, max(1, len(t) - size)))
        texts = [*texts, t[at : at + size]]
    reject = np.r_[reject, np.zeros(len(texts) - len(reject), bool)]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    net = Network(seeds(data, offsets, reject, rng), rng)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    weight = np.where(reject, 0.5 / reject.mean(), 0.5 / (1 - reject.mean())).astype(np.float32)
    step = 0
    epochs = max(epochs, -(-STEPS // -(-len(texts) // 64)))
    with ThreadPoolExecutor(max(1, min(THREADS, os.cpu_count() or 1))) as pool:  # numpy lets go of the interpreter's lock
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            perm = rng.permutation(len(texts))
            for a in range(0, len(texts), 64):
                rows = perm[a : a + 64]
                grad = gradient(net, [texts[i] for i in rows], ~reject[rows], weight[rows], pool.map)
                step += 1
                for k, g in grad.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    net.p[k] -= (rate * (0.3 if k == "filters" else 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net.freeze()


def gradient(net: Network, texts: list[bytes], keep: np.ndarray, weight: np.ndarray, each: Callable = map) -> dict[str, np.ndarray]:
    """Gradient of the mean loss of a few texts; each applies the convolution to lots of blocks, which may be in parallel."""
    p, n = net.p, net.p["bias"].shape[0]
    size = np.array([len(t) for t in texts])
    count = (size + BLOCK - 1) // BLOCK
    padded = np.zeros((count.sum(), BLOCK + WIDTH), np.uint8)
    base = np.r_[0, np.cumsum(count)]
    for i, t in enumerate(texts):
        own = np.zeros(count[i] * BLOCK + WIDTH, np.uint8)
        own[: size[i]] = np.frombuffer(t, np.uint8)
        padded[base[i] : base[i + 1]] = np.lib.stride_tricks.sliding_window_view(own, BLOCK + WIDTH)[::BLOCK][: count[i]]
    room = np.full(count.sum(), BLOCK)
    room[base[1:] - 1] = size - (count - 1) * BLOCK
    top, where = np.empty((len(padded), n), np.float32), np.empty((len(padded), n), np.int64)

    # adjacent filter columns as tables over the pairs of bytes that occur
    two = padded[:, :-1].astype(np.int32) << 8 | padded[:, 1:]
    there = np.zeros(1 << 16, bool)
    there[two] = True
    pairs = np.flatnonzero(there)
    code = np.zeros(1 << 16, np.int32)
    code[pairs] = np.arange(len(pairs))
    tables = [p["filters"][j][pairs >> 8] + p["filters"][j + 1][pairs & 255] for j in range(0, WIDTH, 2)]

    def pool(c: int) -> None:
        lot = code[two[c : c + 32]]
        out = tables[0].take(lot[:, :BLOCK], 0)
        for j in range(1, WIDTH // 2):
            out += tables[j].take(lot[:, 2 * j : 2 * j + BLOCK], 0)
        for i in np.flatnonzero(room[c : c + 32] < BLOCK):  # positions beyond a text's end never win
            out[i, room[c + i] :] = -np.inf
        where[c : c + 32] = out.argmax(1)
        top[c : c + 32] = np.take_along_axis(out, where[c : c + 32, None, :], 1)[:, 0]

    list(each(pool, range(0, len(padded), 32)))  # few blocks at a time stay in a processor's cache
    row = np.repeat(np.arange(len(texts)), count)
    x = net.features(top, row)
    h = x @ p["hidden"] + p["hidden_bias"]
    a = np.maximum(h, 0)
    prob = 1 / (1 + np.exp(-np.clip(a @ p["out"] + p["out_bias"], -30, 30)))
    d = ((prob - keep) * weight / len(texts)).astype(np.float32)
    grad = {"out": a.T @ d, "out_bias": d.sum(keepdims=True)}
    dh = np.outer(d, p["out"]) * (h > 0)
    grad |= {"hidden": x.T @ dh + 1e-4 * p["hidden"], "hidden_bias": dh.sum(0)}
    dx = dh @ p["hidden"].T
    # back to blocks: of the greatest to its block, of the mean to each chunk's greater block
    back = np.zeros_like(top)
    f = np.arange(n)
    for i in range(len(texts)):
        own = top[base[i] : base[i + 1]]
        on = own + p["bias"] > 0
        back_i = np.zeros_like(own)
        best = own.argmax(0)
        back_i[best, f] += dx[i, :n]
        if len(own) == 1:
            back_i[0] += dx[i, n:]
        else:
            later = own[1:] > own[:-1]
            part = dx[i, n:] / (len(own) - 1)
            back_i[1:] += later * part
            back_i[:-1] += ~later * part
        back[base[i] : base[i + 1]] = back_i * on
    grad["bias"] = back.sum(0)
    flat = np.zeros((WIDTH, 256 * n), np.float32)
    used = back != 0
    block, filt = np.nonzero(used)
    for j in range(WIDTH):
        byte = padded[block, where[block, filt] + j].astype(np.int64)
        flat[j] = np.bincount(byte * n + filt, back[block, filt], 256 * n)
    grad["filters"] = flat.reshape(WIDTH, 256, n)
    return grad


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """The network fitted to a bounded sample of labelled documents, or None where a class is missing.

    Ids are chosen from the labels alone; their texts come in one pass whose filter is a list of bounded length."""
    verdict = labels.select(F.col(id_col).cast("long").alias("id"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("reject")).where("id is not null").groupBy("id").agg(F.max("reject").alias("reject"))
    chosen: dict[int, bool] = {}
    for side in (True, False):
        chosen |= {r.id: side for r in verdict.where(F.col("reject") == side).orderBy(F.xxhash64("id"), "id").limit(sample).collect()}
    if len(set(chosen.values())) < 2:
        return None
    size, at = F.length(text_col), F.pmod(F.xxhash64(F.col(id_col)), F.greatest(F.length(text_col) - SPAN, F.lit(1)))
    text = F.when(size > SPAN, F.substring(F.col(text_col), at.cast("int") + 1, F.lit(SPAN))).otherwise(F.col(text_col))
    rows = docs.where(F.col(id_col).isin(list(chosen))).select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where("text <> ''").distinct().collect()
    rows.sort(key=lambda r: (r.id, r.text))
    reject = np.array([chosen[r.id] for r in rows], bool)
    texts = [r.text.encode() for r in rows]
    del rows
    return fit(texts, reject, epochs, seed) if reject.any() and not reject.all() else None


def scores(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, probability, accepted) of every row; one narrow pass, no shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    score = classifier(docs, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prob = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prob), pa.array(prob >= threshold)], ["doc_id", "probability", "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, probability double, accepted boolean")


def classifier(docs: DataFrame, net: Network | None):  # noqa: ANN201
    """A function from a column of texts to probabilities, to run in tasks; the weights (under 1 MB) are broadcast."""
    if net is not None:
        net.__dict__.pop("pairs", None)
    held = docs.sparkSession.sparkContext.broadcast(net)

    def score(column: pa.Array) -> np.ndarray:
        net = held.value
        data, offsets = blob(column)
        if net is None:
            return (np.diff(offsets) > 0).astype(float)
        if not hasattr(net, "pairs"):
            net.freeze()
        return net.score(data, offsets)

    return score


def accepted(docs: DataFrame, net: Network | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't rejected; all columns as they were, one narrow pass."""
    prepare(docs.sparkSession)
    score, at = classifier(docs, net), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
