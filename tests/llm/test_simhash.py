import random

import numpy as np
import pyarrow as pa
from conftest_llm import prose, rows, table

from quillon.llm import common, simhash


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(prose(f"{seed}{i}", 1) if r.random() < share else w for i, w in enumerate(text.split(" ")))


def prints(texts):
    return simhash.fingerprint(*common.blob(pa.array(texts)))


def test_fingerprint_is_the_majority_of_words():
    text = "b a A c b. "
    words = sorted({w for w in ["a", "b", "c"]})
    data, offsets = common.blob(pa.array(words))
    h = common.span_hashes(data, offsets[:-1], offsets[1:]) >> np.uint64(12)
    want = []
    for half in (0, 1):
        bits = np.unpackbits(common.mix(h + np.uint64(0x632BE59BD9B4E019 * (half + 1) & (1 << 64) - 1))[:, None].view(np.uint8), axis=1)
        want.append(np.packbits(bits.sum(0) * 2 > len(words)).view(np.int64)[0])
    row, got = prints(["", text, None])
    assert row.tolist() == [1] and got[0].tolist() == want


def test_fingerprint_of_many_words_and_rows():
    long = " ".join(f"w{i}" for i in range(5000))
    many = [f"x{i}" for i in range(5000)]
    _, a = prints([long, *many])
    _, b = prints([long])
    assert (a[0] == b[0]).all() and len(a) == 5001
    assert (a[17] == prints([many[16]])[1][0]).all()


def test_groups_equal_brute_force(spark):
    texts, n = [], 0
    for base in range(40):
        text = prose(base, 200)
        texts += [text] + [edited(text, f"{base}-{k}", 0.02) for k in range(base % 4)] + [text] * (base % 3 == 0)
    texts += [prose(f"lone{i}", 150) for i in range(60)]
    got = {r.doc_id: r.kept_doc_id for r in simhash.near_duplicates(table(spark, [(i, t, "en") for i, t in enumerate(texts)]), cap=8).collect()}
    _, p = prints(texts)
    p = p.view(np.uint64)
    far = np.bitwise_count(p[:, None, 0] ^ p[None, :, 0]) + np.bitwise_count(p[:, None, 1] ^ p[None, :, 1])
    pairs = hit = 0
    for i in range(len(texts)):
        for j in range(i):
            same = got.get(i, i) == got.get(j, j)
            if far[i, j] <= simhash.RADIUS:
                pairs, hit = pairs + 1, hit + same
            elif same:  # only through others
                n += 1
    assert pairs > 60 and hit / pairs >= 0.9
    assert not any(i >= len(texts) - 60 for i in got)


def test_large_buckets_are_divided_and_lose_nothing_near():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    p = np.repeat(base, 60, axis=0)
    p[:, 0] ^= np.uint64(1) << rng.integers(0, 64, len(p)).astype(np.uint64)
    p = np.unique(p, axis=0)
    bit = np.unpackbits(np.ascontiguousarray(p).view(np.uint8), axis=1)
    groups = list(simhash.divide(bit, np.random.default_rng(0).permutation(128), np.arange(len(p)), 0, 50))
    assert max(map(len, groups)) <= 50 and len(np.concatenate(groups)) <= len(p)
    assert len(set(np.concatenate(groups).tolist())) == len(np.concatenate(groups))
    a, b = simhash.star(p, np.arange(len(p))[::-1].copy(), 2)
    assert (b < a).all()


def test_edges(edge, empty):
    got = rows(simhash.near_duplicates(edge))
    assert got == [(5, 1, 0)]  # repeated rows of one id are one document; null and empty texts are never grouped
    kept = simhash.deduplicate(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [0, 0, 1, 2, 3, 4, 7, 8, 9, 10]  # of rows with one id one stays
    assert rows(simhash.near_duplicates(empty)) == [] and simhash.deduplicate(empty).count() == 0


def test_rows_are_what_goes(spark, tmp_path):
    """One row of each group stays: the least id, none last; of equal ids the first in the files; texts without words by exact hash."""
    same, marks = prose("same", 80), "*** --- ***"
    docs = table(spark, [(None, same, "a"), (7, same, "b"), (5, same, "c"), (5, same, "d"), (9, marks, "e"), (8, marks, "f"), (None, marks, "g"), (3, "***", "h"), (1, "", "i"), (2, "", "j"), (4, None, "k"), (None, prose("x"), "l"), (None, prose("x"), "m")])
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    for read in (docs, spark.read.parquet(f"{tmp_path}/one")):
        got = simhash.deduplicate(read)
        assert got.columns == docs.columns
        kept = {r.lang for r in got.collect()}
        assert kept >= set("fhijk") and kept & set("cd") and len(kept & set("lm")) == 1 and len(kept) == 7
    docs.repartition(5).write.parquet(f"{tmp_path}/several")
    assert simhash.deduplicate(spark.read.parquet(f"{tmp_path}/several")).count() == 7


def test_query(spark, sf):
    from quillon.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r.kept_doc_id for r in QUERIES["op1_simhash"](spark, sf).collect()}
    at, p = prints([d.text for d in docs])
    p = p.view(np.uint64)
    far = np.bitwise_count(p[:, None, 0] ^ p[None, :, 0]) + np.bitwise_count(p[:, None, 1] ^ p[None, :, 1])
    near = [(docs[at[i]].doc_id, docs[at[j]].doc_id) for i, j in zip(*np.nonzero(far <= simhash.RADIUS), strict=True) if i < j]
    assert sum(got.get(a, a) == got.get(b, b) for a, b in near) >= 0.9 * len(near)
    assert all(kept < i for i, kept in got.items())


def test_recall_in_buckets_above_the_cap(spark):
    """Pairs near the radius stay together, by brute force, in one table whose bucket is far above the cap: pairs apart from
    all others, and variants of one hot template."""
    rng = np.random.default_rng(4)
    sample = simhash.coordinates(1, simhash.SEED)[0][: simhash.SAMPLED]
    free = np.setdiff1d(np.arange(simhash.BITS), sample)
    for hot in (False, True):
        bit = rng.integers(0, 2, (2000, simhash.BITS), dtype=np.uint8)
        if hot:
            bit[:] = bit[0]
            for row in bit:
                row[rng.choice(free, 30, replace=False)] ^= 1
        bit[:, sample] = 1
        twin = bit.copy()
        for row in twin:
            row[rng.choice(free, rng.integers(17, simhash.RADIUS + 1), replace=False)] ^= 1
        p = np.packbits(np.concatenate([bit, twin]), axis=1).view(np.int64)
        nodes = spark.createDataFrame([(int(x), int(y), i) for i, (x, y) in enumerate(p)], "hi long, lo long, id long")
        u = p.view(np.uint64)
        far = np.bitwise_count(u[:, None, 0] ^ u[None, :, 0]) + np.bitwise_count(u[:, None, 1] ^ u[None, :, 1])
        near = [(int(a), int(b)) for a, b in zip(*np.nonzero(far <= simhash.RADIUS), strict=True) if a < b]
        assert len(near) >= 2000
        for most in (simhash.MOST, 1000):  # divided in one task, and before the shuffle
            found = simhash.links(nodes, simhash.RADIUS, 256, 1, simhash.SAMPLED, simhash.SEED, most)
            root = {r.node: r.root for r in common.components(found).collect()}
            assert sum(root.get(a, a) == root.get(b, b) for a, b in near) >= 0.9 * len(near)


def test_no_task_holds_a_large_bucket(spark):
    rng = np.random.default_rng(9)
    p = rng.integers(-(1 << 63), 1 << 63, (6000, 2), dtype=np.int64)
    nodes = spark.createDataFrame([(int(x), int(y), i) for i, (x, y) in enumerate(p)], "hi long, lo long, id long")
    whole = simhash.spread(nodes, 2, 1, 3)
    got = simhash.divided(whole, nodes, 2, 1, 256, simhash.RADIUS, 3, 1000)
    sizes = got.groupBy("table", "bucket", "way").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 256 and whole.groupBy("table", "bucket").count().agg({"count": "min"}).first()[0] > 1000
    # every way has every node once
    _, ways = simhash.division(3000, 256, simhash.RADIUS, 1)
    each = got.groupBy("table", "way", "id").count()
    assert each.where("count <> 1").isEmpty() and each.count() == 2 * ways * 6000
