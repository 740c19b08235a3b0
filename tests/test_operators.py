import math
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from quillon.operators import counts, graph, indexes, lookup, sequence, sets, similarity, terms


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


INDEX = "key string, post_id long, user_id long, s long"


def index(spark, data):
    return frame(spark, data, INDEX).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_lifetimes_keep_the_last_key(spark):
    i = index(spark, [("#a", 1, 1, 0), ("#b", 2, 1, 0), ("#b", 3, 1, 3600), ("#c", 4, 1, 0), ("#c", 5, 1, 3601), ("#z", 6, 1, 0), ("#z", 7, 1, 7200)])
    assert rows(counts.lifetimes(i, 3_600_000)) == [("#a", 1), ("#b", 1), ("#c", 2), ("#z", 3)]


def test_related_by_definition(spark):
    r = random.Random(1)
    data = sorted({(f"#{r.choice('abcde')}", r.randint(1, 40), 1, 0) for _ in range(120)})
    posts = {}
    for k, p, *_ in data:
        posts.setdefault(k, set()).add(p)
    want = {k: round(len(v & posts["#a"]) / len(v | posts["#a"]), 9) for k, v in posts.items() if k != "#a" and v & posts["#a"]}
    got = {x.key: round(x.jaccard, 9) for x in counts.related(index(spark, data), "#A", 0.0).collect()}
    assert got == want
    assert counts.related(index(spark, data), "#none", 0.1).count() == 0


def test_entropy(spark):
    i = index(spark, [("http://a.b/1", 1, 1, 0), ("http://a.b/2", 2, 1, 0), ("http://c.d/", 3, 1, 0), ("#x", 4, 1, 0), ("http://a.b/", 5, 2, 0), ("http://bad host", 6, 2, 0)])
    got = {r.user_id: r.entropy for r in counts.host_entropy(i).collect()}
    assert got[1] == pytest.approx(-(2 / 3) * math.log(2 / 3) - (1 / 3) * math.log(1 / 3)) and got[2] == pytest.approx(0)


def test_daily_lines(spark):
    lines = frame(spark, [("2012_06_08|#tag|345",), ("2012-06-09|#tag|559",), ("broken",), ("2012_06_08|#tag|x",), ("2012_06_08|#tag|5",)], "value string")
    text = counts.series_text(counts.series(counts.read_daily(lines)))
    assert rows(text) == [("#tag", "2012-06-08|350 2012-06-09|559")]


def test_top_keeps_every_entry(spark):
    t = frame(spark, [(k, n) for k, n in zip("abcdef", [5, 9, 9, 1, 7, 3], strict=True)], "key string, n long")
    assert [tuple(r) for r in counts.top(t, 4, "n", "key").collect()] == [("b", 9), ("c", 9), ("e", 7), ("a", 5)]


def test_edges_and_directions(spark):
    links = frame(spark, [(1, 2), (1, 2), (2, 1), (10, 9), (3, None)], "user_id long, target long")
    assert rows(counts.edges(links, "out")) == [(1, 2, 2), (10, 9, 1), (2, 1, 1)] and rows(counts.edges(links, "in")) == [(1, 2, 1), (2, 1, 2), (9, 10, 1)]
    assert rows(counts.undirected_edges(links)) == [("1", "2", 3), ("10", "9", 1)]
    with pytest.raises(ValueError):
        counts.edges(links, "up")
    n = graph.neighbour_sets(links, "user_id", "target")
    assert rows(graph.read_adjacency(graph.adjacency_lines(n))) == [("1", "2"), ("10", "9"), ("2", "1"), ("9", "10")]


def naive_stretches(dates, unit):
    out = []
    for d, f in sorted(dates):
        if out:
            u = (d - out[-1][1]) // unit + 1
            if u <= out[-1][0] + 1:
                out[-1] = [u, out[-1][1], d, out[-1][3] + f]
                continue
        out.append([1, d, d, f])
    return out


def test_consecutive_lifetimes(spark):
    r = random.Random(2)
    data = {k: [(d, r.randint(1, 5)) for d in sorted(r.sample(range(40), r.randint(1, 20)))] for k in "abcdef"}
    freq = frame(spark, [(k, d, f) for k, v in data.items() for d, f in v], "key string, d int, freq long").select("key", F.date_format(F.date_add(F.lit("2012-06-01").cast("date"), F.col("d")), "yyyy-MM-dd").alias("date"), "freq")
    for unit in (1, 2, 7):
        got = sorted((x.key, x.units, x.freq) for x in sequence.consecutive(counts.series(freq), unit).collect())
        assert got == sorted((k, s[0], s[3]) for k, v in data.items() for s in naive_stretches(v, unit))
    assert rows(sequence.consecutive(counts.series(freq))) == rows(sequence.consecutive_days(freq))
    life = {x.key: (x.units, x.lifespan, x.days, x.freq) for x in sequence.total_lifetime(freq, 7).collect()}
    assert life == {k: (len({(d - v[0][0]) // 7 for d, _ in v}), (v[-1][0] - v[0][0]) // 7 + 1, len(v), sum(f for _, f in v)) for k, v in data.items()}


def test_snake_is_balanced_and_global(spark):
    t = spark.range(1000).select(F.col("id"), (F.col("id") * 7 % 101).alias("w"))
    got = sets.snake(t, "w", "id", 4)
    order = sorted(((-(i * 7 % 101), i) for i in range(1000)))
    want = {i: (p % 8 if p % 8 < 4 else 7 - p % 8) for p, (_, i) in enumerate(order)}
    assert {r.id: r.part for r in got.collect()} == want
    stats = graph.split_stats(got, "w").collect()
    assert {s.vertices for s in stats} == {250} and max(s.weight for s in stats) - min(s.weight for s in stats) < 100


def test_sets(spark):
    a, b = frame(spark, [(1,), (1,), (2,)], "post_id long"), frame(spark, [(2,), (3,)], "post_id long")
    assert rows(sets.union([a, b])) == [(1,), (2,), (3,)] and rows(sets.intersection([a, b])) == [(2,)] and rows(sets.difference(a, b, "post_id")) == [(1,), (1,)]
    assert tuple(sets.repeats(a, "post_id").first()) == (2, 1) and tuple(sets.repeats(a.limit(0), "post_id").first()) == (0, 0)
    assert len(sets.range_bounds(spark.range(100), "id", 4)) == 3


def test_numbering(spark):
    e = frame(spark, [("b", "a"), ("c", "b"), (None, "d")], "src string, dst string")
    assert rows(graph.number_vertices(e)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_layout(spark):
    e = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4)], "src long, dst long")
    first = graph.start_layout(e.select(F.col("src").alias("v")), "v", 1)
    assert all(-1 <= r.x <= 1 and -1 <= r.y <= 1 for r in first.collect())
    a, b = (rows(graph.layout(e, 2, seed=1)) for _ in range(2))
    assert a == b and len(a) == 4 and all(math.isfinite(c) for r in a for c in r[1:])
    start = {r.v: (r.x, r.y) for r in first.collect()}
    one = {v: (x, y) for v, x, y in rows(graph.layout(e, 1, max_delta=0.1, seed=1))}
    assert all(math.dist(one[v], start[v]) <= 0.1 + 1e-9 for v in one)
    assert graph.layout(e.limit(0), 2).count() == 0


def test_nmi(spark):
    c = lambda xs: frame(spark, [(i, x) for i, x in enumerate(xs)], "item long, cluster long")
    nmi = lambda x, y: similarity.lfk_nmi(c(x), c(y)).first().nmi
    assert nmi([0, 0, 1, 1, 2, 2], [5, 5, 7, 7, 9, 9]) == pytest.approx(1)
    assert nmi([0, 0, 0, 1, 1, 1], [0, 1, 0, 1, 0, 1]) < 0.2
    a, b = [0, 0, 0, 1, 1, 1, 2, 2], [0, 0, 1, 1, 1, 1, 2, 2]
    assert 0.3 < nmi(a, b) < 1 and nmi(a, b) == pytest.approx(nmi(b, a))
    assert nmi([0, 0, 0], [1, 1, 1]) == pytest.approx(1)


def test_similarities(spark):
    r = random.Random(3)
    v = {i: {k: r.randint(1, 4) for k in r.sample("abcdefgh", 4)} for i in range(8)}
    tall = frame(spark, [(i, k, w) for i, m in v.items() for k, w in m.items()], "row long, key string, w long")
    got = {(x.a, x.b): x.cosine for x in similarity.cosine_pairs(tall, "row", "key", "w").collect()}
    for (a, b), c in got.items():
        d = sum(v[a][k] * v[b].get(k, 0) for k in v[a])
        assert c == pytest.approx(d / math.sqrt(sum(x * x for x in v[a].values()) * sum(x * x for x in v[b].values())))
    assert set(got) == {(a, b) for a in v for b in v if a < b and set(v[a]) & set(v[b])}
    best = similarity.best_of([frame(spark, [(1, 2, 0.3)], "a long, b long, cosine double"), frame(spark, [(1, 2, 0.7), (1, 3, 0.1)], "a long, b long, cosine double")])
    assert rows(best) == [(1, 2, 0.7), (1, 3, 0.1)]
    p = similarity.percentiles(spark.range(101), "id", [0.5, 0.9], exact=False).first()
    assert (p.p50, p.p90) == (50.0, 90.0)


def test_postings(spark):
    docs = frame(spark, [(1, "red fox red hen"), (2, "fox hen red"), (3, "hen"), (4, None)], "doc_id long, text string")
    both = indexes.frequencies_and_positions(docs)
    assert ("red", 1, 2, [0, 2]) in rows(both)
    assert rows(terms.both_terms(both, "red", "fox")) == [(1,), (2,)] and rows(terms.both_terms(both, "red", "fox", 1)) == [(1,)]
    pairs = rows(terms.pair_frequencies(terms.neighbours(docs)))
    assert pairs == [("fox", "red", 1, 1), ("hen", "red", 1, 1)]
    score = terms.synonyms(terms.pair_frequencies(terms.neighbours(docs)).withColumn("forward", F.lit(3)), terms.term_hits(both)).collect()
    assert {(s.t1, s.t2): (s.c1, s.c2) for s in score} == {("fox", "red"): (2, 3), ("hen", "red"): (3, 3)} and score[0].p == 3
    assert rows(terms.term_hits(both, 2)) == [("hen", 3), ("red", 3)]


def test_blanked_terms(spark):
    p = frame(spark, [(1, 1, "see #Fox at http://fox.org fox", ["#Fox", "http://fox.org"])], "post_id long, user_id long, text string, memes array<string>").withColumn("ts", F.current_timestamp())
    assert {r.key for r in indexes.text_index(p).collect()} == {"see", "fox"}


def test_boxes(spark):
    with pytest.raises(ValueError):
        lookup.by_box(frame(spark, [], "x int, y int, post_id long"), "0_0", "20000_0")
    cells = frame(spark, [(0, 0, 1), (5, 5, 2), (6, 5, 3)], "x int, y int, post_id long")
    assert rows(lookup.by_box(cells, "5_5", "0_0")) == [(1,), (2,)]


def test_newest(spark):
    t = index(spark, [("a", i, 1, i % 3) for i in range(6)])
    assert [r.post_id for r in lookup.newest(t, 3).collect()] == [5, 2, 4]
    assert rows(lookup.ranked(t.select("key", "post_id"), [F.col("key")], [F.col("post_id").desc()], 2).select("post_id")) == [(4,), (5,)]
    assert rows(lookup.latest_per_key(t, "key", "ts", "user_id")) == [("a", 1)]


def test_repulsion_by_cells_is_close_to_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    at = rng.uniform(-1, 1, (900, 2))
    now = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "v long, x double, y double")

    def total(exact):
        got = np.zeros((900, 2))
        for r in graph.repulsion(now, 900, 900.0, exact, 144).groupBy("a").agg(F.sum("fx").alias("x"), F.sum("fy").alias("y")).collect():
            got[r.a] = r.x, r.y
        return got

    whole, cells = total(900), total(0)
    far = np.linalg.norm(whole - cells, axis=1) / np.linalg.norm(whole, axis=1)
    assert np.median(far) < 0.02 and np.quantile(far, 0.95) < 0.15


def test_halved_by_loop(spark):
    t = spark.range(301).select(F.col("id"), (F.col("id") * 7 % 41).alias("w"))
    want = {i: 0 for i in range(301)}
    for _ in range(3):
        fresh = {}
        for p in set(want.values()):
            for k, i in enumerate(sorted((i for i in want if want[i] == p), key=lambda i: (-(i * 7 % 41), i))):
                fresh[i] = 2 * p + (k % 4 if k % 4 < 2 else 3 - k % 4)
        want = fresh
    assert {r.id: r.part for r in sets.halved(t, "w", "id", 3).collect()} == want
