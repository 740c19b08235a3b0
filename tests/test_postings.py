"""Postings and pairs of terms against loops and against the analysis in Spark's own expressions."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_plans import exchanges, plan

from quillon import load_queries, queries  # noqa: F401
from quillon.functions.text import analyze, is_number
from quillon.operators import indexes, postings, terms

WORDS = ["the", "red", "fox", "cafe", "1984", "0xff", "0x", "0xfg", "é", "Élan", "abc", "x1", "²", "ª", "٣", "日本", "𝒳", "z"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    data = [(r.choice([None, *range(20)]), " ".join(r.choices(WORDS, k=r.randint(0, 30)))) for _ in range(60)]
    return spark.createDataFrame([*data, (3, None), (99, ""), (98, "the 1984")], "doc_id long, text string").repartition(5)


def kept(docs):
    return [(r.doc_id, r.ts) for r in docs.select("doc_id", analyze(F.col("text"), drop_numbers=True).alias("ts")).collect() if r.ts]


def test_numbers_as_in_sql(spark):
    tokens = [*(w.lower() for w in WORDS), "f", "g", "0x0", "00x1", "éa", "12", "0xé"]
    t = spark.createDataFrame([(w,) for w in tokens], "t string").select("t", is_number(F.col("t")).alias("n"))
    assert {r.t: r.n for r in t.collect()} == {w: postings._number(w) for w in tokens}


def test_postings_by_loops(docs):
    """Rows of an id are one document, those without an id too."""
    want = {}
    for i, ts in kept(docs):
        for k, t in enumerate(ts):
            want.setdefault((t, i), []).append(k)
    got = indexes.frequencies_and_positions(docs)
    assert rows(got) == sorted(((t, i, len(p), sorted(p)) for (t, i), p in want.items()), key=repr)
    assert rows(indexes.positions(docs)) == sorted(((t, i, sorted(p)) for (t, i), p in want.items()), key=repr)
    assert rows(indexes.term_frequencies(docs)) == sorted(((t, i, len(p)) for (t, i), p in want.items()), key=repr)
    assert indexes.positions(docs.limit(0)).count() == 0


def test_pairs_by_loops(docs):
    ahead, back = Counter(), Counter()
    for _, ts in kept(docs):
        for a, b in zip(ts, [*ts[1:], ts[-1]], strict=True):
            (ahead if a <= b else back)[min(a, b), max(a, b)] += 1
    want = {(a, b, ahead[a, b], back[a, b]) for a, b in {*ahead, *back}}
    assert rows(terms.neighbours(docs)) == sorted(want, key=repr)
    assert rows(terms.neighbours(docs, both_ways=True)) == sorted((w for w in want if w[2] and w[3]), key=repr)
    hits = Counter(t for _, ts in kept(docs) for t in ts)
    assert rows(terms.term_hits(terms.counts_in_pieces(docs))) == sorted(((t, n) for t, n in hits.items() if n > 1), key=repr)


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_pieces_hold_all_rows_and_whole_ids(monkeypatch, size):
    monkeypatch.setattr(postings, "PIECE", size)
    r = random.Random(size)
    ids = sorted(r.choices(range(30), k=200))
    lists = [None if r.random() < 0.1 else ["t"] * r.randint(0, 6) for _ in ids]
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([None if i == 0 else i for i in ids[a : a + 23]], pa.int64()), "l": pa.array(lists[a : a + 23], pa.list_(pa.string()))}) for a in range(0, 200, 23)]
    for by_id in (False, True):
        got = list(postings._pieces(iter(batches), by_id))
        assert [x for g in got for x in g.column(1).to_pylist()] == lists and all(g.num_rows for g in got)
        if by_id:
            assert all(a.column(0)[-1].as_py() != b.column(0)[0].as_py() for a, b in zip(got, got[1:], strict=False))
        elif size < 10_000:
            assert max(sum(len(x or ()) for x in g.column(1).to_pylist()) for g in got) <= size + 6


@pytest.mark.parametrize("name", ["positional_index", "freq_and_positions", "pair_freq"])
def test_no_row_a_token_is_shuffled(spark, sf, name):
    text = plan(queries.QUERIES[name](spark, sf))
    assert "Aggregate" not in text and "Generate" not in text


def test_terms_are_found_once_for_tfidf(spark, sf):
    found = queries.QUERIES["tfidf"](spark, sf)
    assert plan(found).count("MapInArrow") == 1 and "Join" not in plan(found).replace("BroadcastNestedLoopJoin", "") and exchanges(found) <= 3
