import random
import re

import numpy as np
import pyarrow as pa
from conftest_llm import WORDS, prose, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import common, decontaminate
from quillon.llm.queries import QUERIES

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def brute(documents, items, least):
    """(doc, item) -> (words, start, end, item start, item end) of the longest match, first in the document, then in the item."""
    out = {}
    for d, text in documents:
        a = list(WORD.finditer(text or ""))
        for i, item in items:
            b = list(WORD.finditer(item or ""))
            need = min(least, len(b))
            best = None
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n].group() == b[y + n].group():
                        n += 1
                    if n >= need > 0 and (best is None or n > best[0]):
                        best = (n, a[x].start(), a[x + n - 1].end(), b[y].start(), b[y + n - 1].end())
            if best and (out.get((d, i)) or (0,))[0] < best[0]:
                out[(d, i)] = best
    return out


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, id string")


def found(df):
    return {(r.doc_id, r.item_id): (r.n_words, r.doc_start, r.doc_end, r.item_start, r.item_end) for r in df.collect()}


def test_random_texts_equal_brute_force(spark):
    r = random.Random(8)
    few = [*WORDS[:3], "é"]
    for least in (1, 2, 3, 5, 13):
        documents = [(i, "".join(r.choice(few) + r.choice([" ", ", ", "\n"]) for _ in range(r.randint(0, 30)))) for i in range(40)]
        items = [(i, " ".join(r.choice(few) for _ in range(r.randint(0, 8)))) for i in range(12)]
        got = found(decontaminate.matches(table(spark, [(i, t, "en") for i, t in documents]), bench(spark, items), min_words=least, least_words=1))
        assert got == brute(documents, items, least)


@given(st.lists(st.lists(st.integers(1, 3), max_size=12), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_suffix_array(texts):
    ids = np.array([w for t in texts for w in t], np.int64)
    if not len(ids):
        return
    left = np.array([len(t) - k for t in texts for k in range(len(t))])
    order = decontaminate.suffix_array(ids, left)
    suffixes = [tuple(ids[p : p + left[p]]) for p in order]
    assert sorted(order.tolist()) == list(range(len(ids))) and suffixes == sorted(suffixes)


def test_shards_and_slices(spark, monkeypatch):
    passage = prose("passage", 60)
    documents = [(i, f"{prose(i, 50)} {passage if i % 7 == 0 else ''} {prose(-i, 20)}") for i in range(60)] + [(100, prose("x", 30_000) + " " + passage)]
    items = [(1, passage), (2, prose("other", 40)), (3, passage[200:] + " tail")]
    docs = table(spark, [(i, t, "en") for i, t in documents])
    whole = found(decontaminate.matches(docs, bench(spark, items)))
    assert whole == found(decontaminate.matches(docs, bench(spark, items), sent=150))
    assert {d for d, _ in whole} == {i for i, _ in documents if i % 7 == 0 and i < 100} | {100}
    kept = decontaminate.clean(docs, bench(spark, items), sent=150)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, _ in documents} - {d for d, _ in whole}


def test_short_items(spark):
    """Items of eight words or more must occur whole; shorter ones, which any document may hold, remove nothing and are listed."""
    eight = "what is the oldest bridge over this river"
    docs = table(spark, [(1, f"yes, {prose(1, 30)}", "en"), (2, f"{prose(2, 20)} {eight}. {prose(3, 20)}", "en"), (3, f"{prose(4, 20)} {eight[:30]}", "en")])
    items = [(1, "yes"), (2, eight), (3, eight[:18])]
    assert set(found(decontaminate.matches(docs, bench(spark, items)))) == {(2, 2)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench(spark, items)).select("doc_id").collect()} == {1, 3}
    assert rows(decontaminate.skipped(bench(spark, items))) == [(1, 1), (3, 4)]
    assert set(found(decontaminate.matches(docs, bench(spark, items), least_words=1))) == {(1, 1), (2, 2), (2, 3), (3, 3)}


def test_long_texts_come_in_windows(monkeypatch):
    """The same matches whether a text is one shard or many windows."""
    r = random.Random(5)
    items = decontaminate.Items([1, 2, 3], [" ".join(r.choice(WORDS[:6]) for _ in range(n)) for n in (20, 45, 9)])
    texts = [" ".join(r.choice(WORDS[:6]) for _ in range(400)) for _ in range(6)]
    texts = [t + " " + items.text[k % 3].tobytes().decode() + " " + t[:300] + "é 天地" * 20 for k, t in enumerate(texts)]
    data, offsets = common.blob(pa.array(texts))
    whole = sorted(decontaminate.search(data, offsets, items, 4, 1))
    assert len(whole) == 18
    for size in (40, 333, 1000):
        monkeypatch.setattr(decontaminate, "SHARD", size)
        assert sorted(decontaminate.search(data, offsets, items, 4, 1)) == whole


def test_edges(spark, edge, empty, edge_rows):
    items = [(1, prose(1)), (2, None), (3, ""), (4, "..."), (None, prose(9)), (5, "é"), (6, prose(6)[:120]), (1, prose(1))]
    got = found(decontaminate.matches(edge, bench(spark, items)))
    want = brute([(i, t) for i, t, _ in edge_rows], [(i, t) for i, t in items if i in (1, 6)], 13)
    assert got == want and {d for d, _ in got} == {1, 5, None}
    assert rows(decontaminate.skipped(bench(spark, items))) == sorted([(2, 0), (3, 0), (4, 0), (5, 1), (None, 120)], key=repr)
    assert decontaminate.clean(edge, bench(spark, items)).count() == edge.count() - 4
    assert rows(decontaminate.matches(empty, bench(spark, items))) == [] and rows(decontaminate.matches(edge, bench(spark, []))) == []
    assert decontaminate.clean(edge, bench(spark, [])).count() == edge.count()


def test_query(spark, sf):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = found(QUERIES["op7_decontaminate"](spark, sf))
    grams = {}
    for i, t in items:
        w = WORD.findall(t)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = set()
    for d, t in documents:
        w = WORD.findall(t)
        for k in range(len(w) - 12):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 13]), ())}
    assert set(got) == want and want
    texts, bench_texts = dict(documents), dict(items)
    for (d, i), (n, s, e, x, y) in got.items():
        assert WORD.findall(texts[d][s:e]) == WORD.findall(bench_texts[i][x:y]) and len(WORD.findall(texts[d][s:e])) == n


def test_scripts_without_spaces(spark):
    """A passage inside a longer run of ideographs, kana or Thai is found where it stands."""
    passages = ["天地玄黄宇宙洪荒日月盈昃辰宿列张", "いろはにほへとちりぬるをわかよたれそ", "กขคฆงจฉชซฌญฎฏฐฑฒณ"]
    docs = [(i, f"前後{p[:9]}、{p[9:]}後前" if i == 1 else f"前後{p}後前", "zh") for i, p in enumerate(passages, 1)] + [(9, passages[0][:12] + "別" + passages[0][12:], "zh")]
    benchmark = spark.createDataFrame([(i, f"問{p}。") for i, p in enumerate(passages, 1)], "item_id long, text string")
    got = decontaminate.matches(table(spark, docs), benchmark).collect()
    assert {(r.doc_id, r.item_id, r.n_words, r.doc_start) for r in got} == {(i, i, len(p), 2) for i, p in enumerate(passages, 1)}
    assert {r.doc_id for r in decontaminate.clean(table(spark, docs), benchmark).collect()} == {9}
