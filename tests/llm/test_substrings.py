import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import prose, rows, table
from oracle import compare
from pyspark.sql import functions as F

from quillon.llm import common, substrings
from quillon.llm.queries import ORACLE_SQL, QUERIES

CUT = {"sentence": r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", "line": r"[^\n]*\n|[^\n]+", "paragraph": r"(?s).+?\n\n+|.+"}


def brute(documents, unit="sentence", least=substrings.MIN_WORDS, rank=lambda i: i):
    seen, every = {}, []
    for i, text in documents:
        if i is None:
            continue
        nth = 0
        for u, m in enumerate(re.finditer(CUT[unit], text or "", re.S if unit == "paragraph" else 0)):
            words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in m.group()))
            if words:
                every.append(((rank(i), i, m.start()), " ".join(words), u, m.end(), nth, len(words), text))
                nth += 1
    for place, form, *_ in every:
        seen[form] = min(seen.get(form, place), place)
    out, run = [], []

    def close():
        if sum(x[1] for x in run) >= least:
            out.extend(x[0] for x in run)
        run.clear()

    last = None
    for p, form, u, end, nth, size, text in every:
        if last != (p[1], text, nth - 1):
            close()
        if p != seen[form]:
            run.append(((p[1], u, p[2], end, seen[form][1], seen[form][2]), size))
        else:
            close()
        last = (p[1], text, nth)
    close()
    return sorted(out, key=repr)


def some(seed, n=60):
    r = random.Random(seed)
    pool = [prose(f"s{k}", r.randint(1, 9)).replace(".", "") for k in range(25)]
    return [(i, "".join(r.choice([s, s.upper(), s.replace(" ", "  ")]) + r.choice([". ", "!\n", "\n", "\n\n", "\n\n\n", " ?! "]) for s in r.choices(pool, k=r.randint(0, 8))) + "é ü") for i in range(n)]


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_units_equal_brute_force(spark, unit):
    documents = some(unit)
    for least in (1, 5, 13):
        got = substrings.repeats(table(spark, [(i, t, "en") for i, t in documents]), unit=unit, min_words=least)
        assert rows(got) == brute(documents, unit, least)


def test_rank(spark):
    documents = some("rank")
    docs = table(spark, [(i, t, "en") for i, t in documents]).withColumn("order", -F.col("doc_id"))
    assert rows(substrings.repeats(docs, rank_col="order")) == brute(documents, rank=lambda i: -i)


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_long_texts_come_in_pieces(monkeypatch, unit):
    """The same units whether a text is taken whole or in pieces of a few bytes."""
    texts = [t for _, t in some("pieces", 25)] + [prose("big", 400), "x" * 700 + ". y", "é" * 90 + "\n\n\nz", "\n" * 90, ""]
    data, offsets = common.blob(pa.array(texts))
    whole = sorted(zip(*(np.concatenate(c).tolist() for c in zip(*substrings.digests(data, offsets, unit), strict=True)), strict=True))
    for size in (16, 50, 200):
        monkeypatch.setattr(substrings, "stretches", lambda o, d, stop, n=size: common.stretches(o, d, stop, n))
        assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*substrings.digests(data, offsets, unit), strict=True)), strict=True)) == whole


def test_common_short_units_stay(spark):
    """A short unit that is everywhere stays by itself and goes within a copied passage."""
    passage = "So it was. They went on. And on. Then the old bridge near the mill fell down at last."
    docs = table(spark, [(1, f"{prose(1, 30)}. So it was. {prose(11, 9)}. {passage}", "en"), (2, f"{prose(2, 30)}. So it was. {prose(12, 9)}.", "en"), (3, f"{prose(3, 30)}. {passage} {prose(13, 9)}", "en")])
    assert {(r.doc_id, r.kept_doc_id) for r in substrings.repeats(docs).collect()} == {(3, 1)}
    assert substrings.repeats(docs).count() == 4


def test_planted_passage(spark):
    passage = ". ".join(prose(f"p{k}", 14).replace(".", "") for k in range(5)) + ". "
    docs = table(spark, [(i, f"{prose(i, 40).replace('.', '')} {passage}{prose(-i, 40)}", "en") for i in range(1, 30)] + [(i, prose(i, 60), "en") for i in range(100, 130)])
    got = substrings.repeats(docs)
    assert {r.doc_id for r in got.collect()} == set(range(2, 30))


def test_remove(spark, edge, edge_rows):
    documents = [*some("cut"), (200, None), (201, "")]
    docs = table(spark, [(i, t, "en") for i, t in documents])
    gone = {}
    for i, _, s, e, *_ in brute(documents):
        gone.setdefault(i, []).append((s, e))
    got = substrings.remove(docs)
    assert got.columns == [*docs.columns, "kept_spans"]
    for r in got.collect():
        text = dict(documents)[r.doc_id]
        if text is None:
            assert r.text is None and r.kept_spans is None
            continue
        assert r.text == "".join(text[s:e] for s, e in r.kept_spans)
        assert r.text == "".join(c for k, c in enumerate(text) if not any(s <= k < e for s, e in gone.get(r.doc_id, [])))
    assert substrings.remove(edge).count() == edge.count()


def test_edges(edge, empty, edge_rows):
    want = set(brute([*dict.fromkeys((i, t) for i, t, _ in edge_rows)]))
    got = rows(substrings.repeats(edge))
    assert set(got) == want and {r[0] for r in got} >= {5}
    assert rows(substrings.repeats(empty)) == [] and substrings.remove(empty).count() == 0
    with pytest.raises(ValueError):
        substrings.unit_ends(np.zeros(1, np.uint8), np.array([0, 1]), "page")


def test_query(spark, sf):
    compare(QUERIES["op8_substrings"](spark, sf), ORACLE_SQL["op8_substrings"], sf)
