import math

import numpy as np
import pyarrow as pa
from conftest_llm import rows, table
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import common, langid


def brute(samples, text, order):
    """Code length by the definition, one byte after another."""
    counts = {}
    for s in samples:
        for i in range(len(s)):
            for k in range(min(i, order) + 1):
                c = counts.setdefault(s[i - k : i], {})
                c[s[i]] = c.get(s[i], 0) + 1
    total = 0.0
    for i in range(len(text)):
        for k in range(min(i, order), -1, -1):
            c = counts.get(text[i - k : i])
            if c is None:
                continue
            n, q = sum(c.values()), len(c)
            if text[i] in c:
                total -= math.log2(c[text[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


SAMPLES = {"x": [b"abracadabra", b"banana bread"], "y": ["día mañana sí".encode(), b"sol"], "z": [b"qq"]}


@given(st.lists(st.text(alphabet="abrcdn eíñqz\n", max_size=25), max_size=6))
@settings(max_examples=80, deadline=None)
def test_code_lengths_are_exact(texts):
    model = langid.Model(SAMPLES, 3)
    got = model.bits(*common.blob(pa.array(texts, pa.string())))
    want = np.array([[brute(SAMPLES[x], t.encode(), 3) for x in model.languages] for t in texts]).reshape(len(texts), 3)
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


@given(st.lists(st.integers(0, 2**40), unique=True, max_size=200))
@settings(deadline=None)
def test_lookup(keys):
    keys = np.array(keys, np.uint64)
    find = langid.Lookup(keys)
    assert find(keys).tolist() == list(range(len(keys)))
    other = np.setdiff1d(np.arange(100, dtype=np.uint64), keys)
    assert (find(other) == -1).all()


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1 and n_chars > 60")
    got = {r.doc_id: r.lang_pred for r in langid.identify(held, model).collect()}
    want = {r.doc_id: r.lang for r in held.select("doc_id", "lang").collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_edges(spark, edge, empty):
    model = langid.train(edge)
    assert model.languages == ["de", "en", "fr"]
    got = langid.identify(edge, model)
    assert got.count() == edge.count()
    assert {r.doc_id for r in got.where("lang_pred is null").collect()} == {2, 3, None}
    assert got.where("doc_id = 1").distinct().count() == 1
    assert rows(langid.identify(empty, langid.train(empty))) == []
    assert {r.lang_pred for r in langid.identify(edge, langid.train(empty)).collect()} == {None}
    tie = langid.Model({"b": [b"same"], "a": [b"same"]})
    assert langid.identify(table(spark, [(1, "same", None)]), tie).first().lang_pred == "a"
    assert langid.identify(edge, langid.Model({"a": [b"same"]})).where("margin_bits <> 0").count() == 0


def test_sample_is_bounded(spark):
    docs = table(spark, [(i, f"word{i}", "en") for i in range(30)])
    assert langid.train(docs, sample_docs=3, order=0).cost[0].shape[0] <= 3 * 6
    assert langid.train(docs, sample_bytes=0).languages == []
