import random
from pathlib import Path

import numpy as np
from conftest_llm import prose, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bpe
from quillon.llm.queries import QUERIES

RANKS = Path(bpe.VOCABULARY).read_bytes()
SMALL = bpe.Codec(RANKS, leaf=12, window=1)
PLAIN = bpe.Codec(RANKS)


def whole(text):
    return PLAIN.bpe.encode_ordinary(text)


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sltdrevm.,!?aàé中文0123-_ 　🙂ing the"), st.characters(exclude_categories=["Cs"])), max_size=120), max_size=4))
@settings(max_examples=400, deadline=None)
def test_trees_give_the_whole_encoding(texts):
    got = SMALL.encode([t.encode() for t in texts], threads=2)
    assert [t.tolist() for t in got] == [whole(t) for t in texts]


@given(st.text(alphabet="abcdeingthé中", min_size=1, max_size=300))
@settings(max_examples=200, deadline=None)
def test_unsplit_pieces(text):
    got = SMALL.encode([text.encode()], threads=1)[0]
    assert got.tolist() == whole(text)
    assert SMALL.decode(got).tobytes().decode() == text


def test_long_texts():
    r = random.Random(1)
    texts = [
        "a" * 30_000, "ab" * 20_000, "".join(r.choices("abcdefghij", k=40_000)), "中" * 12_000, " " * 30_000, "\n \n" * 9000, "'" * 20_000 + "'s" * 9000, prose(1, 20_000),
        prose(2, 3000).replace(" ", ""), "x" * 9000 + " " + "y1" * 9000 + " " * 9000, "=" * 17_000 + "-" * 17_000, "　".join(["wort"] * 6000),
    ]
    codec = bpe.Codec(RANKS)
    for t, got in zip(texts, codec.encode([t.encode() for t in texts]), strict=True):
        assert got.tolist() == whole(t), t[:20]
        assert codec.decode(got).tobytes().decode() == t
    assert codec.joins > 50


def test_windows_grow():
    codec = bpe.Codec(RANKS, leaf=64, window=1)
    text = "ing" * 400
    assert codec.encode([text.encode()])[0].tolist() == whole(text) and codec.joins > 10


def test_edges(spark, edge, empty):
    got = {(r.doc_id, r.n_tokens, tuple(r.tokens) if r.tokens is not None else None, r.round_trip) for r in bpe.encode(edge).collect()}
    want = {(r.doc_id, *((None, None, None) if r.text is None else (len(whole(r.text)), tuple(whole(r.text)), True))) for r in edge.collect()}
    assert got == want
    back = bpe.decode(bpe.encode(edge))
    assert rows(back) == rows(edge.select("doc_id", "text"))
    assert rows(bpe.encode(empty)) == [] and rows(bpe.decode(bpe.encode(empty))) == []
    odd = spark.createDataFrame([(1, [None, 64, 65]), (2, [200]), (3, None), (4, [])], "doc_id long, tokens array<int>")
    assert [r.text for r in bpe.decode(odd).orderBy("doc_id").collect()] == ["ab", SMALL.decode(np.array([200])).tobytes().decode(errors="replace"), None, ""]


def test_other_vocabulary(spark):
    other = bpe.VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    docs = table(spark, [(i, prose(i, 2000) + " señor über", "en") for i in range(3)])
    codec = bpe.Codec(Path(other).read_bytes())
    for r in bpe.encode(docs, vocabulary=other, leaf=100).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.tokens == codec.bpe.encode_ordinary(r.text) and r.round_trip


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i].tokens == whole(t) and got[i].n_tokens == len(got[i].tokens) and got[i].round_trip
