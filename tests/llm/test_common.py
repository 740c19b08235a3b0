import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import common


@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=8), st.integers(0, 4))
@settings(max_examples=60, deadline=None)
def test_blob(texts, skip):
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    data, offsets = common.blob(column)
    got = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [(t or "").encode() for t in column.to_pylist()]


@given(st.lists(st.integers(0, 50), max_size=30), st.integers(1, 60))
def test_chunks_cover_rows(sizes, size):
    offsets = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    at = 0
    for a, b in common.chunks(offsets, size):
        assert a == at and b > a
        assert b == a + 1 or offsets[b] - offsets[a] <= size
        at = b
    assert at == len(sizes)


def test_words_and_hashes():
    texts = ["Ab, cd", "", "ab", "é1 x"]
    data, offsets = common.blob(pa.array(texts))
    starts, ends, row = common.words(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["Ab", "cd", "ab", "é1", "x"]
    assert row.tolist() == [0, 0, 2, 3, 3]
    h = common.span_hashes(common.LOWER[data], starts, ends)
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if find(x) != x}
    got = {r.node: r.root for r in common.components(spark.createDataFrame([*edges, (None, 4)], "a long, b long")).collect()}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_folder(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    kept = common.written(spark.range(5))
    assert kept.count() == 5
    with pytest.raises(RuntimeError):
        common.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), most=1)
