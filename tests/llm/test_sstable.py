import random

import numpy as np
import pytest
from conftest_llm import prose, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import types as T

from quillon.llm import sstable


def write(tmp_path, entries):
    w = sstable.Writer(fs.LocalFileSystem(), f"{tmp_path}/s.sst")
    for k, v in entries:
        w.add(k, v)
    return w.close(), sstable.Reader(fs.LocalFileSystem(), f"{tmp_path}/s.sst")


def test_shard_round_trip(tmp_path):
    r = random.Random(1)
    keys = sorted(r.choice([r.randint(-(2**63), 2**63 - 1), r.randint(-50, 50)]) for _ in range(3000))
    entries = [(k, prose(i, r.choice([0, 5, 60])).encode()) for i, k in enumerate(keys)]
    (first, last, n, blocks, _), reader = write(tmp_path, entries)
    assert (first, last, n) == (keys[0], keys[-1], 3000) and blocks > 5 and len(reader.index) == blocks
    want = {}
    for k, v in entries:
        want.setdefault(k, []).append(v)
    for k, v in want.items():
        assert reader.get(k) == v
    absent = np.array([k for k in range(10**6, 10**6 + 4000) if k not in want])
    assert all(reader.get(int(k)) == [] for k in absent[:50])
    assert reader.maybe(np.array(list(want))).all() and reader.maybe(absent).mean() < 0.03


def test_one_key_over_many_blocks(tmp_path):
    big = [(7, b"x" * 40_000 + bytes([i])) for i in range(9)]
    _, reader = write(tmp_path, [(1, b"a"), *big, (9, b"b")])
    assert reader.get(7) == [v for _, v in big] and reader.get(9) == [b"b"] and reader.get(8) == []


def test_keys_share_prefixes(tmp_path):
    (_, _, _, _, size), _ = write(tmp_path, [(k, b"") for k in range(5000)])
    assert size < 5000 * 8  # blocks, index and filter together are smaller than the bare keys


def test_foreign_file(tmp_path):
    (tmp_path / "x").write_bytes(b"0" * 100)
    with pytest.raises(ValueError):
        sstable.Reader(fs.LocalFileSystem(), str(tmp_path / "x"))


@given(st.lists(st.one_of(st.none(), st.binary(max_size=9)), max_size=5))
@settings(deadline=None)
def test_values(columns):
    assert sstable.unpack(sstable.pack(columns), len(columns)) == columns


COLUMNS = ["text", "lang", "source", "n_chars", "id", "k", "v0"]


def test_edges(edge, empty):
    got = sstable.round_trip(edge, "doc_id", COLUMNS, shard_bytes=50_000)
    assert got.columns == ["doc_id", *COLUMNS]
    assert rows(got) == rows(edge.where("doc_id is not null").select("doc_id", *COLUMNS))
    assert rows(sstable.round_trip(empty, "doc_id", COLUMNS)) == []


def test_ties_over_shards(spark, tmp_path):
    docs = table(spark, [(5, prose(i, 300), "en") for i in range(40)] + [(i, "t", "en") for i in range(40)])
    manifest = sstable.write_shards(docs, str(tmp_path), "doc_id", ["text"], shard_bytes=2000)
    assert manifest.agg({"entries": "sum"}).first()[0] == 80
    got = sstable.look_up(spark.createDataFrame([(5,), (99,), (None,), (5,)], "doc_id long"), str(tmp_path), "doc_id", T.StructType([docs.schema["text"]]))
    assert rows(got) == rows(docs.where("doc_id = 5").select("doc_id", "text"))
