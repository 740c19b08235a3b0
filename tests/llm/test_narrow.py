"""Texts aren't shuffled where they needn't be."""

import re

import pytest

from quillon.llm import bpe, decontaminate, langid, licenses, quality, secrets, simhash
from quillon.llm.queries import QUERIES


def shuffles(df):
    return re.findall(r"Exchange (?:hash|range)partitioning[^\n]*", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["op2_langid", "op4_audio", "op5_licenses", "op6_quality", "op10_bpe"])
def test_narrow_queries(spark, sf, name):
    assert shuffles(QUERIES[name](spark, sf)) == []


def test_filters_are_narrow(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    for df in (quality.accepted(docs, None), decontaminate.clean(docs, bench), secrets.redact(docs), simhash.deduplicate(docs), bpe.encode(docs), licenses.scan(docs), langid.identify(docs, langid.Model({"a": [b"x"]}))):
        assert shuffles(df) == []


def test_only_what_is_needed_is_read(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (bpe.encode(docs), licenses.scan(docs), quality.scores(docs, None)):
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in df._jdf.queryExecution().executedPlan().toString()
