"""Plans: what reaches the scan, what is shuffled, and that indexes and scans agree."""

import random
import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from quillon import queries
from quillon.operators import indexes, lookup
from quillon.session import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan(df)))


@pytest.mark.parametrize(("name", "columns", "filters"), [
    ("posts_by_user", {"event_id", "user_id", "ts"}, ["EqualTo(user_id,7)", "GreaterThanOrEqual(ts"]),
    ("posts_by_time_range", {"event_id", "ts"}, ["GreaterThanOrEqual(ts", "LessThan(ts"]),
    ("user_timestamp_count", None, ["EqualTo(user_id,7)"]),
    ("rows_from_key", {"o_orderkey", "o_totalprice"}, ["GreaterThanOrEqual(o_orderkey,100)"]),
    ("posts_by_phrase", {"doc_id", "text"}, []),
    ("section_counts", {"doc_id"}, []),
])
def test_scans(spark, sf, name, columns, filters):
    text = plan(queries.QUERIES[name](spark, sf))
    if columns:
        assert set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)>", text).group(1))) == columns
    for f in filters:
        assert f in text


@pytest.mark.parametrize(("name", "most"), [("mention_edges_out", 1), ("daily_freq", 1), ("posts_by_user", 0), ("posts_by_time_range", 0), ("whole_word_scan", 0), ("html_text", 0), ("top_memes", 1), ("feature_histogram", 1), ("positional_index", 1), ("pair_freq", 1)])
def test_shuffles(spark, sf, name, most):
    assert exchanges(queries.QUERIES[name](spark, sf)) <= most


def test_top_needs_no_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan(queries.QUERIES["top_memes"](spark, sf)) and "TakeOrderedAndProject" in plan(queries.QUERIES["newest_posts"](spark, sf))


def test_spread_leaves_wide_tables_alone(spark, tmp_path):
    spark.range(1000).repartition(16).write.parquet(str(tmp_path / "wide"))
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "narrow"))
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")
    try:
        wide, narrow = (spark.read.parquet(str(tmp_path / t)) for t in ("wide", "narrow"))
        assert "Exchange" not in plan(spread(wide)) and "RoundRobin" in plan(spread(narrow)) and spread(narrow).count() == 1000
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_indexes_and_scans_agree(spark):
    r = random.Random(11)
    pool = [f"#{a}{b}" for a in "abc" for b in "xy"] + [f"@{i}" for i in range(5)]
    data = [(i, r.randint(1, 9), sorted(set(r.choices(pool, k=r.randint(0, 5)))), r.randint(0, 10**6)) for i in range(200)]
    posts = spark.createDataFrame(data, "post_id long, user_id long, memes array<string>, s long").withColumn("ts", F.timestamp_seconds("s"))
    index = indexes.meme_index(posts)
    for _ in range(8):
        wanted = r.choices(pool, k=2)
        assert rows(lookup.by_keyword(index, " ".join(wanted))) == rows(lookup.scan_keys(posts, wanted))
    for keyword, pattern in (("#a*", "#a.*"), ("#b?", "#b.?"), ("@*", "@.*"), ("none", "none")):
        assert rows(lookup.by_keyword(index, keyword)) == rows(lookup.scan_pattern(posts, pattern))
