import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.plans.constraints import CellQuery, keyword, milliseconds, parse, regex_prefix


@pytest.mark.parametrize("text", ["key:{a}", "rowkey", "rowkey:[a]", "rowkey:[b,a]", "rowkey:~*~", "rowkey:~?~", "rowkey:~a*?~", "rowkey:~ab~", "rowkey:~a*b~", "ts:<1>", "ts:~1*~", "return:cf", "rowkey:{a", "rowkey:", "ts:[5,4]"])
def test_errors(text):
    with pytest.raises(ValueError):
        parse(text)


def test_two_constraints_on_one_target():
    with pytest.raises(ValueError):
        CellQuery.of("rowkey:{a};rowkey:{b}")
    with pytest.raises(ValueError):
        CellQuery.of("return:qual;return:ts")


def test_times():
    assert milliseconds("1970-01-01T00:00:01") == 1000 and milliseconds("-5") == -5 and milliseconds("2012-01-01") == 1325376000000


@pytest.mark.parametrize(("pattern", "prefix"), [("abc", "abc"), ("ab*c", "a"), ("ab+c", "ab"), ("a|b", ""), ("ab(c|d)", ""), ("ab?", "a"), ("a{2}", ""), ("#x.*", "#x"), (".*", ""), ("ab[cd]", "ab"), ("a\\.b", "a")])
def test_prefix_of_a_pattern(pattern, prefix):
    assert regex_prefix(pattern) == prefix


@given(st.text(alphabet="ab*?+.|()[]", max_size=6), st.text(alphabet="ab", max_size=5))
def test_every_match_has_the_prefix(pattern, text):
    try:
        compiled = re.compile(pattern)
    except re.error:
        return
    if compiled.fullmatch(text):
        assert text.startswith(regex_prefix(pattern))


def cells(spark):
    rows = [(k, str(q), t * 1000, str(v)) for k, q, t, v in [("#a", 1, 10, 5), ("#ab", 2, 20, 6), ("#abc", 3, 30, 7), ("@1", 4, 40, 5), ("#b", 1, 50, 9), ("#b", 1, 50, 9)]]
    return spark.createDataFrame(rows, "rowkey string, qual string, ms long, cellval string").withColumn("ts", F.timestamp_millis("ms"))


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("rowkey:{#a,#b};return:rowkey", {"#a", "#b"}), ("rowkey:~#a*~;return:rowkey", {"#a", "#ab", "#abc"}), ("rowkey:~#a?~;return:rowkey", {"#ab"}), ("rowkey:<#a.?>;return:rowkey", {"#a", "#ab"}),
        ("rowkey:<a>;return:rowkey", set()), ("rowkey:[#ab,#b];return:rowkey", {"#ab", "#abc", "#b"}), ("rowkey:[,#ab];return:rowkey", {"#a", "#ab"}), ("rowkey:[#b,];return:rowkey", {"#b", "@1"}),
        ("qual:{1,4};cellval:{5};return:rowkey", {"#a", "@1"}), ("cellval:[6,7];return:qual", {"2", "3"}), ("ts:[20000,30000];return:qual", {"2", "3"}), ("ts:{10000,50000};return:cellval", {"5", "9"}), ("ts:[,1970-01-01T00:00:20];return:qual", {"1", "2"}),
    ],
)
def test_cells(spark, query, want):
    found = [r[0] for r in CellQuery.of(query).run(cells(spark)).collect()]
    assert set(found) == want and len(found) == len(want)


def test_no_return_keeps_the_cells(spark):
    assert CellQuery.of("rowkey:{#b}").run(cells(spark)).count() == 2
    with pytest.raises(ValueError):
        CellQuery.of("cf:{x}").run(cells(spark))


def test_predicates_reach_the_scan(spark, tmp_path):
    cells(spark).write.parquet(str(tmp_path / "i"))
    found = CellQuery.of("rowkey:<#ab.*>;ts:[1000,2000];return:qual").run(spark.read.parquet(str(tmp_path / "i")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(rowkey,#ab)" in plan and "GreaterThanOrEqual(ts" in plan and "cellval" not in plan.split("ReadSchema")[1]


def test_keywords(spark):
    rows = spark.createDataFrame([(k,) for k in ("#a", "#ab", "#abc", "#x")], "key string")
    hits = lambda t: {r.key for r in rows.where(keyword(F.col("key"), t)).collect()}
    assert hits("#A, #x") == {"#a", "#x"} and hits("#a*") == {"#a", "#ab", "#abc"} and hits("#a?") == {"#a", "#ab"} and hits(" , ") == set()


def test_patterns_match_whole_values(spark):
    """Not short of a last newline; Java's patterns, whatever Python makes of them."""
    keys = spark.createDataFrame([("abc",), ("abc\n",), ("Xé",)], "rowkey string")
    assert [r[0] for r in CellQuery.of("rowkey:<abc>").run(keys).collect()] == ["abc"]
    assert [r[0] for r in CellQuery.of(r"rowkey:<\P{Ll}\p{L}>").run(keys).collect()] == ["Xé"]
    with pytest.raises(ValueError):
        CellQuery.of("rowkey:<(>")

