import math
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import keys, text, timespan, vectors
from quillon.functions.timespan import TimeWindow, month_split


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", dict: "map<string,long>"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(values[n])]}" for n in names)).select(column.alias("x")).first().x


def test_months():
    got = month_split("2011-05-07T13:00:03", "2012-10-11T10:33:22")
    assert len(got) == 18 and got[0] == ("2011-05", "2011-05-07T13:00:03", "2011-05-31T23:59:59") and got[-1] == ("2012-10", "2012-10-01T00:00:00", "2012-10-11T10:33:22")
    assert month_split("2012-01-05", "2012-01-05") == [("2012-01", "2012-01-05T00:00:00", "2012-01-05T23:59:59")]


def test_windows(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS ts UNION ALL SELECT timestamp_ntz'2024-01-02 23:59:59.999' UNION ALL SELECT timestamp_ntz'2024-01-03 00:00:00'")
    n = lambda *a: rows.where(TimeWindow(*a).holds(F.col("ts"))).count()
    assert n("2024-01-01", "2024-01-02") == 2 and n("2024-01-01", "2024-01-03", "left") == 2 and n(None, None) == 3 and n("2024-01-03", None) == 1 and n(None, "2024-01-01T00:00:00") == 1
    with pytest.raises(ValueError):
        TimeWindow("2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        TimeWindow("2024-01-01", "2024-01-02", "right")


def test_post_time(spark):
    assert str(one(spark, timespan.post_time(F.col("c")), c="Wed Jun 06 20:07:10 +0000 2012")) == "2012-06-06 20:07:10"
    assert one(spark, timespan.post_time(F.col("c")), c="yesterday") is None


def test_analysis(spark):
    assert one(spark, text.analyze(F.col("t")), t="The Fox, the FOX's 12 dens: été") == ["fox", "fox", "s", "12", "dens", "été"]
    assert one(spark, text.terms(F.col("t"), drop_numbers=True), t="bad cafe 0x1f 12a zebra zebra") == ["zebra"]
    assert one(spark, text.split_terms(F.col("t"), ","), t=" A b , ,C,") == ["a b", "c"]
    assert one(spark, text.blank_out(F.col("t"), F.col("m")), t="x #ab #abc y", m=["#ab", "#abc"]) == "x " + " " * 3 + " " + " " * 4 + " y"
    assert one(spark, text.leading_count(F.col("t")), t="100+") == 100 and one(spark, text.leading_count(F.col("t")), t="many") is None
    assert one(spark, text.whole_word(F.col("t"), "cat"), t="a cat.") and not one(spark, text.whole_word(F.col("t"), "cat"), t="concat cats")
    assert one(spark, text.word_counts_tokens(F.col("t")), t="hi #Tag! @ann: *** a-b end...") == ["hi", "#Tag", "@ann", "end"]
    assert one(spark, text.meme_text(F.col("m")), m=["#a", "@1"]) == "#a\t@1"
    assert "the" in text.language_stop_words(spark)


def test_html(spark):
    page = "<html><!-- no --><body><p> A &amp; b </p><script>x</script><br>c</body>"
    assert one(spark, text.html_to_text("h"), h=page) == "A & b\nx\nc"
    assert one(spark, text.strip_tags(F.col("h")), h="<p>a <b>b</b><!-- x\ny --></p>") == "a b"


@pytest.mark.parametrize(("word", "stem"), re.findall(r"(\w+):(\w+)", "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat conditional:condit valenci:valenc digitizer:digit radicalli:radic vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formaliti:formal sensitiviti:sensit triplicate:triplic formative:form formalize:formal electriciti:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll"))
def test_porter(word, stem):
    assert text.porter(word) == stem


def test_vectors(spark):
    a, b = {"x": 3, "y": 4}, {"y": 2, "z": 1}
    assert one(spark, vectors.sum_squares(F.col("a")), a=a) == 25
    assert abs(one(spark, vectors.cosine(F.col("a"), F.col("b")), a=a, b=b) - 8 / (5 * math.sqrt(5))) < 1e-12
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a={}, b=b) == 0
    assert one(spark, vectors.set_cosine(F.col("a"), F.col("b")), a=["p", "q"], b=["q", "r"]) == 0.5
    assert one(spark, vectors.jaccard(F.lit(1), F.lit(2), F.lit(2)), a="") == pytest.approx(1 / 3) and one(spark, vectors.jaccard(F.lit(0), F.lit(0), F.lit(0)), a="") == 0
    assert one(spark, vectors.plogp(F.lit(0.0)), a="") == 0 and one(spark, vectors.tf_idf(F.lit(2), F.lit(8), F.lit(2)), a="") == pytest.approx(2 * math.log(4))


def test_keys(spark):
    assert one(spark, keys.geo_cell(F.col("x"), F.col("y")), x=-0.019, y=86.539) == "-1_8653"
    assert one(spark, keys.host(F.col("u")), u="http://a.b/c?d") == "a.b" and one(spark, keys.host(F.col("u")), u="http://a b:%%") is None
    assert one(spark, keys.hashtag(F.col("u")), u="ABC") == "#abc" and one(spark, keys.mention(F.col("u")), u=12) == "@12"


def test_ranges_and_hosts():
    assert keys.prefix_range("ab") == ("ab", "ac") and keys.prefix_range("a\U0010ffff") == ("a\U0010ffff", "b") and keys.prefix_range("\U0010ffff") == ("\U0010ffff", None)
    assert keys.expand_hosts("a-[1,3-5],b,c-[10]") == ["a-001", "a-003", "a-004", "a-005", "b", "c-010"]
    with pytest.raises(ValueError):
        keys.expand_hosts("a-[5-3]")
