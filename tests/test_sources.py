import gzip
import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from quillon.operators import lookup
from quillon.plans import index
from quillon.sources import books, files, posts, web
from quillon.store import COMMANDS, Store, run


def user(i, name):
    return {"id": i, "screen_name": name, "created_at": "Mon Jan 02 03:04:05 +0000 2010", "followers_count": 3, "odd_field": 1}


def post(i, text, who, when="Wed Jun 06 20:07:10 +0000 2012", tags=(), names=(), urls=(), **more):
    entities = {"hashtags": [{"text": t} for t in tags], "user_mentions": [{"id": n, "screen_name": f"u{n}"} for n in names], "urls": [{"url": u, "expanded_url": u + "/long"} for u in urls]}
    return {"id": i, "text": text, "created_at": when, "user": who, "entities": entities, **more}


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    a, b, c = user(7, "Ann"), user(8, "Bob"), user(9, "Cy")
    old = post(1, "Wizards brew #Potion now", a, "Fri Jun 01 10:00:00 +0000 2012", ["Potion"])
    lines = [
        old, post(2, "RT wizards brew #Potion now", b, tags=["Potion"], names=[7], retweeted_status=old, retweet_count="100+"), post(3, "a zebra @u8 http://x.y", c, names=[8], urls=["http://x.y"], coordinates={"type": "Point", "coordinates": [-86.53, 39.16]}),
        post(4, "late #potions #cat", a, "Mon Jul 02 00:00:00 +0000 2012", ["potions", "cat"], geo={"type": "Point", "coordinates": [39.16, -86.53]}, in_reply_to_user_id=9), post(2, "again", b),
    ]
    with gzip.open(folder / "a.json.gz", "wt") as f:
        f.write("\n".join([json.dumps(lines[0]), "{broken", json.dumps({"delete": 1}), *map(json.dumps, lines[1:3])]))
    (folder / "b.json").write_text("\n".join(map(json.dumps, lines[3:])))
    (folder / "list.txt").write_text(f"{folder}/a.json.gz\n\n{folder}/b.json\n")
    return folder


@pytest.fixture(scope="module")
def store(spark, feed, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store") / "s"))
    s.load([f"{feed}/a.json.gz", f"{feed}/b.json"])
    return s


def test_flat_posts(spark, feed):
    flat = posts.flatten(posts.read_list(spark, f"{feed}/list.txt"))
    got = {r.post_id: r for r in flat.collect()}
    assert set(got) == {1, 2, 3, 4} and flat.count() == 4
    assert str(got[1].ts) == "2012-06-01 10:00:00" and got[4].month == "2012-07" and got[4].reply_to_user == 9 and got[4].reply_to_post is None
    u = posts.users(flat)
    assert {(r.user_id, r.post_id, r.screen_name) for r in u.collect()} >= {(7, 1, "Ann"), (9, 3, "Cy")}
    assert json.loads(posts.to_json(flat.where("post_id = 3").select("post_id", "lang")).first().value) == {"post_id": 3}
    assert posts.of_hour(flat, 0).count() == 1 and posts.of_hour(flat, 20, "2012-06-06").count() == 2


def test_store(store):
    ids = lambda *a: {r.post_id for r in store.ids(*a).collect()}
    assert ids("meme", "#potion") >= {1} and ids("meme", "#potion*") >= {1, 4} and ids("meme", "@8") == {3} and ids("meme", "http://x.y/long") == {3}
    assert ids("meme", "#potion*", "2012-07-01", "2012-07-31") == {4}
    assert ids("text", "zebra") == {3} and "potion" not in {r.key for r in store.table("index_text").where("post_id = 1").collect()}
    assert ids("box", "-8653_3915:-8652_3916") == {3, 4} and ids("user", "9") == {3} and ids("phrase", "ZEBRA @u8") == {3}
    assert {r.user_id for r in store.get_users_by_name("ANN").collect()} == {7}
    assert rows(store.get_by_query("memes", "rowkey:~#po*~;return:rowkey")) == [("#potion",), ("#potions",)]
    assert {r.post_id for r in store.request("sname:ann").collect()} == {1, 4} and [r.post_id for r in store.request("userId:7;[2012-06-01,2012-06-30]").collect()] == [1]
    with pytest.raises(ValueError):
        store.request("who:7")
    assert rows(store.cooccur_count("#cat")) == [("#cat", 1), ("#potions", 1)]
    assert rows(store.mention_edges("@8")) == [(9, 8, 1)] and rows(store.timestamp_count("meme", "#potions", "2012-07-01", "2012-07-03")) == [("2012-07-02", 1)]
    assert rows(store.user_post_count("text", "zebra")) == [("Cy(9)", 1)]
    found, n = store.get_and_analyze("meme", "#cat", None, None, lambda d: d.select("user_id"), lambda d: d.groupBy("user_id").count())
    assert rows(found) == [(7, 1)] and n.first().n == 1
    kept = store.get("user", "9", None, None, ["post_id", "user.screen_name", "user.id"], ["user.id"])
    assert kept.columns == ["post_id", "user"] and kept.first().user.asDict() == {"screen_name": "Cy"}
    with pytest.raises(ValueError):
        store.get("user", "9", include=["nothing"])
    assert {"posts", "users", "index_memes", "index_names"} <= set(store.tables())
    assert store.read("index_memes", 2, "#p").count() == 2 and store.bounds("posts", "post_id", 2).agg({"n": "sum"}).first()[0] == 4
    plan = store.ids("meme", "#cat", "2012-07-01", "2012-07-31")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_commands(store):
    assert run(store, "meme-post-count", "#cat").first().n == 1 and run(store, "read-table", "posts", "2").count() == 2
    assert len(COMMANDS) >= 27
    with pytest.raises(ValueError):
        run(store, "fly")
    from quillon.__main__ import main

    assert main([store.folder, "meme-post-count", "#cat"]) == 0 and main([store.folder, "list-tables"]) == 0


def test_definitions(spark):
    xml = """<index-configuration><index-config><source-table>t</source-table><source-qualifier>x</source-qualifier><source-value-type>white-spaced-text</source-value-type>
    <index-table>i</index-table><index-qualifier>{source}.{rowkey}</index-qualifier><index-value>{source}.d.y</index-value></index-config>
    <index-config><source-table>t</source-table><indexer-class>lengths</indexer-class></index-config></index-configuration>"""
    index.register("lengths")(lambda d: d.select(F.length("x").cast("string").alias("key"), F.col("id").alias("qual"), F.lit(None).cast("timestamp").alias("ts"), F.lit("c").alias("val")))
    t = spark.createDataFrame([(1, "A b\tC\t\tc", "v"), (2, None, "w")], "id long, x string, y string")
    specs = index.from_xml(xml)
    assert index.from_json(index.to_json(specs)) == specs
    built = index.build_all(specs, {"t": t}, {"t": "id"})
    assert {(r.key, r.qual, r.val) for r in built["i"].collect()} == {("a b", 1, "v"), ("c", 1, "v")} and built["lengths"].count() == 2
    assert set(index.build_all(specs, {"t": t}, {"t": "id"}, only="i")) == {"i"}
    plain = index.IndexSpec("i", "t", "x", "bytes", "constant", "", "{source}.{rowkey}").build(t, "id")
    assert [tuple(r) for r in plain.collect()] == [("A b\tC\t\tc", "constant", None, 1)]
    for bad in (index.IndexSpec("i", "t", "x", "odd"), index.IndexSpec("i", "t", indexer="none"), index.IndexSpec("i", "t", "x", index_qualifier="{source}.a.b.c.d")):
        with pytest.raises(ValueError):
            bad.build(t, "id")
    with pytest.raises(ValueError):
        index.build_all(specs, {}, {})
    with pytest.raises(ValueError):
        index.from_json('[{"bogus": 1}]')


def test_saved_index_skips_files(spark, tmp_path):
    rows_ = spark.createDataFrame([(f"k{i % 50:02}", i) for i in range(500)], "key string, post_id long").withColumn("ts", F.timestamp_millis(F.lit(1_338_000_000_000) + F.col("post_id") * 10_000_000))
    index.save(rows_, str(tmp_path / "i"), files=6)
    again = spark.read.parquet(str(tmp_path / "i"))
    assert again.count() == 500 and len({r.month for r in again.select("month").distinct().collect()}) == 3
    assert files.multi_scan(spark, str(tmp_path / "i"), ["2012-05"]).count() == rows_.where("date_format(ts, 'yyyy-MM') = '2012-05'").count()


def test_lists_and_sinks(spark, tmp_path):
    (tmp_path / "2012-06_ids_0.txt").write_text("12\n13\nx\n\n")
    assert rows(files.read_ids(spark, str(tmp_path))) == [(12, "2012-06"), (13, "2012-06")]
    (tmp_path / "k").mkdir()
    (tmp_path / "k/keys").write_text(", #A b\n\n#c\n#C\n")
    assert rows(files.read_keys(spark, str(tmp_path / "k"))) == [("#ab",), ("#c",)]
    lines = spark.range(100).select(F.col("id").cast("string").alias("value"))
    files.write_rolling(lines.coalesce(1), str(tmp_path / "r"), 30)
    sizes = [len(p.read_text().splitlines()) for p in (tmp_path / "r").glob("part*")]
    assert sum(sizes) == 100 and max(sizes) == 30
    files.write_split(lines, str(tmp_path / "g"), 4)
    assert len(list((tmp_path / "g").glob("*.gz"))) == 4
    files.write_sorted(spark.range(100).withColumn("k", 100 - F.col("id")), str(tmp_path / "s"), "k", 3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100
    files.write_by(spark.range(10).withColumn("life", F.col("id") % 3), str(tmp_path / "b"), "life", "id")
    assert {p.name for p in (tmp_path / "b").glob("life=*")} == {"life=0", "life=1", "life=2"}
    files.write_ids(spark.createDataFrame([(1, "2012-06"), (2, "2012-07")], "post_id long, month string"), str(tmp_path / "w"))
    files.write_tables({"a": lines, "b": lines}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/b")).count() == 100
    assert rows(files.head(lines.withColumn("n", F.lit("x")), 1, n="int")) == [("0", None)]
    assert rows(files.dump(spark.createDataFrame([(1, None)], "a int, b string"))) == [("1\t",)]


WARC = """WARC/0.18\r
WARC-Type: warcinfo\r
Content-Length: 4\r
\r
info\r
\r
WARC/0.18\r
WARC-Type: response\r
WARC-Target-URI: http://A.com:80/x#f\r
WARC-TREC-ID: corpus-en0000-01-00002\r
Content-Length: {n}\r
\r
{body}\r
\r
"""


def test_web_archives(spark, tmp_path):
    body = "HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\njunk<html><a class=q href='/in#x'>I</a><a HREF=\"HTTP://B.org\">o</a><!-- c --> text</html>"
    raw = WARC.replace("{n}", str(len(body))).replace("{body}", body).encode()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw))
    (tmp_path / "b.warc").write_bytes(b"noise\n" + raw)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(raw)[:-20])
    (tmp_path / "empty.warc").write_bytes(b"")
    found = web.read_archive(spark, str(tmp_path))
    kinds = {(r.path.rsplit("/", 1)[1], r.position): r.kind for r in found.collect()}
    assert [kinds[("a.warc.gz", i)] for i in range(4)] == ["warcinfo", "response"] * 2 and kinds[("b.warc", 1)] == "response" and ("c.warc.gz", 0) in kinds
    docs = web.documents(found)
    assert {(r.doc_id, r.text) for r in docs.collect()} == {(100002, "I\no\ntext")} and docs.count() >= 3
    html = web.documents(found, False).first().html
    assert html.startswith("<html>")
    pages = spark.createDataFrame([(1, "http://A.com:80/x#f", html)], "id long, url string, html string")
    assert rows(web.out_links(pages, "id", "url", "html")) == [(1, "http://a.com/in"), (1, "http://b.org/")]
    assert pages.select(web.normal_url(F.col("url"))).first()[0] == "http://a.com/x"
    assert spark.createDataFrame([("corpus-en0000-01-00002",)], "t string").select(web.document_number(F.col("t"))).first()[0] == 100002


def test_books(spark, tmp_path):
    for name, content in (("b1/1.txt", "one"), ("b1/2.txt", "two"), ("b2/1.txt", "uno"), ("b2/x.txt", "no page")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    (tmp_path / "b1/1.tif").write_bytes(b"\0img")
    assert rows(books.read_pages(spark, str(tmp_path))) == [("b1", 1, "one"), ("b1", 2, "two"), ("b2", 1, "uno")]
    assert books.read_images(spark, str(tmp_path)).first().image == b"\0img"
    (tmp_path / "bib.xml").write_text("<all><Bibliography><Title>On x</Title><Authors>N/A</Authors><ISBN>5</ISBN></Bibliography></all>")
    lines = books.triples(books.read_bibliography(spark, str(tmp_path / "bib.xml")).withColumn("no", F.lit(1)), "no")
    assert rows(books.read_triples(lines)) == [("1", "ISBN", "5"), ("1", "Title", "On x")]


def test_loads_are_sorted_and_repeatable(spark, tmp_path):
    """A load of a name that is there takes its place; a key look-up reads few of an index's files and pushes its key."""
    from pyspark.sql import Window

    from quillon import load_queries

    store, json = load_queries.loaded(spark, "/root/testdata/sf0.001")
    folder = str(tmp_path / "again")
    for _ in range(2):
        posts.ingest(posts.read_json(spark, json), folder, "batch-0")
    again = Store(spark, folder)
    assert set(again.tables()) == set(store.tables()) == {"posts", "users", "index_memes", "index_text", "index_places", "index_names", "index_reshares"}
    for name in again.tables():
        assert again.table(name).count() == store.table(name).count()
    memes = again.table("index_memes")
    ranges = memes.groupBy("month", F.col("_metadata.file_path").alias("file")).agg(F.min("key").alias("a"), F.max("key").alias("b"))
    assert ranges.where("b < a").isEmpty()
    later = ranges.withColumn("next", F.lead("a").over(Window.partitionBy("month").orderBy("a")))
    assert later.where("next < b").isEmpty()
    plan = again.ids("meme", "#click", "2024-01-05", "2024-01-06")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,#click)" in plan and "month" in plan.split("PartitionFilters")[1]
    # a phrase goes by the postings of its inner words
    phrase = again.ids("phrase", "near the old tower at")
    assert {r.post_id for r in phrase.collect()} == {r.post_id for r in again.table("posts").where("contains(lower(text), 'near the old tower at')").collect()}
    assert "index_text" in phrase._jdf.queryExecution().executedPlan().toString()
    assert lookup.inner_words("ears the Old-mill 12 near #x bridge s") == ["bridge", "near"]


def test_broken_members_are_passed_over(spark, tmp_path):
    raw = WARC.replace("{n}", "4").replace("{body}", "body").encode()
    good, bad = gzip.compress(raw), bytearray(gzip.compress(raw * 50))
    bad[len(bad) // 2] ^= 0xFF
    (tmp_path / "a.warc.gz").write_bytes(good + bytes(bad) + good + good)
    found = web.read_archive(spark, str(tmp_path)).collect()
    assert [r.kind for r in found][:2] == ["warcinfo", "response"] and [r.kind for r in found][-4:] == ["warcinfo", "response"] * 2 and len(found) >= 6
    assert [r.position for r in found] == list(range(len(found)))


@pytest.mark.parametrize(("link", "want"), [("b.html", "http://a.com/x/b.html"), ("../c?q=1", "http://a.com/c?q=1"), ("./d/./e", "http://a.com/x/d/e"), ("//Other.org/z", "http://other.org/z"), ("/r", "http://a.com/r"), ("?p=2", "http://a.com/x/y.html?p=2"), ("../../../up", "http://a.com/up"), ("mailto:a@b.c", None), ("https://B.org", "https://b.org/"), ("#top", "http://a.com/x/y.html"), ("d/..", "http://a.com/x/")])
def test_links_are_resolved(spark, link, want):
    row = spark.createDataFrame([("http://a.com/x/y.html?s=1#f", link)], "base string, link string")
    assert row.select(web.normal_url(web.resolve(F.col("base"), F.col("link")))).first()[0] == want



def test_a_load_parses_once_and_divides_the_rows_of_a_key(spark, tmp_path):
    lines = [(f'{{"id": {i}, "text": "common word{i % 3}", "created_at": "Mon Jan 01 00:00:00 +0000 2024", "user": {{"id": {i}, "screen_name": "u"}}, "retweeted_status": {{"id": {5000 + i % 7}}}}}',) for i in range(400)]
    spark.createDataFrame(lines, "value string").write.text(f"{tmp_path}/json")
    raw = posts.read_json(spark, f"{tmp_path}/json")
    assert posts.flatten(raw)._jdf.queryExecution().simpleString().count("FileScan json") == 1
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        posts.ingest(raw, f"{tmp_path}/store", "one")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before["spark.sql.adaptive.coalescePartitions.enabled"])
    assert spark.conf.get("spark.sql.shuffle.partitions") == before["spark.sql.shuffle.partitions"]
    assert spark.read.parquet(f"{tmp_path}/store/posts").count() == 407
    text = spark.read.parquet(f"{tmp_path}/store/index_text").where("key = 'common'")
    assert text.count() == 400 and text.select("_metadata.file_path").distinct().count() > 1


def test_bounds_count_a_key_before_they_sort(spark, tmp_path):
    posts.save({"index_x": spark.createDataFrame([(f"k{i % 20:02}", i) for i in range(500)], "key string, post_id long")}, str(tmp_path))
    found = Store(spark, str(tmp_path)).bounds("index_x", "key", 4)
    assert "keys=[part#" in (plan := found._jdf.queryExecution().toString()) and plan.count("HashAggregate") >= 2
    parts = sorted((r["first"], r["last"], r.n) for r in found.collect())
    assert sum(n for *_, n in parts) == 500 and all(a[1] < b[0] for a, b in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize("packed", [True, False])
def test_archives_come_in_pieces(packed):
    """A file of 20 MB, of which no more than a piece and what lies around it is held."""
    import random

    body = random.Random(1).randbytes(50_000).hex()
    raw = WARC.replace("{n}", str(len(body))).replace("{body}", body).encode()
    whole = (gzip.compress(raw, 1) if packed else raw) * 200
    held = []

    def pieces():
        for at in range(0, len(whole), 1 << 17):
            held.append(len(source.held))
            yield whole[at : at + (1 << 17)]

    source = web.Pieces.__new__(web.Pieces)
    source.held = b""
    source.__init__(pieces())
    found = [len(content) for stream in web.streams(source) for _, content in web.records_of(stream)]
    assert found.count(len(body)) == 200 and max(held) < 1 << 20
    assert web.Pieces(iter([b"ab", b"", b"cd"])).find(b"bc", 0) == 1


def test_tables_are_created_without_a_load(spark, sf, monkeypatch):
    from quillon import load_queries

    def none(*_):
        raise AssertionError("loaded")

    monkeypatch.setattr(load_queries, "store_of", none)
    assert rows(load_queries.created_tables(spark, sf)) == [("index_memes", 0, "2024-01,2024-02"), ("posts", 0, "2024-01,2024-02")]


def test_a_folder_is_followed_without_another_load(spark, sf, monkeypatch):
    from quillon import load_queries

    def none(*_):
        raise AssertionError("loaded")

    monkeypatch.setattr(load_queries, "store_of", none)
    assert load_queries.followed_posts(spark, sf).count() > 1000
