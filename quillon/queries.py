"""Queries over the test tables, each with DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import keys, timespan
from quillon.functions.text import STOP_WORDS, blank_out, html_to_text, is_number, leading_count, split_terms, stems, strip_tags, terms, tokens
from quillon.functions.timespan import TimeWindow
from quillon.functions.vectors import cosine, jaccard, set_cosine, sum_squares
from quillon.model import memes, places, posts, table
from quillon.operators import allpairs, counts, graph, indexes, lookup, sequence, sets, similarity
from quillon.operators import terms as term_ops
from quillon.plans.constraints import CellQuery
from quillon.plans.index import IndexSpec, build_all
from quillon.session import spread
from quillon.sources import files, web
from quillon.streaming import clustering, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BOTH = TimeWindow("2024-01-05", "2024-01-20T12:00:00")
LEFT = TimeWindow("2024-01-05", "2024-01-20T12:00:00", "left")
IN_BOTH = "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"
IN_LEFT = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 12:00:00'"
#: Common table expressions that the SQL below begins with.
P = """WITH posts AS (SELECT event_id AS post_id, user_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
memes AS (SELECT '#' || event_type AS key, post_id, user_id, ts FROM posts UNION ALL
          SELECT 'http://k' || k || '.example.com/', post_id, user_id, ts FROM posts WHERE k IS NOT NULL UNION ALL
          SELECT '@' || k, post_id, user_id, ts FROM posts WHERE k IS NOT NULL)"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_NUMBER = r"(regexp_matches({0}, '^0x[0-9a-f]+$') OR NOT regexp_matches(regexp_replace({0}, '[a-f]', '', 'g'), '\p{{L}}'))"
#: Kept terms of documents with their places.
D = rf"""WITH tok AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), 1) AS raw FROM documents),
kept AS MATERIALIZED (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS pos FROM tok WHERE term NOT IN ({_STOP}) AND NOT {_NUMBER.format("term")}),
tf AS (SELECT term, doc_id, count(*) AS freq FROM kept GROUP BY ALL)"""
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.term_frequencies(docs(spark, sf))


# Counts over posts ------------------------------------------------------------------------------------------------------------
@query(P + f" SELECT key, count(DISTINCT post_id) AS n FROM memes WHERE {IN_BOTH} GROUP BY 1")
def meme_post_count(spark, sf):
    return counts.per_key(memes(spark, sf), BOTH)


@query(P + f" SELECT strftime(ts, '%Y-%m-%d') AS date, count(DISTINCT post_id) AS n FROM memes WHERE {IN_LEFT} AND key IN ('#click', '#view') GROUP BY 1")
def meme_timestamp_count(spark, sf):
    return counts.per_day(memes(spark, sf).where(F.col("key").isin("#click", "#view")), LEFT)


@query(P + f" SELECT 'u' || user_id || '(' || user_id || ')' AS \"user\", count(DISTINCT post_id) AS n FROM memes WHERE {IN_BOTH} AND key LIKE '#%' GROUP BY 1")
def user_post_count(spark, sf):
    named = memes(spark, sf).where(F.col("key").startswith("#")).withColumn("name", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return counts.per_user(named, BOTH, "name")


@query(P + f" SELECT strftime(ts, '%Y-%m-%d') AS date, count(DISTINCT post_id) AS n FROM posts WHERE {IN_LEFT} AND user_id = 7 GROUP BY 1")
def user_timestamp_count(spark, sf):
    return counts.per_day(posts(spark, sf).where("user_id = 7"), LEFT)


@query(P + " SELECT user_id, count(*) AS n FROM memes GROUP BY 1")
def user_cell_count(spark, sf):
    return counts.cells_per_user(memes(spark, sf))


@query(P + " SELECT key, count(*) AS n FROM memes WHERE key LIKE '#%' AND post_id IN (SELECT post_id FROM memes WHERE key = '@42') GROUP BY 1")
def cooccur_count(spark, sf):
    m = memes(spark, sf)
    return counts.cooccurring(m, lookup.by_keyword(m, "@42"))


@query(P + " SELECT k AS src, user_id AS dst, count(*) AS n FROM posts WHERE k IS NOT NULL GROUP BY 1, 2")
def mention_edges_in(spark, sf):
    return counts.edges(posts(spark, sf), "in")


@query(P + " SELECT user_id AS src, k AS dst, count(*) AS n FROM posts WHERE k IS NOT NULL GROUP BY 1, 2")
def mention_edges_out(spark, sf):
    return counts.edges(posts(spark, sf), "out")


@query(P + " SELECT user_id AS src, k AS dst, count(*) AS n FROM posts WHERE k IS NOT NULL AND event_type = 'click' GROUP BY 1, 2")
def reshare_edges_out(spark, sf):
    return counts.edges(posts(spark, sf).where("reshared"), "out")


@query(P + " SELECT least(CAST(user_id AS VARCHAR), CAST(k AS VARCHAR)) AS a, greatest(CAST(user_id AS VARCHAR), CAST(k AS VARCHAR)) AS b, count(*) AS n FROM posts WHERE event_type = 'click' AND k IS NOT NULL GROUP BY 1, 2")
def reshare_edges_undirected(spark, sf):
    return counts.undirected_edges(posts(spark, sf).where("reshared"))


@query(P + ", e AS (SELECT user_id AS v, k AS w FROM posts WHERE event_type = 'click' AND k IS NOT NULL AND user_id <> k), b AS (SELECT v, w FROM e UNION SELECT w, v FROM e) SELECT v, array_to_string(list_sort(list(w)), ',') AS neighbours FROM b GROUP BY 1")
def adjacency_sets(spark, sf):
    found = graph.neighbour_sets(posts(spark, sf).where("reshared"), "user_id", "k")
    return found.select("v", F.array_join(F.transform("neighbours", lambda n: n.cast("string")), ",").alias("neighbours"))


@query(P + " SELECT key, strftime(ts, '%Y-%m-%d') AS date, count(*) AS freq FROM memes GROUP BY 1, 2")
def daily_freq(spark, sf):
    return counts.daily(memes(spark, sf))


@query(P + ", r AS (SELECT '#' || event_type AS key, ts, CASE WHEN event_type = 'click' THEN ts - INTERVAL 2 DAY END AS old FROM posts), b AS (SELECT key, ts FROM r UNION ALL SELECT key, old FROM r WHERE old IS NOT NULL) SELECT key, strftime(ts, '%Y-%m-%d') AS date, count(*) AS freq FROM b GROUP BY 1, 2")
def daily_freq_with_originals(spark, sf):
    rows = posts(spark, sf).select(F.concat(F.lit("#"), "event_type").alias("key"), "ts", F.when(F.col("reshared"), F.col("ts") - F.expr("INTERVAL 2 DAYS")).alias("old"))
    return counts.daily_with_originals(rows, "old")


@query(P + ", d AS (SELECT key, strftime(ts, '%Y-%m-%d') AS date, count(*) AS freq FROM memes WHERE key LIKE '#%' GROUP BY 1, 2) SELECT key, string_agg(date || '|' || freq, ' ' ORDER BY date) AS line FROM d GROUP BY 1")
def daily_freq_series(spark, sf):
    return counts.series_text(counts.series(counts.daily(memes(spark, sf).where(F.col("key").startswith("#")))))


@query(P + " SELECT '#' || event_type AS key, strftime(ts, '%Y-%m-%d') AS date, CAST(count(*) AS BIGINT) AS freq FROM posts GROUP BY 1, 2")
def daily_freq_lines(spark, sf):
    d = counts.daily(memes(spark, sf).where(F.col("key").startswith("#")))
    lines = d.select(F.concat_ws("|", F.replace("date", F.lit("-"), F.lit("_")), "key", F.col("freq").cast("string")).alias("value"))
    return counts.read_daily(lines)


@query(P + " SELECT strftime(ts, '%Y-%m-%d %H') AS time, count(*) AS n FROM posts GROUP BY 1")
def time_series_hourly(spark, sf):
    return counts.by_pattern(posts(spark, sf), "yyyy-MM-dd HH")


@query(P + ", l AS (SELECT key, epoch_ms(max(ts)) - epoch_ms(min(ts)) AS span FROM memes GROUP BY 1), f AS (SELECT CASE WHEN span <= 3600000 THEN 1 ELSE CAST(floor(span / 3600000.0) AS BIGINT) + 1 END AS value FROM l) SELECT value, count(*) AS n FROM f GROUP BY 1")
def lifetime_distribution(spark, sf):
    return counts.distribution(counts.lifetimes(memes(spark, sf), 3_600_000), "lifetime")


@query(P + ", u AS (SELECT key, count(DISTINCT user_id) AS users FROM memes WHERE key LIKE '#%' GROUP BY 1) SELECT users AS value, count(*) AS n FROM u GROUP BY 1")
def popularity_distribution(spark, sf):
    return counts.popularity(memes(spark, sf))


@query(P + f", u AS (SELECT user_id, count(*) AS posts FROM posts WHERE {IN_LEFT} GROUP BY 1) SELECT posts AS value, count(*) AS n FROM u GROUP BY 1")
def posts_per_user_distribution(spark, sf):
    return counts.posts_per_user(posts(spark, sf), LEFT)


@query(P + ", h AS (SELECT user_id, k, count(*) AS c FROM posts WHERE k IS NOT NULL GROUP BY 1, 2), t AS (SELECT user_id, sum(c) AS s FROM h GROUP BY 1) SELECT user_id, round(-sum((c / s) * ln(c / s)), 6) AS entropy FROM h JOIN t USING (user_id) GROUP BY 1")
def domain_entropy_by_user(spark, sf):
    found = counts.host_entropy(memes(spark, sf))
    return found.select("user_id", F.round("entropy", 6).alias("entropy"))


@query(P + f""", s AS (SELECT user_id AS u, key FROM memes WHERE {IN_LEFT} AND key LIKE '@%' GROUP BY 1, 2),
seed AS (SELECT u FROM s WHERE key = '@42'), z AS (SELECT key, count(*) AS n, count(*) FILTER (WHERE u IN (SELECT u FROM seed)) AS shared FROM s GROUP BY 1)
SELECT key, CAST(shared AS BIGINT) AS "both", CAST(n AS BIGINT) AS n, round(shared / (n + (SELECT count(*) FROM seed) - shared), 6) AS jaccard FROM z WHERE key <> '@42' AND shared > 0 AND shared / (n + (SELECT count(*) FROM seed) - shared) >= 0.02""")
def related_keys_jaccard(spark, sf):
    # users stand in for posts here: in these tables a post has one key of each kind
    by_user = memes(spark, sf).select("key", F.col("user_id").alias("post_id"), "ts")
    return counts.related(by_user, "@42", 0.02, LEFT, "@").withColumn("jaccard", F.round("jaccard", 6))


@query(P + ", c AS (SELECT key, count(*) AS n FROM memes GROUP BY 1) SELECT key, n FROM c ORDER BY n DESC, key LIMIT 10")
def top_memes(spark, sf):
    return counts.top(memes(spark, sf).groupBy("key").agg(F.count("*").alias("n")), 10, "n", "key")


@query(P + " SELECT key, count(*) AS n FROM memes WHERE starts_with(key, 'http') GROUP BY 1")
def keys_by_prefix(spark, sf):
    return counts.keys_with_prefix(memes(spark, sf), "http")


@query(P + " SELECT key, count(*) AS cells, CAST(sum(strlen(key) + strlen(CAST(user_id AS VARCHAR))) AS BIGINT) AS bytes FROM memes GROUP BY 1")
def index_feature_sizes(spark, sf):
    return counts.key_sizes(memes(spark, sf), "user_id")


@query("SELECT feature, value, count(*) AS n FROM (SELECT 'lang' AS feature, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY 1, 2")
def feature_histogram(spark, sf):
    return counts.histogram(docs(spark, sf), ["lang", "source"])


@query("SELECT p_size AS value, count(*) AS n FROM part GROUP BY 1")
def value_histogram(spark, sf):
    return counts.distribution(table(spark, sf, "part"), "p_size").orderBy(F.col("value").desc())


@query(P + " SELECT CASE WHEN key LIKE '#%' THEN 'hashtag' WHEN key LIKE '@%' THEN 'mention' ELSE 'url' END AS kind, count(DISTINCT key) AS n FROM memes GROUP BY 1")
def keys_by_kind(spark, sf):
    return memes(spark, sf).groupBy(keys.kind(F.col("key")).alias("kind")).agg(F.count_distinct("key").alias("n"))


# Look-ups ---------------------------------------------------------------------------------------------------------------------
@query(P + f" SELECT DISTINCT post_id FROM memes WHERE key IN ('#click', '@42') AND {IN_BOTH}")
def posts_by_keyword_set(spark, sf):
    return lookup.by_keyword(memes(spark, sf), "#Click, @42", BOTH)


@query(P + f" SELECT DISTINCT post_id FROM memes WHERE key IN ('#click', '@42') AND {IN_BOTH}")
def posts_by_key_scan(spark, sf):
    return lookup.scan_keys(posts(spark, sf), ["#Click", "@42"], BOTH)


@query(P + " SELECT DISTINCT post_id FROM memes WHERE regexp_full_match(key, '#(click|sign.*)|@4.')")
def posts_by_pattern_scan(spark, sf):
    return lookup.scan_pattern(posts(spark, sf), "#(click|sign.*)|@4.")


@query(P + " SELECT user_id AS src, k AS dst, count(*) AS n FROM posts WHERE event_type IN ('click', 'view') AND k IS NOT NULL GROUP BY 1, 2")
def mention_network_scan(spark, sf):
    return counts.mention_network(posts(spark, sf), ["#Click", "#view"])


@query(P + " SELECT strftime(ts, '%Y_%m_%d') || '|' || key || '|' || count(*) AS value FROM memes WHERE key LIKE '#%' GROUP BY strftime(ts, '%Y_%m_%d'), key")
def daily_tag_lines(spark, sf):
    return counts.per_file(memes(spark, sf).where(F.col("key").startswith("#")))


@query(P + ", n AS (SELECT user_id AS name FROM posts UNION SELECT k FROM posts WHERE k IS NOT NULL), i AS (SELECT row_number() OVER (ORDER BY name) - 1 AS id, count(*) OVER () AS c FROM n) SELECT CAST(id * 4 // c AS INT) AS part, count(*) AS vertices, CAST(sum(id) AS BIGINT) AS weight FROM i GROUP BY 1")
def plain_split_stats(spark, sf):
    return graph.split_stats(graph.plain_split(graph.number_vertices(posts(spark, sf), "user_id", "k"), 4), "id")


@query(P + " SELECT DISTINCT post_id FROM memes WHERE starts_with(key, '#pu')")
def posts_by_prefix_star(spark, sf):
    return lookup.by_keyword(memes(spark, sf), "#pu*")


@query(P + " SELECT DISTINCT post_id FROM memes WHERE starts_with(key, '@4') AND length(key) <= 3")
def posts_by_prefix_question(spark, sf):
    return lookup.by_keyword(memes(spark, sf), "@4?")


@query(P + " SELECT DISTINCT key AS rowkey FROM memes WHERE starts_with(key, '@4') AND length(key) = 3")
def cell_query_prefix_one(spark, sf):
    return CellQuery.of("rowkey:~@4?~;return:rowkey").run(memes(spark, sf), {"rowkey": "key", "qual": "post_id"})


@query(P + " SELECT DISTINCT post_id AS qual FROM memes WHERE regexp_full_match(key, '#(click|sign.*)')")
def posts_by_regex(spark, sf):
    return CellQuery.of("rowkey:<#(click|sign.*)>;return:qual").run(memes(spark, sf), {"rowkey": "key", "qual": "post_id"})


@query(P + " SELECT DISTINCT post_id AS qual FROM memes WHERE key BETWEEN '#c' AND '#f'")
def posts_by_key_range(spark, sf):
    return CellQuery.of("rowkey:[#c,#f];return:qual").run(memes(spark, sf), {"rowkey": "key", "qual": "post_id"})


@query(P + " SELECT DISTINCT post_id AS qual FROM memes WHERE key = '#view' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 06:00:00.001'")
def cell_query_ts_range(spark, sf):
    return CellQuery.of("rowkey:{#view};ts:[2024-01-10T00:00:00,2024-01-12T06:00:00];return:qual").run(memes(spark, sf), {"rowkey": "key", "qual": "post_id"})


@query(P + " SELECT DISTINCT key AS rowkey FROM memes WHERE CAST(post_id AS VARCHAR) IN ('11', '12', '13')")
def cell_query_return_rowkey(spark, sf):
    return CellQuery.of("qual:{11,12,13};return:rowkey").run(memes(spark, sf), {"rowkey": "key", "qual": "post_id"})


@query(P + " SELECT DISTINCT post_id AS qual FROM memes WHERE key = '@42' AND CAST(user_id AS VARCHAR) BETWEEN '1' AND '5'")
def cell_query_return_qual(spark, sf):
    return CellQuery.of("rowkey:{@42};cellval:[1,5];return:qual").run(memes(spark, sf), {"rowkey": "key", "qual": "post_id", "cellval": "user_id"})


@query(P + " SELECT DISTINCT epoch_us(ts) AS ts FROM memes WHERE key = '@42'")
def cell_query_return_ts(spark, sf):
    return CellQuery.of("rowkey:{@42};return:ts").run(memes(spark, sf), {"rowkey": "key"}).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))


@query(P + " SELECT DISTINCT CAST(user_id AS VARCHAR) AS cellval FROM memes WHERE key >= '@9' AND key <= '@99'")
def cell_query_return_value(spark, sf):
    return CellQuery.of("rowkey:[@9,@99];return:cellval").run(memes(spark, sf), {"rowkey": "key", "cellval": "user_id"}).select(F.col("cellval").cast("string"))


@query(P + " SELECT post_id FROM posts WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def posts_by_time_range(spark, sf):
    return lookup.by_time(posts(spark, sf), "2024-01-10", "2024-01-11")


@query(P + f" SELECT post_id FROM posts WHERE user_id = 7 AND {IN_BOTH}")
def posts_by_user(spark, sf):
    return lookup.by_user(posts(spark, sf), 7, BOTH)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'released under')")
def posts_by_phrase(spark, sf):
    return lookup.by_phrase(docs(spark, sf), "Released under", id_col="doc_id")


_CELLS = ", c AS (SELECT CAST(trunc(CAST(CAST((user_id - 75) * 2.37::DOUBLE AS FLOAT) AS DOUBLE) * 100) AS INT) AS x, CAST(trunc(CAST(CAST((k - 50) * 1.79::DOUBLE AS FLOAT) AS DOUBLE) * 100) AS INT) AS y, post_id FROM posts WHERE k IS NOT NULL)"


@query(P + _CELLS + " SELECT DISTINCT post_id FROM c WHERE x BETWEEN -5000 AND 3000 AND y BETWEEN -2000 AND 4000")
def posts_by_geo_box(spark, sf):
    return lookup.by_box(places(spark, sf), "-5000_-2000", "3000_4000")


@query(P + _CELLS + " SELECT x || '_' || y AS key, count(*) AS n FROM c GROUP BY 1")
def geo_cell_count(spark, sf):
    return places(spark, sf).groupBy("key").agg(F.count("*").alias("n"))


@query(P + " SELECT post_id, event_type, value FROM posts WHERE post_id IN (SELECT post_id FROM memes WHERE key = '@42')")
def fetch_by_index(spark, sf):
    return lookup.fetch(posts(spark, sf), lookup.by_keyword(memes(spark, sf), "@42")).select("post_id", "event_type", "value")


@query(P + f" SELECT DISTINCT post_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM memes WHERE key = '#error' AND {IN_BOTH}")
def post_ids_and_times(spark, sf):
    return lookup.ids_and_times(lookup.within(memes(spark, sf).where("key = '#error'"), BOTH))


@query(P + """, o AS (SELECT post_id, user_id, CASE WHEN event_type = 'click' THEN post_id - k END AS old FROM posts), own AS (SELECT post_id FROM posts WHERE user_id = 7)
SELECT 'post' AS leg, post_id FROM own UNION ALL SELECT 'reshare', post_id FROM o WHERE old IN (SELECT post_id FROM own) UNION ALL SELECT 'mention', post_id FROM posts WHERE k = 7""")
def user_related_posts(spark, sf):
    p = posts(spark, sf).withColumn("reshared_id", F.when(F.col("reshared"), F.col("post_id") - F.col("k")))
    return lookup.user_related(p, p.select("post_id", "target", "ts"), 7)


@query(P + ", o AS (SELECT *, CASE WHEN event_type = 'click' THEN post_id - k END AS old FROM posts) SELECT a.post_id, a.old AS reshared_id, coalesce(b.user_id, -1) AS original_user_id, b.event_type AS original_event_type FROM o a LEFT JOIN posts b ON a.old = b.post_id WHERE a.old IS NOT NULL")
def reshared_posts(spark, sf):
    p = posts(spark, sf).withColumn("reshared_id", F.when(F.col("reshared"), F.col("post_id") - F.col("k")))
    return lookup.only_reshares(lookup.with_reshared(p, ["user_id", "event_type"])).select("post_id", "reshared_id", F.coalesce("original_user_id", F.lit(-1)).alias("original_user_id"), "original_event_type")


@query(P + " SELECT event_type, max_by(user_id, (ts, post_id)) AS user_id FROM posts GROUP BY 1")
def latest_by_name(spark, sf):
    return posts(spark, sf).groupBy("event_type").agg(F.max_by("user_id", F.struct("ts", "post_id")).alias("user_id"))


@query(P + ", l AS (SELECT event_type AS key, max_by(user_id, (ts, post_id)) AS user_id FROM posts GROUP BY 1) SELECT post_id FROM posts WHERE user_id = (SELECT user_id FROM l WHERE key = 'click')")
def posts_by_latest_name(spark, sf):
    p = posts(spark, sf)
    names = p.select(F.col("event_type").alias("key"), "user_id", F.struct("ts", "post_id").alias("ts"))
    return lookup.posts_by_name(names, p, "Click").select("post_id")


@query(P + " SELECT post_id FROM posts ORDER BY ts DESC, post_id DESC LIMIT 25")
def newest_posts(spark, sf):
    return lookup.newest(posts(spark, sf), 25).select("post_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 20")
def rows_from_key(spark, sf):
    return lookup.first_rows(table(spark, sf, "orders"), "o_orderkey", 20, 100).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'")
def id_join(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.where("o_orderpriority = '1-URGENT'").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query(P + " SELECT DISTINCT post_id FROM memes WHERE key IN (SELECT '@' || p_size FROM part WHERE p_size < 5)")
def posts_by_key_table(spark, sf):
    wanted = table(spark, sf, "part").where("p_size < 5").select(F.concat(F.lit("@"), F.col("p_size").cast("string")).alias("key")).distinct()
    return lookup.by_keys(memes(spark, sf), wanted)


@query(P + " SELECT post_id, '{\"event_type\":\"' || event_type || '\",\"user\":{\"user_id\":' || user_id || '}}' AS value FROM posts WHERE user_id = 7")
def json_field_projection(spark, sf):
    nested = posts(spark, sf).where("user_id = 7").select("post_id", "event_type", F.struct("user_id", "k", "value").alias("user"))
    kept = lookup.project(nested, include=["post_id", "event_type", "user"], exclude=["user.k", "user.value"])
    return kept.select("post_id", F.to_json(F.struct("event_type", "user")).alias("value"))


@query(P + " SELECT concat_ws(chr(9), post_id, event_type, user_id) AS value FROM posts")
def table_dump(spark, sf):
    return files.dump(posts(spark, sf), ["post_id", "event_type", "user_id"])


# Indexes ----------------------------------------------------------------------------------------------------------------------
@query("SELECT key, CAST(doc_id AS VARCHAR) AS qual, source AS val FROM (SELECT doc_id, source, unnest(list_distinct(list_filter(" + _TOKENS.format("text") + f", lambda t: t NOT IN ({_STOP})))) AS key FROM documents)")
def index_from_definition(spark, sf):
    spec = IndexSpec("text", "documents", "text", "full-text", "{source}.{rowkey}", "", "{source}.d.source")
    built = build_all([spec], {"documents": docs(spark, sf)}, {"documents": "doc_id"})["text"]
    return built.select("key", F.col("qual").cast("string").alias("qual"), "val")


@query(D + " SELECT term, doc_id, CAST(freq AS BIGINT) AS freq FROM tf")
def term_freq_index(spark, sf):
    return frequencies(spark, sf)


@query(D + " SELECT term, doc_id, string_agg(pos, ',' ORDER BY pos) AS positions FROM kept GROUP BY 1, 2")
def positional_index(spark, sf):
    found = indexes.positions(docs(spark, sf))
    return found.select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(D + " SELECT term, doc_id, CAST(freq AS BIGINT) AS freq FROM tf WHERE doc_id % 7 = 3")
def section_freq_index(spark, sf):
    return indexes.term_frequencies(docs(spark, sf), section=(3, 7))


_PART = rf"""WITH f AS (SELECT p_partkey, 'p_name' AS field, unnest(list_filter({_TOKENS.format("p_name")}, lambda t: t NOT IN ({_STOP}))) AS term FROM part UNION ALL
SELECT p_partkey, 'p_type', unnest(list_filter({_TOKENS.format("p_type")}, lambda t: t NOT IN ({_STOP}))) FROM part UNION ALL
SELECT p_partkey, 'p_brand', lower(trim(p_brand)) FROM part)"""


def _part_index(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.metadata_index(table(spark, sf, "part"), "p_partkey", ["p_name", "p_type"], ["p_brand"])


@query(_PART + " SELECT field, term, p_partkey AS doc_id, count(*) AS freq FROM f GROUP BY ALL")
def metadata_index(spark, sf):
    return _part_index(spark, sf)


@query(_PART + " SELECT field, term, count(DISTINCT p_partkey) AS docs FROM f GROUP BY ALL")
def docs_per_field_term(spark, sf):
    return term_ops.docs_per_term(_part_index(spark, sf), ["field", "term"])


@query(_PART + ", w AS (SELECT (SELECT min(term) FROM f WHERE field = 'p_type') AS a, (SELECT min(term) FROM f WHERE field = 'p_brand') AS b) SELECT doc_id FROM (SELECT p_partkey AS doc_id, count(DISTINCT field) AS k FROM f, w WHERE (field = 'p_type' AND term = a) OR (field = 'p_brand' AND term = b) GROUP BY 1) WHERE k = 2")
def multi_field_and(spark, sf):
    index = _part_index(spark, sf)
    return term_ops.fields_of(index, index.where("field in ('p_type', 'p_brand')").groupBy("field").agg(F.min("term").alias("term")))


@query(r"SELECT term, conv_id AS book, string_agg(turn, ',' ORDER BY turn) AS pages, CAST(sum(c) AS BIGINT) AS freq FROM (SELECT term, conv_id, turn, count(*) AS c FROM (SELECT conv_id, turn, unnest(" + _TOKENS.format("text") + f") AS term FROM conversations) WHERE term NOT IN ({_STOP}) AND NOT {_NUMBER.format('term')} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def page_positions(spark, sf):
    found = indexes.page_positions(table(spark, sf, "conversations"), "conv_id", "turn")
    return found.select("term", "book", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "freq")


# Terms ------------------------------------------------------------------------------------------------------------------------
@query(D + " SELECT term, count(*) AS docs, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(strlen(term) + 8) AS BIGINT) AS bytes FROM tf GROUP BY 1")
def term_stats(spark, sf):
    return term_ops.term_stats(frequencies(spark, sf))


@query(D + " SELECT term, CAST(sum(freq) AS BIGINT) AS hits FROM tf GROUP BY 1 HAVING sum(freq) > 1")
def term_hits_having(spark, sf):
    return term_ops.term_hits(frequencies(spark, sf))


_PAIRS = D + ", nb AS (SELECT term AS t1, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS t2 FROM kept), pf AS (SELECT least(t1, t2) AS t1, greatest(t1, t2) AS t2, sum(CAST(t1 < t2 AS INT)) AS forward, sum(CAST(t1 > t2 AS INT)) AS backward FROM nb WHERE t2 IS NOT NULL AND t1 <> t2 GROUP BY 1, 2 HAVING sum(CAST(t1 < t2 AS INT)) > 0 AND sum(CAST(t1 > t2 AS INT)) > 0)"


@query(_PAIRS + " SELECT t1, t2, CAST(forward AS BIGINT) AS forward, CAST(backward AS BIGINT) AS backward FROM pf")
def pair_freq(spark, sf):
    return term_ops.pair_frequencies(term_ops.neighbours(docs(spark, sf), both_ways=True))


@query(_PAIRS + r""", h AS (SELECT term, sum(freq) AS hits FROM tf GROUP BY 1 HAVING sum(freq) > 1),
s AS (SELECT t1, t2, forward, backward, coalesce(a.hits, 1) AS c1, coalesce(b.hits, 1) AS c2 FROM pf LEFT JOIN h a ON t1 = a.term LEFT JOIN h b ON t2 = b.term WHERE NOT regexp_matches(t1, '[0-9._,:]') AND NOT regexp_matches(t2, '[0-9._,:]'))
SELECT t1, t2, round((forward + backward) / (c1 * c2), 6) AS plus, round(least(forward, backward) / (c1 * c2), 6) AS min_score, round(greatest(forward, backward) / least(forward, backward), 6) AS p FROM s
WHERE least(forward, backward) / (c1 * c2) > 1e-6 AND greatest(forward, backward) > least(forward, backward)""")
def synonym_score(spark, sf):
    d = docs(spark, sf)
    found = term_ops.synonyms(term_ops.pair_frequencies(term_ops.neighbours(d, both_ways=True)), term_ops.term_hits(term_ops.counts_in_pieces(d)))
    return found.select("t1", "t2", *(F.round(c, 6).alias(c) for c in ("plus", "min_score", "p")))


@query(D + " SELECT doc_id FROM tf WHERE term = 'ing' INTERSECT SELECT doc_id FROM tf WHERE term = 'tion'")
def two_word_and(spark, sf):
    return term_ops.both_terms(frequencies(spark, sf), "ing", "tion")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\p{L}])License([^\p{L}]|$)') AND contains(text, 'MIT')")
def whole_word_scan(spark, sf):
    return term_ops.scan_words(docs(spark, sf), "License", "MIT")


@query("SELECT doc_id, lang, source FROM documents WHERE list_has_any(" + _TOKENS.format("text") + ", ['license', 'licensed'])")
def keyword_scan(spark, sf):
    return term_ops.any_term(docs(spark, sf), ["license", "licensed"], ["doc_id", "lang", "source"])


@query("SELECT CAST(doc_id % 10 AS BIGINT) AS section, count(*) AS docs FROM documents GROUP BY 1")
def section_counts(spark, sf):
    return term_ops.sections(docs(spark, sf), 10)


@query(D + " SELECT count(*) AS docs, CAST(sum(freq) AS BIGINT) AS freq FROM tf")
def freq_totals(spark, sf):
    return counts.totals(frequencies(spark, sf), docs="*", freq="freq")


@query("SELECT term, count(*) AS n FROM (SELECT unnest(" + _TOKENS.format("text") + ") AS term FROM documents) GROUP BY 1")
def token_counts(spark, sf):
    return term_ops.token_counts(docs(spark, sf))


@query(r"SELECT word, count(*) AS n FROM (SELECT regexp_replace(unnest(regexp_split_to_array(text, '\s+')), '[^\p{L}\p{N}_]+$', '') AS word FROM conversations) WHERE regexp_matches(word, '^[#@]?[\p{L}\p{N}_]+$') GROUP BY 1")
def word_count(spark, sf):
    return counts.words(table(spark, sf, "conversations"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", strip_tags(F.col("html")).alias("text"))


@query()
def html_text_terms(spark, sf):
    """By a parser, not by patterns, which is what no SQL does."""
    text = spread(table(spark, sf, "pages")).select("page_id", html_to_text("html").alias("text"))
    return text.select("page_id", F.explode(terms(F.col("text"))).alias("term"))


@query(r"""WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS link FROM pages),
f AS (SELECT page_id, CASE WHEN regexp_matches(link, '^https?://') THEN link WHEN link LIKE '/%' THEN host || link END AS url FROM l)
SELECT DISTINCT page_id, regexp_replace(regexp_extract(url, '^(https?://[^/?]+)', 1), ':80$', '') || CASE WHEN regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://[^/?]+', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://[^/?]+', '') END AS url FROM f WHERE url IS NOT NULL""")
def page_links(spark, sf):
    """(page_id, url) of the links of pages."""
    return web.out_links(spread(table(spark, sf, "pages")), "page_id", "url", "html")


@query(r"SELECT host, count(*) AS n FROM (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages) GROUP BY 1")
def hosts(spark, sf):
    return table(spark, sf, "pages").groupBy(keys.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query()
def stemmed_terms(spark, sf):
    """Counts of Porter stems in conversations."""
    s = spread(table(spark, sf, "conversations")).select(F.explode(stems(tokens(F.col("text")))).alias("stem"))
    return s.groupBy("stem").agg(F.count("*").alias("n"))


@query("SELECT term, " + _NUMBER.format("term") + " AS number FROM (SELECT DISTINCT unnest(" + _TOKENS.format("text") + ") AS term FROM documents)")
def number_terms(spark, sf):
    every = docs(spark, sf).select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    return every.select("term", is_number(F.col("term")).alias("number"))


# Sets of ids ------------------------------------------------------------------------------------------------------------------
def _ids(spark: SparkSession, sf: str, *words: str) -> list[DataFrame]:
    return [lookup.by_keyword(memes(spark, sf), w) for w in words]


@query(P + " SELECT post_id FROM memes WHERE key = '#click' UNION SELECT post_id FROM memes WHERE key = '@42'")
def id_union(spark, sf):
    return sets.union(_ids(spark, sf, "#click", "@42"))


@query(P + " SELECT post_id FROM memes WHERE key = '#click' INTERSECT SELECT post_id FROM memes WHERE key = '@42'")
def id_intersect(spark, sf):
    return sets.intersection(_ids(spark, sf, "#click", "@42"))


@query(P + " SELECT post_id FROM memes WHERE key = '#click' EXCEPT SELECT post_id FROM memes WHERE key = '@42'")
def id_except(spark, sf):
    return sets.difference(*_ids(spark, sf, "#click", "@42"), "post_id")


@query(P + " SELECT count(DISTINCT post_id) AS distinct_rows, count(*) - count(DISTINCT post_id) AS repeated_rows FROM memes")
def dup_check(spark, sf):
    return sets.repeats(memes(spark, sf), "post_id")


@query(P + " SELECT DISTINCT key FROM memes WHERE key LIKE '@%'")
def distinct_memes(spark, sf):
    return memes(spark, sf).where(F.col("key").startswith("@")).select("key").distinct()


@query(P + " SELECT user_id FROM posts UNION SELECT k FROM posts WHERE k IS NOT NULL")
def distinct_users(spark, sf):
    return sets.users_of(posts(spark, sf), "k")


@query("WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS o FROM part) SELECT p_partkey, CAST(CASE WHEN o % 8 < 4 THEN o % 8 ELSE 7 - o % 8 END AS INT) AS part FROM r")
def balanced_split(spark, sf):
    return sets.snake(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", 4).select("p_partkey", "part")


@query("WITH r AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS o FROM part), a AS (SELECT p_partkey, p_size, CASE WHEN o % 4 < 2 THEN o % 4 ELSE 3 - o % 4 END AS h FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY p_size DESC, p_partkey) - 1 AS o FROM a) SELECT p_partkey, CAST(h * 2 + CASE WHEN o % 4 < 2 THEN o % 4 ELSE 3 - o % 4 END AS INT) AS part FROM b")
def halved_split(spark, sf):
    """Four balanced parts by halving twice."""
    return sets.halved(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", 2).select("p_partkey", "part")


@query(P + ", n AS (SELECT user_id AS name FROM posts UNION SELECT k FROM posts WHERE k IS NOT NULL) SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM n")
def numbered_users(spark, sf):
    return graph.number_vertices(posts(spark, sf), "user_id", "k")


# Sequences --------------------------------------------------------------------------------------------------------------------
_ISLANDS = P + """, d AS (SELECT key, strftime(ts, '%Y-%m-%d') AS date, count(*) AS freq FROM memes WHERE key LIKE '@%' GROUP BY 1, 2),
g AS (SELECT *, CAST(date AS DATE) - CAST(row_number() OVER (PARTITION BY key ORDER BY date) AS INT) AS grp FROM d)
SELECT key, date_diff('day', CAST(min(date) AS DATE), CAST(max(date) AS DATE)) + 1 AS units, min(date) AS first, max(date) AS last, CAST(sum(freq) AS BIGINT) AS freq FROM g GROUP BY key, grp"""


def _mentions_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return counts.daily(memes(spark, sf).where(F.col("key").startswith("@")))


@query(_ISLANDS)
def consecutive_lifetime(spark, sf):
    return sequence.consecutive(counts.series(_mentions_by_day(spark, sf)))


@query(_ISLANDS)
def consecutive_lifetime_rows(spark, sf):
    return sequence.consecutive_days(_mentions_by_day(spark, sf))


@query(P + ", d AS (SELECT key, CAST(ts AS DATE) AS d, count(*) AS freq FROM memes WHERE key LIKE '@%' GROUP BY 1, 2), s AS (SELECT *, (d - min(d) OVER (PARTITION BY key)) // 7 AS u FROM d) SELECT key, count(DISTINCT u) AS units, max(u) + 1 AS lifespan, count(DISTINCT d) AS days, CAST(sum(freq) AS BIGINT) AS freq FROM s GROUP BY 1")
def total_lifetime(spark, sf):
    return sequence.total_lifetime(_mentions_by_day(spark, sf), 7)


@query("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
def next_turns(spark, sf):
    return sequence.turns(table(spark, sf, "conversations"), "conv_id", "turn", "role")


@query(P + ", c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS ch FROM posts WINDOW w AS (PARTITION BY user_id ORDER BY post_id)), r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY user_id ORDER BY post_id) AS BIGINT) AS run FROM c) SELECT user_id, event_type, run, count(*) AS n FROM r GROUP BY 1, 2, 3")
def runs_of_types(spark, sf):
    return sequence.runs(posts(spark, sf), "user_id", "post_id", "event_type")


# Similarity -------------------------------------------------------------------------------------------------------------------
def _user_targets(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf).where("k is not null").groupBy("user_id", "k").agg(F.count("*").alias("w"))


_COSINE = P + """, v AS (SELECT user_id, k, count(*) AS w FROM posts WHERE k IS NOT NULL GROUP BY 1, 2), nrm AS (SELECT user_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1),
c AS (SELECT a.user_id AS a, b.user_id AS b, sum(a.w * b.w) AS dot FROM v a JOIN v b ON a.k = b.k AND a.user_id < b.user_id GROUP BY 1, 2), cs AS (SELECT a, b, dot / (x.norm * y.norm) AS cosine FROM c JOIN nrm x ON a = x.user_id JOIN nrm y ON b = y.user_id)"""


#: A row for each user of v (user_id, vec): the least user with the same vectors, the pairs (a, b, s) of which it is one, and the best of these.
LINKS = """, cl AS (SELECT user_id, min(user_id) OVER (PARTITION BY vec) AS class_id FROM ({0})), ends AS (SELECT a AS user_id, s FROM ({1}) UNION ALL SELECT b, s FROM ({1}))
SELECT user_id, class_id, count(s) AS links, round(max(s), 6) AS best FROM cl LEFT JOIN ends USING (user_id) GROUP BY 1, 2"""


@query(_COSINE + LINKS.format("SELECT user_id, string_agg(k || ':' || w, ',' ORDER BY k) AS vec FROM v GROUP BY 1", "SELECT a, b, cosine AS s FROM cs"))
def cosine_pairs(spark, sf):
    """Users with their class, how many others share a target, and the cosine of the nearest."""
    return allpairs.links([_user_targets(spark, sf)], "user_id", "k", "w").withColumn("best", F.round("best", 6))


@query(_COSINE + " SELECT CAST(floor(round(cosine, 9) / 0.05) AS BIGINT) AS bucket, count(*) AS n FROM cs GROUP BY 1")
def pairwise_similarity_histogram(spark, sf):
    return allpairs.histogram([_user_targets(spark, sf)], "user_id", "k", "w", 0.05)


@query(P + ", v AS (SELECT DISTINCT user_id, k FROM posts WHERE k IS NOT NULL), z AS (SELECT user_id, count(*) AS n FROM v GROUP BY 1), j AS (SELECT a.user_id AS a, b.user_id AS b, count(*) AS c FROM v a JOIN v b ON a.k = b.k AND a.user_id < b.user_id GROUP BY 1, 2), js AS (SELECT a, b, c / (x.n + y.n - c) AS s FROM j JOIN z x ON a = x.user_id JOIN z y ON b = y.user_id WHERE c / (x.n + y.n - c) >= 0.2)"
       + LINKS.format("SELECT user_id, string_agg(k, ',' ORDER BY k) AS vec FROM v GROUP BY 1", "SELECT a, b, s FROM js"))
def jaccard_pairs(spark, sf):
    """Users with their class, how many others share a fifth of their targets with them, and the overlap of the nearest."""
    return allpairs.links([_user_targets(spark, sf).withColumn("w", F.lit(1))], "user_id", "k", "w", "jaccard", 0.2).withColumn("best", F.round("best", 6))


@query(D + ", df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1) SELECT term, doc_id, round(freq * ln((SELECT count(*) FROM documents) / df), 6) AS tfidf FROM tf JOIN df USING (term)")
def tfidf(spark, sf):
    return similarity.tf_idf(frequencies(spark, sf), docs(spark, sf)).withColumn("tfidf", F.round("tfidf", 6))


@query("SELECT 1.0::DOUBLE AS nmi")
def lfk_nmi(spark, sf):
    """Of a clustering with itself, its names changed."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("cluster"))
    return similarity.lfk_nmi(e, e.withColumn("cluster", F.col("cluster") * 7 + 3)).select(F.round("nmi", 6).alias("nmi"))


_H = "CASE WHEN {0} > 0 THEN -({0}) * ln({0}) ELSE 0 END"


def _nmi_sql() -> str:
    def side(x: str, y: str) -> str:
        h = _H.format
        return f"""SELECT avg(CASE WHEN hx > 0 THEN coalesce(cond, hx) / hx ELSE 0 END) FROM (SELECT cx, any_value(hx) AS hx, min(CASE WHEN h11 + h00 >= h01 + h10 THEN least(hx, greatest(0, h11 + h10 + h01 + h00 - hy)) END) AS cond FROM (
SELECT cx, {h("sx / n")} + {h("1 - sx / n")} AS hx, {h("sy / n")} + {h("1 - sy / n")} AS hy, {h("o / n")} AS h11, {h("(sx - o) / n")} AS h10, {h("(sy - o) / n")} AS h01, {h("greatest(0, 1 - (sx + sy - o) / n)")} AS h00
FROM (SELECT a.c AS cx, any_value(a.s)::DOUBLE AS sx, any_value(b.s)::DOUBLE AS sy, (SELECT count(*) FROM m)::DOUBLE AS n, (SELECT count(*) FROM m WHERE m.{x} = a.c AND m.{y} = b.c)::DOUBLE AS o
FROM (SELECT {x} AS c, count(*) AS s FROM m GROUP BY 1) a, (SELECT {y} AS c, count(*) AS s FROM m GROUP BY 1) b GROUP BY a.c, b.c)) GROUP BY cx)"""

    return f"WITH m AS (SELECT label AS p, vec_id % 7 AS q FROM embeddings) SELECT round(1 - (({side('p', 'q')}) + ({side('q', 'p')})) / 2, 6) AS nmi"


@query(_nmi_sql())
def lfk_nmi_of_two(spark, sf):
    e = table(spark, sf, "embeddings")
    left = e.select(F.col("vec_id").alias("item"), F.col("label").alias("cluster"))
    right = e.select(F.col("vec_id").alias("item"), F.pmod("vec_id", F.lit(7)).alias("cluster"))
    return similarity.lfk_nmi(left, right).select(F.round("nmi", 6).alias("nmi"))


@query("SELECT median(s)::DOUBLE AS p50, quantile_cont(s, 0.9)::DOUBLE AS p90 FROM (SELECT label, count(*) AS s FROM embeddings GROUP BY 1)")
def percentile_cluster_size(spark, sf):
    sizes = similarity.cluster_sizes(table(spark, sf, "embeddings"), "label")
    return similarity.percentiles(sizes, "size", [0.5, 0.9])


@query("SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY 1 ORDER BY size DESC, cluster LIMIT 2")
def largest_two(spark, sf):
    return similarity.largest(table(spark, sf, "embeddings"), 2, "label")


@query(P + ", u AS (SELECT user_id, count(*) AS posts, count(DISTINCT k) AS targets FROM posts GROUP BY 1) SELECT 'posts' AS \"column\", min(posts)::INT AS least, max(posts)::INT AS greatest, round(avg(posts), 6) AS mean FROM u UNION ALL SELECT 'targets', min(targets)::INT, max(targets)::INT, round(avg(targets), 6) FROM u")
def cluster_stats(spark, sf):
    u = posts(spark, sf).groupBy("user_id").agg(F.collect_list("post_id").alias("posts"), F.collect_set("k").alias("targets"))
    return similarity.map_stats(u, ["posts", "targets"]).withColumn("mean", F.round("mean", 6))


@query(P + " SELECT event_type AS type, count(DISTINCT k) AS n FROM posts GROUP BY 1")
def markers_by_type(spark, sf):
    return similarity.distinct_by_type(posts(spark, sf), "event_type", "k")


@query(P + ", u AS (SELECT user_id, k, count(*) AS w FROM posts WHERE user_id IN (1, 2) AND k IS NOT NULL GROUP BY 1, 2), a AS (SELECT * FROM u WHERE user_id = 1), b AS (SELECT * FROM u WHERE user_id = 2) SELECT round((SELECT sum(a.w * b.w) FROM a JOIN b USING (k)) / (sqrt((SELECT sum(w * w) FROM a)) * sqrt((SELECT sum(w * w) FROM b))), 6) AS cosine, (SELECT sum(w * w) FROM a)::DOUBLE AS squares, round((SELECT count(*) FROM a JOIN b USING (k)) / sqrt((SELECT count(*) FROM a) * (SELECT count(*) FROM b)), 6) AS set_cosine, round((SELECT count(*) FROM a JOIN b USING (k)) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b) - (SELECT count(*) FROM a JOIN b USING (k))), 6) AS jaccard")
def vector_functions(spark, sf):
    w = posts(spark, sf).where("user_id in (1, 2) and k is not null").groupBy("user_id", "k").agg(F.count("*").alias("w"))
    m = w.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("m"))
    ab = m.where("user_id = 1").select(F.col("m").alias("a")).crossJoin(m.where("user_id = 2").select(F.col("m").alias("b")))
    a, b, ka, kb = F.col("a"), F.col("b"), F.map_keys("a"), F.map_keys("b")
    both = F.size(F.array_intersect(ka, kb))
    return ab.select(F.round(cosine(a, b), 6).alias("cosine"), sum_squares(a).alias("squares"), F.round(set_cosine(ka, kb), 6).alias("set_cosine"), F.round(jaccard(both, F.size(ka), F.size(kb)), 6).alias("jaccard"))


# Scalar functions -------------------------------------------------------------------------------------------------------------
@query(P + " SELECT post_id, replace(replace('saw ' || '#' || event_type || ' of @' || k, '#' || event_type, repeat(' ', length('#' || event_type))), '@' || k, repeat(' ', length('@' || k))) AS text FROM posts WHERE k IS NOT NULL")
def blanked_text(spark, sf):
    p = posts(spark, sf).where("k is not null")
    tag, name = F.concat(F.lit("#"), "event_type"), F.concat(F.lit("@"), F.col("k").cast("string"))
    return p.select("post_id", blank_out(F.concat(F.lit("saw "), tag, F.lit(" of "), name), F.array(tag, name)).alias("text"))


@query(P + " SELECT strftime(ts, '%Y-%m') AS month, CAST(epoch_ms(ts) // 86400000 AS BIGINT) AS day, count(*) AS n FROM posts GROUP BY 1, 2")
def month_and_day(spark, sf):
    p = posts(spark, sf)
    day = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 86_400_000).cast("bigint")
    return p.groupBy(timespan.month(F.col("ts")).alias("month"), day.alias("day")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_size AS size, CAST(regexp_extract(p_size || '+', '^[0-9]+') AS BIGINT) AS n FROM part")
def leading_counts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_size").alias("size"), leading_count(F.concat(F.col("p_size").cast("string"), F.lit("+"))).alias("n")).distinct()


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: lower(trim(x))), ',') AS parts FROM part")
def split_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(split_terms(F.col("p_name"), " "), ",").alias("parts"))


#: Words with the stems that Porter's paper gives for them, or that its rules leave in the end.
STEMS = (
    "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop "
    "tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit "
    "conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis "
    "hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope "
    "goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust "
    "dependent:depend adoption:adopt communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll"
).split()


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(*s.split(":")) for s in STEMS) + ") v(word, stem)")
def porter_stems(spark, sf):
    words = spark.createDataFrame([(s.split(":")[0],) for s in STEMS], "word string")
    return words.select("word", F.element_at(stems(F.array("word")), 1).alias("stem"))


# Streams ----------------------------------------------------------------------------------------------------------------------
_SLIDING = P + ", w AS (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM posts) SELECT strftime(s, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2"


@query(_SLIDING)
def sliding_window_counts(spark, sf):
    found = windows.counts(posts(spark, sf), "2 days", "1 day", by=("event_type",))
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


@query(_SLIDING)
def stream_vs_batch_windows(spark, sf):
    """The same over a stream of the table's file."""
    schema = table(spark, sf, "events").schema
    stream = windows.read_stream(spark, sf, schema, "parquet", pattern="events.parquet")
    found = windows.drain(windows.counts(stream, "2 days", "1 day", "40 days", ("event_type",)))
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


@query(P + " SELECT strftime(time_bucket(INTERVAL 30 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM posts GROUP BY 1")
def tumbling_step_counts(spark, sf):
    return windows.counts(posts(spark, sf), "30 seconds").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(P + ", g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM posts), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, g")
def session_counts(spark, sf):
    return windows.sessions(posts(spark, sf), "6 hours", "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(P + " SELECT post_id, CAST((epoch_ms(ts) - epoch_ms(TIMESTAMP '2024-01-10')) // 3600000 AS BIGINT) AS step FROM posts WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def replayed_steps(spark, sf):
    return windows.replay(posts(spark, sf), "2024-01-10", 3600, 24).select("post_id", "step")


@query()
def online_clusters(spark, sf):
    """(cluster, step, type, marker) after all days of events, markers being types and targets."""
    p = posts(spark, sf).where("k is not null").withColumn("day", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).cast("long"))
    m = p.select("day", F.explode(F.array(F.struct(F.lit("hashtag").alias("type"), F.col("event_type").alias("marker")), F.struct(F.lit("mention").alias("type"), F.col("k").cast("string").alias("marker")))).alias("m"), "post_id", F.col("user_id").cast("string").alias("user"))
    rows = m.groupBy(F.col("day").alias("step"), "m.type", "m.marker").agg(F.sort_array(F.collect_set("post_id")).alias("posts"), F.sort_array(F.collect_set("user")).alias("diffusion"))
    one = F.map_from_entries(F.transform("diffusion", lambda u: F.struct(u, F.lit(1).cast("bigint"))))
    rows = rows.withColumns({"users": one, "words": F.create_map(F.col("marker"), F.lit(1).cast("bigint"))})
    return clustering.cluster_all(rows, k=10, steps=7, per_batch=5)


@query()
def graph_layout(spark, sf):
    """(v, x, y) of the graph of reshares among a few users."""
    return graph.layout(posts(spark, sf).where("reshared and user_id < 20 and k < 20"), 3, src="user_id", dst="k")
