"""Counts over posts and indexes: by key, day, user, pair; distributions, lifetimes and entropies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import keys, timespan
from quillon.functions.text import word_counts_tokens
from quillon.functions.timespan import TimeWindow
from quillon.functions.vectors import plogp
from quillon.operators.lookup import within


def per_day(index: DataFrame, window: TimeWindow | None = None) -> DataFrame:
    """(date, n): posts a day, each post once whatever keys it has."""
    return within(index, window).groupBy(timespan.day(F.col("ts")).alias("date")).agg(F.count_distinct("post_id").alias("n"))


def per_key(index: DataFrame, window: TimeWindow | None = None) -> DataFrame:
    """(key, n): posts of each key."""
    return within(index, window).select("key", "post_id").distinct().groupBy("key").agg(F.count("*").alias("n"))


def per_user(index: DataFrame, window: TimeWindow | None = None, name: str | None = None) -> DataFrame:
    """(user, n): posts of each user, from the index alone.  With a column of names, the user is ``name(id)``."""
    user = F.col("user_id").cast("string") if name is None else F.concat(F.col(name), F.lit("("), F.col("user_id").cast("string"), F.lit(")"))
    return within(index, window).select(user.alias("user"), "post_id").distinct().groupBy("user").agg(F.count("*").alias("n"))


def cells_per_user(index: DataFrame, window: TimeWindow | None = None) -> DataFrame:
    """(user_id, n): index rows of each user; a post with several keys counts for each."""
    return within(index, window).groupBy("user_id").agg(F.count("*").alias("n"))


def cooccurring(index: DataFrame, ids: DataFrame, prefix: str = "#") -> DataFrame:
    """(key, n): hashtags of the posts with the ids, the one sought among them."""
    return index.where(F.col("key").startswith(prefix)).join(ids, "post_id", "left_semi").groupBy("key").agg(F.count("*").alias("n"))


def edges(links: DataFrame, direction: str = "out", source: str = "user_id", target: str = "target") -> DataFrame:
    """(src, dst, n): how often one user reshared or mentioned another.  "out" goes from who acts, "in" from who is meant."""
    a, b = (source, target) if direction == "out" else (target, source)
    if direction not in ("in", "out"):
        raise ValueError(f"no direction is called {direction!r}")
    return links.where(F.col(target).isNotNull()).groupBy(F.col(a).alias("src"), F.col(b).alias("dst")).agg(F.count("*").alias("n"))


def undirected_edges(links: DataFrame, source: str = "user_id", target: str = "target") -> DataFrame:
    """(a, b, n): without direction; a comes before b as text."""
    s, t = F.col(source).cast("string"), F.col(target).cast("string")
    return links.where(t.isNotNull()).groupBy(F.least(s, t).alias("a"), F.greatest(s, t).alias("b")).agg(F.count("*").alias("n"))


def mention_network(posts: DataFrame, wanted: list[str], window: TimeWindow | None = None, memes: str = "memes") -> DataFrame:
    """(src, dst, n): who mentions whom in posts with one of the keys, by a scan; a post counts once however many of them it has."""
    hit = F.arrays_overlap(memes, F.array(*(F.lit(w.lower()) for w in wanted)))
    named = F.explode(F.transform(F.filter(memes, lambda m: m.startswith("@")), lambda m: F.substring(m, 2, 30).try_cast("bigint")))
    return within(posts, window).where(hit).select(F.col("user_id").alias("src"), named.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


def per_file(rows: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """(value): ``date|key|n`` lines, the dates with ``_``: what daily_lines reads."""
    n = rows.groupBy(F.date_format(ts, "yyyy_MM_dd").alias("date"), key).agg(F.count("*").alias("n"))
    return n.select(F.concat_ws("|", "date", key, F.col("n").cast("string")).alias("value"))


def daily(index: DataFrame, window: TimeWindow | None = None) -> DataFrame:
    """(key, date, freq)."""
    return within(index, window).groupBy("key", timespan.day(F.col("ts")).alias("date")).agg(F.count("*").alias("freq"))


def daily_with_originals(posts: DataFrame, original_ts: str) -> DataFrame:
    """(key, date, freq) where a reshare counts on its own day and on the day of what it reshares."""
    own = posts.select("key", timespan.day(F.col("ts")).alias("date"))
    other = posts.where(F.col(original_ts).isNotNull()).select("key", timespan.day(F.col(original_ts)).alias("date"))
    return own.unionByName(other).groupBy("key", "date").agg(F.count("*").alias("freq"))


def series(frequencies: DataFrame) -> DataFrame:
    """(key, series): (date, freq) of each key in order of dates; equal dates are summed."""
    summed = frequencies.groupBy("key", "date").agg(F.sum("freq").alias("freq"))
    return summed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("date", "freq"))).alias("series"))


def series_text(rows: DataFrame) -> DataFrame:
    """(key, line): ``date|freq`` between blanks."""
    line = F.array_join(F.transform("series", lambda s: F.concat_ws("|", s["date"], s["freq"].cast("string"))), " ")
    return rows.select("key", line.alias("line"))


def read_daily(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, date, freq) from lines ``date|key|freq``, dates with ``_`` or ``-``; what isn't such a line is left out."""
    part = F.split(column, r"\|")
    rows = lines.where(F.size(part) == 3).select(F.get(part, F.lit(1)).alias("key"), F.replace(F.get(part, F.lit(0)), F.lit("_"), F.lit("-")).alias("date"), F.get(part, F.lit(2)).try_cast("long").alias("freq"))
    return rows.where("freq is not null")


def by_pattern(rows: DataFrame, pattern: str = "yyyy-MM-dd", ts: str = "ts") -> DataFrame:
    """(time, n): rows by a date pattern."""
    return rows.groupBy(F.date_format(ts, pattern).alias("time")).agg(F.count("*").alias("n"))


def words(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, n) of post texts."""
    return texts.select(F.explode(word_counts_tokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def lifetimes(index: DataFrame, unit_ms: int) -> DataFrame:
    """(key, lifetime): units from a key's first to its last post; 1 up to a unit, then one more than the whole units."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    span = F.max(ms) - F.min(ms)
    found = index.groupBy("key").agg(span.alias("span"))
    return found.select("key", F.when(F.col("span") <= unit_ms, F.lit(1)).otherwise(F.floor(F.col("span") / unit_ms) + 1).cast("long").alias("lifetime"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """(value, n): how many rows have each value."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def popularity(index: DataFrame, prefix: str = "#") -> DataFrame:
    """(value, n): how many hashtags have so many distinct users."""
    per = index.where(F.col("key").startswith(prefix)).groupBy("key").agg(F.count_distinct("user_id").alias("users"))
    return distribution(per, "users")


def posts_per_user(posts: DataFrame, window: TimeWindow | None = None) -> DataFrame:
    """(value, n): how many users have so many posts."""
    return distribution(within(posts, window).groupBy("user_id").agg(F.count("*").alias("posts")), "posts")


def host_entropy(index: DataFrame) -> DataFrame:
    """(user_id, entropy): in nats, of the hosts of the addresses that a user posted."""
    hosts = index.where(keys.kind(F.col("key")) == "url").select("user_id", keys.host(F.col("key")).alias("host")).where("host is not null")
    return entropy(hosts, "user_id", "host")


def entropy(rows: DataFrame, by: str, what: str) -> DataFrame:
    """(by, entropy): -sum p ln p = ln N - sum n ln n / N, from two partial aggregates and no join."""
    n = rows.groupBy(by, what).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("entropy"))


def entropy_of(probabilities: Column) -> Column:
    """Of an array of probabilities."""
    return F.aggregate(F.transform(probabilities, plogp), F.lit(0.0), lambda s, x: s + x)


def keys_with_prefix(index: DataFrame, prefix: str) -> DataFrame:
    return index.where(F.col("key").startswith(prefix)).groupBy("key").agg(F.count("*").alias("n"))


def key_sizes(index: DataFrame, value: Column | str) -> DataFrame:
    """(key, cells, bytes): index rows of each key and the bytes of their keys and values."""
    v = F.col(value) if isinstance(value, str) else value
    size = F.octet_length("key") + F.coalesce(F.octet_length(v.cast("string")), F.lit(0))
    return index.groupBy("key").agg(F.count("*").alias("cells"), F.sum(size.cast("long")).alias("bytes"))


def histogram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n): a histogram of each column from one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).groupBy("p.feature", "p.value").agg(F.count("*").alias("n"))


def top(rows: DataFrame, n: int, by: str, ties: str) -> DataFrame:
    """The n rows with the greatest values; ties in order of another column."""
    return rows.orderBy(F.col(by).desc(), F.col(ties)).limit(n)


def totals(rows: DataFrame, **columns: str) -> DataFrame:
    """One row: sums, named by keyword; counts with ``"*"``."""
    return rows.agg(*((F.count("*") if c == "*" else F.sum(c)).alias(name) for name, c in columns.items()))


def related(index: DataFrame, seed: str, threshold: float, window: TimeWindow | None = None, prefix: str = "#") -> DataFrame:
    """(key, both, n, jaccard) of the hashtags whose posts overlap those of a seed by the threshold or more.

    Distinct (key, post) pairs meet the seed's posts in one left join; both counts come from one aggregate."""
    pairs = within(index, window).where(F.col("key").startswith(prefix)).select("key", "post_id").distinct()
    seeds = pairs.where(F.col("key") == seed.lower()).select("post_id", F.lit(1).alias("hit"))
    sizes = pairs.join(seeds, "post_id", "left").groupBy("key").agg(F.count("hit").alias("both"), F.count("*").alias("n"))
    total = seeds.agg(F.count("*").alias("total"))
    found = sizes.where(F.col("both") > 0).crossJoin(F.broadcast(total))  # one row
    coefficient = F.col("both") / (F.col("n") + F.col("total") - F.col("both"))
    return found.where(F.col("key") != seed.lower()).select("key", "both", "n", coefficient.alias("jaccard")).where(F.col("jaccard") >= threshold)


def related_scan(posts: DataFrame, seed: str, threshold: float, window: TimeWindow | None = None, prefix: str = "", memes: str = "memes") -> DataFrame:
    """The same without an index: the keys of posts themselves."""
    return related(posts.select(F.explode(memes).alias("key"), "post_id", "ts"), seed, threshold, window, prefix)
