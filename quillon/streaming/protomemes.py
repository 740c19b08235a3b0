"""Protomemes: what the posts of a step say about one marker - a hashtag, a mentioned user, an address or a phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import STOP_WORDS, analyze, blank_out, stems

SCHEMA = "step long, type string, marker string, posts array<long>, users map<string,long>, words map<string,long>, diffusion array<string>, earliest timestamp, latest timestamp"


def features(posts: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(post_id, user_id, ts, hashtags, mentions, urls, words, phrase, reshared_user) of flat posts.

    words are the stems of the text without its memes; the phrase is all of them in one."""
    e = F.col("entities")
    none = F.array().cast("array<string>")
    text = blank_out(F.col("text"), F.col("memes"))
    rows = posts.select(
        "post_id", "user_id", "ts", F.coalesce(F.transform(e["hashtags"], lambda t: F.lower(t["text"])), none).alias("hashtags"),
        F.coalesce(F.transform(e["user_mentions"], lambda m: m["id"].cast("string")), none).alias("mentions"),
        F.coalesce(F.transform(e["urls"], lambda u: F.coalesce(u["expanded_url"], u["url"])), none).alias("urls"), stems(analyze(text, stop_words)).alias("words"),
        F.col("reshared_user").cast("string").alias("reshared_user"),
    )
    return rows.withColumn("phrase", F.array_join("words", " "))


def markers(without: tuple[str, ...] = ()) -> Column:
    """(type, marker) of a post with features; hashtags of the ground truth are left out."""
    tag = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("marker")))
    tags = F.array_except("hashtags", F.array(*map(F.lit, without))) if without else F.array_distinct("hashtags")
    phrase = F.when(F.col("phrase") != "", F.array(F.col("phrase"))).otherwise(F.array().cast("array<string>"))
    return F.concat(tag("hashtag", tags), tag("mention", F.array_distinct("mentions")), tag("url", F.array_distinct("urls")), tag("phrase", phrase))


def contacts(rows: DataFrame, step: Column) -> DataFrame:
    """(step, user, others): whom a user mentions or reshares within a step, and who mentions or reshares the user."""
    ahead = rows.select(step.alias("step"), F.col("user_id").cast("string").alias("user"), F.explode(F.array_compact(F.array_append("mentions", F.col("reshared_user")))).alias("other")).where("user is not null")
    both = ahead.select("step", F.explode(F.array(F.struct("user", "other"), F.struct(F.col("other").alias("user"), F.col("user").alias("other")))).alias("p"))
    return both.groupBy("step", "p.user").agg(F.collect_set("p.other").alias("others"))


def protomemes(rows: DataFrame, step_seconds: int = 30, without: tuple[str, ...] = ()) -> DataFrame:
    """Protomemes of rows with features, as SCHEMA; diffusion is who wrote of the marker, whom they mention and reshare in that
    step, and who mentions and reshares them, in whatever post.

    Posts meet the contacts of their users before their markers are told apart, so that what is shuffled has a row a post.  One
    aggregate by (marker, user) then tells who wrote how often, and none for those who were only met; words are counted by
    marker before their shuffle."""
    step = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(step_seconds)).cast("long")
    keys = ["step", "type", "marker"]
    marked = rows.select(step.alias("step"), markers(without).alias("ms"), "post_id", F.col("user_id").cast("string").alias("user"), "words", F.col("ts").cast("timestamp").alias("ts"))
    told = lambda table, *columns: table.select("step", F.explode("ms").alias("m"), *columns).select("step", "m.type", "m.marker", *columns)
    whole = told(marked, "post_id", "ts").groupBy(*keys).agg(F.sort_array(F.collect_set("post_id")).alias("posts"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
    counted = told(marked, "words").select(*keys, F.explode("words").alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("n"))
    words = counted.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("w", "n")))).alias("words"))
    met = marked.where("user is not null").select("step", "ms", "user").join(contacts(rows, step), ["step", "user"], "left")
    who = F.concat(F.array(F.struct("user", F.lit(1).alias("n"))), F.coalesce(F.transform("others", lambda u: F.struct(u.alias("user"), F.lit(0).alias("n"))), F.array().cast("array<struct<user:string,n:int>>")))
    seen = told(met.withColumn("who", who), "who").select(*keys, F.explode("who").alias("w")).groupBy(*keys, "w.user").agg(F.sum("w.n").alias("n"))
    people = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("user", "n"))).alias("l"))
    people = people.select(*keys, F.map_from_entries(F.filter("l", lambda u: u["n"] > 0)).alias("users"), F.col("l.user").alias("diffusion"))
    none, nothing = F.array().cast("array<string>"), F.create_map().cast("map<string,bigint>")
    found = whole.join(words, keys, "left").join(people, keys, "left")
    return found.select(*keys, "posts", *(F.coalesce(c, nothing).alias(c) for c in ("users", "words")), F.coalesce("diffusion", none).alias("diffusion"), "earliest", "latest")


def late(rows: DataFrame, window_start: int) -> DataFrame:
    """Protomemes of steps before the window: what a stream drops."""
    return rows.where(F.col("step") < window_start)
