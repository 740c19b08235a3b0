"""Schemas of posts and users, and the tables of the test data seen as posts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_USER = (
    "id bigint, screen_name string, name string, created_at string, description string, location string, url string, lang string, time_zone string, utc_offset int, "
    "followers_count bigint, friends_count bigint, statuses_count bigint, favourites_count bigint, listed_count bigint, verified boolean, protected boolean, geo_enabled boolean, "
    "contributors_enabled boolean, default_profile boolean, default_profile_image boolean, profile_image_url string, profile_image_url_https string, profile_background_color string, "
    "profile_background_image_url string, profile_background_tile boolean, profile_link_color string, profile_sidebar_border_color string, profile_sidebar_fill_color string, "
    "profile_text_color string, profile_use_background_image boolean, is_translator boolean, following boolean, follow_request_sent boolean, notifications boolean"
)
_ENTITIES = "user_mentions array<struct<id:bigint,screen_name:string,indices:array<int>>>, hashtags array<struct<text:string,indices:array<int>>>, urls array<struct<url:string,expanded_url:string,indices:array<int>>>, media array<struct<url:string,media_url:string,indices:array<int>>>"
_POST = (
    "id bigint, text string, created_at string, source string, truncated boolean, favorited boolean, retweeted boolean, retweet_count string, in_reply_to_status_id bigint, "
    "in_reply_to_user_id bigint, in_reply_to_screen_name string, lang string, possibly_sensitive boolean, coordinates struct<type:string,coordinates:array<double>>, "
    "geo struct<type:string,coordinates:array<double>>, place string, contributors string"
)


@lru_cache(1)
def post_schema() -> T.StructType:
    """A post as it comes; one that it reshares is nested one level deep."""
    one = T.StructType.fromDDL(_POST).add("entities", T.StructType.fromDDL(_ENTITIES)).add("user", T.StructType.fromDDL(_USER))
    return T.StructType([*one.fields, T.StructField("retweeted_status", one), T.StructField("_corrupt", T.StringType())])


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as posts: (post_id, user_id, ts, month, event_type, value, k, memes, target, reshared_by_click).

    A post's memes are its type as hashtag, an address made of k, and the mention of user k."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = e.select(F.col("event_id").alias("post_id"), "user_id", "ts", "event_type", "value", k.alias("k"))
    url = F.concat(F.lit("http://k"), F.col("k").cast("string"), F.lit(".example.com/"))
    memes = F.filter(F.array(F.concat(F.lit("#"), "event_type"), url, F.concat(F.lit("@"), F.col("k").cast("string"))), lambda m: m.isNotNull())
    return rows.withColumns({"memes": memes, "target": F.col("k"), "reshared": F.col("event_type") == "click"})


def memes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, post_id, user_id, ts): the index of memes of posts."""
    return posts(spark, sf_dir).select(F.explode("memes").alias("key"), "post_id", "user_id", "ts")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, x, y, post_id, user_id, ts): cells of made-up coordinates."""
    from quillon.operators.indexes import geo_rows

    return geo_rows(posts(spark, sf_dir), (F.col("user_id") - 75) * F.lit(2.37), (F.col("k") - 50) * F.lit(1.79))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
