"""Posts from JSON lines: reading, flattening, and everything that a load makes of them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import leading_count
from quillon.functions.timespan import post_time
from quillon.model import post_schema
from quillon.operators import indexes
from quillon.session import small_parts

#: Index name -> what makes it from flat posts.
INDEXES = {"memes": indexes.meme_index, "text": indexes.text_index, "places": indexes.geo_index}


def read_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Posts from files, folders or patterns of JSON lines, packed or not.  Lines that aren't JSON, or have no id, are left out."""
    raw = spark.read.schema(post_schema()).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths)
    return raw.where("id is not null").drop("_corrupt")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Posts from the files that the lines of another file name.  The list is small: it has a line a file."""
    files = [r.value.strip() for r in spark.read.text(path).where("trim(value) <> ''").collect()]
    if not files:
        return spark.createDataFrame([], post_schema()).drop("_corrupt")
    return read_json(spark, files)


def _flat(at: str) -> list[Column]:
    c = lambda name: F.col(f"{at}{name}")
    return [
        c("id").alias("post_id"), c("user.id").alias("user_id"), post_time(c("created_at")).alias("ts"), c("text").alias("text"), leading_count(c("retweet_count")).alias("reshare_count"),
        c("in_reply_to_status_id").alias("reply_to_post"), c("in_reply_to_user_id").alias("reply_to_user"), c("source").alias("source"), c("lang").alias("lang"), c("coordinates").alias("coordinates"),
        c("geo").alias("geo"), c("place").alias("place"), c("entities").alias("entities"), c("user").alias("user"),
    ]


def flatten(posts: DataFrame) -> DataFrame:
    """One row a post, typed, with its month; posts that others reshare are posts of their own, once each.

    memes are the substrings of the text that entities take up, for the index of terms."""
    own = F.struct(*_flat(""), F.col("retweeted_status.id").alias("reshared_id"), F.col("retweeted_status.user.id").alias("reshared_user"), F.lit(1).alias("__own"))
    original = F.struct(*_flat("retweeted_status."), F.lit(None).cast("bigint").alias("reshared_id"), F.lit(None).cast("bigint").alias("reshared_user"), F.lit(0).alias("__own"))
    # both from one parse of the line
    every = posts.select(F.inline(F.array(own, F.when(F.col("retweeted_status.id").isNotNull(), original)))).where("__own is not null")
    # a post itself before what others had of it; then the one most reshared
    first = Window.partitionBy("post_id").orderBy(F.desc("__own"), F.desc_nulls_last("reshare_count"), F.xxhash64("text", "ts", "user_id", "reshared_id"))
    rows = every.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth", "__own")
    e = F.col("entities")
    none = F.array().cast("array<string>")
    spans = F.concat(
        F.coalesce(F.transform(e["user_mentions"], lambda m: F.concat(F.lit("@"), m["screen_name"])), none),
        F.coalesce(F.transform(e["hashtags"], lambda t: F.concat(F.lit("#"), t["text"])), none),
        F.coalesce(F.transform(e["urls"], lambda u: u["url"]), none),
    )
    return rows.withColumns({"memes": F.filter(spans, lambda m: m.isNotNull() & (m != "")), "month": F.date_format("ts", "yyyy-MM")})


def users(flat: DataFrame) -> DataFrame:
    """(user_id, post_id, ...): what each post knew of its user; ts is when the account was made."""
    rows = flat.where("user.id is not null").select("user_id", "post_id", "user.*")
    return rows.withColumn("ts", post_time(F.col("created_at"))).drop("id")


def tables_of(flat: DataFrame, index: bool = True) -> dict[str, DataFrame]:
    """What a load makes of flat posts: users, names, and the indexes."""
    out = {"users": users(flat)}
    if index:
        out |= {f"index_{name}": build(flat) for name, build in INDEXES.items()}
        out["index_names"] = indexes.name_index(out["users"])
        out["index_reshares"] = flat.where("reshared_id is not null").select(F.col("reshared_id").alias("key"), "post_id", "user_id", "ts")
    return out


def ingest(posts: DataFrame, folder: str, load: str, index: bool = True) -> None:
    """Load posts into a folder under a load's name, and index them.  The input is read and parsed once: indexes are made from the
    posts as they were written.  A load of a name that is there already takes its place, so that it can be repeated."""
    spark = posts.sparkSession
    with small_parts(posts):
        save({"posts": flatten(posts)}, folder, load)
        written = spark.read.schema(flatten(posts).schema).parquet(f"{folder}/posts/load={load}")
        save(tables_of(written, index), folder, load)


def save(tables: dict[str, DataFrame], folder: str, load: str = "0") -> None:
    """Write tables as Parquet, a folder a load and month; those with a key ranged and sorted by it within each month, so that look-ups
    skip files and row groups.  Posts divide the rows of a key that are too many for one range.  Tables are written side by side, so that
    the small ones of a micro-batch don't wait for each other."""

    def one(name: str, rows: DataFrame) -> None:
        if "month" not in rows.columns and "ts" in rows.columns and name != "index_names":
            rows = rows.withColumn("month", F.date_format("ts", "yyyy-MM"))
        if "key" in rows.columns:
            by = [c for c in ("month", "key") if c in rows.columns]
            rows = rows.repartitionByRange(*by, *(c for c in ("post_id", "user_id") if c in rows.columns)).sortWithinPartitions(*by)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy("month") if "month" in rows.columns else writer).parquet(f"{folder}/{name}/load={load}")

    with ThreadPoolExecutor(4) as pool:
        for done in [pool.submit(inheritable_thread_target(rows.sparkSession)(one), name, rows) for name, rows in tables.items()]:
            done.result()


def to_json(rows: DataFrame) -> DataFrame:
    """(value): rows as JSON, nulls left out."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def of_hour(posts: DataFrame, hour: int, date: str | None = None) -> DataFrame:
    """Flat posts of one hour of day, of one date or of all."""
    found = posts.where(F.hour("ts") == hour)
    return found if date is None else found.where(F.to_date("ts") == F.lit(date).cast("date"))
