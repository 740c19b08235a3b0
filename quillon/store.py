"""A folder of posts and their indexes, and every command over it.

Each method is one plan over the Parquet tables of the folder; nothing is collected.  ``COMMANDS`` names the methods for the
command line (``python -m quillon``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import keys
from quillon.functions.timespan import TimeWindow
from quillon.model import post_schema
from quillon.operators import counts, lookup, sets
from quillon.plans.constraints import CellQuery, keyword
from quillon.plans.index import IndexSpec, build_all
from quillon.sources import files, posts
from quillon.streaming import windows

Step = Callable[[DataFrame], DataFrame]


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    # tables -------------------------------------------------------------------------------------------------------------------
    def load(self, paths: str | list[str], index: bool = True) -> None:
        """Load posts from JSON lines and, unless told otherwise, index them."""
        posts.ingest(posts.read_json(self.spark, paths), self.folder, uuid.uuid4().hex, index)

    def load_list(self, path: str, index: bool = True) -> None:
        """The same from the files that a file lists."""
        posts.ingest(posts.read_list(self.spark, path), self.folder, uuid.uuid4().hex, index)

    def create(self, months: list[str], names: tuple[str, ...] = ("posts", "index_memes", "index_text")) -> None:
        """Empty tables of posts and their indexes, with a folder for each of the months."""
        none = posts.flatten(self.spark.createDataFrame([], post_schema()).drop("_corrupt"))
        empty = {"posts": none} | posts.tables_of(none)
        for name in names:
            posts.save({name: empty[name]}, self.folder, "none")
            for month in months:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/load=none/month={month}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)

    def splits(self, name: str, key: str, parts: int) -> list[float]:
        """Keys, which are numbers, at which a table divides into parts of like size: the bounds to range another one by."""
        return sets.range_bounds(self.table(name), key, parts)

    def follow(self, folder: str, files_per_trigger: int = 1000):  # noqa: ANN201
        """Load and index what arrives in a folder, as a stream: the batch's own transforms on every micro-batch, whose
        tables a repeated micro-batch overwrites.  Returns the
        started query; it stops when all that is there now is loaded."""
        stream = windows.read_stream(self.spark, folder, post_schema(), files_per_trigger=files_per_trigger)

        def each(rows: DataFrame, batch_id: int) -> None:
            posts.ingest(rows.where("id is not null").drop("_corrupt"), self.folder, f"batch-{batch_id}")

        return stream.writeStream.foreachBatch(each).trigger(availableNow=True).option("checkpointLocation", f"{self.folder}/_progress").start()

    def build_indexes(self, specs: list[IndexSpec], only: str | None = None) -> None:
        """Build indexes of one's own definition from the posts."""
        for name, rows in build_all(specs, {"posts": self.table("posts")}, {"posts": "post_id"}, {"posts": "ts"}, only).items():
            posts.save({f"index_{name}": rows}, self.folder)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}/load=*").drop("load")

    def tables(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in system.listStatus(path) if s.isDirectory() and not s.getPath().getName().startswith("_")) if system.exists(path) else []

    def drop(self, name: str) -> bool:
        """Delete a table; False if there was none."""
        if name not in self.tables():
            return False
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def bounds(self, name: str, key: str, parts: int) -> DataFrame:
        """(part, first, last, n) of a table ranged by a key into parts of like size."""
        ranged = self.table(name).select(key).repartitionByRange(parts, key).select(F.spark_partition_id().alias("part"), key)
        # the least of texts is found by sorting, so rows of one key are counted before
        counted = ranged.groupBy("part", key).agg(F.count("*").alias("n"))
        return counted.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.sum("n").alias("n"))

    def read(self, name: str, n: int, start: str | None = None, key: str | None = None) -> DataFrame:
        """The first n rows of a table by its key, from one on."""
        rows = self.table(name)
        by = key or ("key" if "key" in rows.columns else "post_id" if "post_id" in rows.columns else rows.columns[0])
        return lookup.first_rows(rows, by, n, start)

    def dump(self, name: str, columns: list[str] | None = None) -> DataFrame:
        return files.dump(self.table(name), columns)

    # look-ups -----------------------------------------------------------------------------------------------------------------
    @staticmethod
    def window(start: str | None, end: str | None, closed: str = "both") -> TimeWindow | None:
        return TimeWindow(start, end, closed) if start or end else None

    def ids(self, kind: str, words: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Ids of posts by meme, text, user, reshared, phrase, or box (``x_y:x_y``)."""
        w = self.window(start, end)
        if kind in ("meme", "text"):
            return lookup.by_keyword(self.table({"meme": "index_memes", "text": "index_text"}[kind]), words, w)
        if kind == "user":
            return lookup.by_user(self.table("posts"), int(words), w)
        if kind == "reshared":
            return lookup.within(self.table("index_reshares"), w).where(F.col("key") == int(words)).select("post_id").distinct()
        if kind == "phrase":
            return lookup.by_phrase_indexed(self.table("posts"), self.table("index_text"), words, w)
        if kind == "box":
            low, _, high = words.partition(":")
            return lookup.by_box(self.table("index_places"), low, high or low, w)
        raise ValueError(f"no look-up is called {kind!r}")

    def get(self, kind: str, words: str, start: str | None = None, end: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        """The posts themselves, with some of their fields."""
        found = lookup.fetch(self.table("posts"), self.ids(kind, words, start, end))
        return lookup.project(found, include, exclude) if include or exclude else found

    def get_by_time(self, start: str, end: str) -> DataFrame:
        return lookup.by_time(self.table("posts"), start, end)

    def get_users_by_name(self, name: str) -> DataFrame:
        return lookup.users_by_name(self.table("index_names"), name)

    def get_by_query(self, index: str, query: str) -> DataFrame:
        """Cells of an index by constraints; see plans.constraints."""
        return CellQuery.of(query).run(self.table(f"index_{index}"), {"rowkey": "key", "qual": "post_id", "cellval": "user_id"})

    def get_ids_and_times(self, kind: str, words: str, start: str | None = None, end: str | None = None) -> DataFrame:
        return lookup.ids_and_times(self.get(kind, words, start, end))

    def get_user_related(self, user: int, start: str | None = None, end: str | None = None) -> DataFrame:
        p = self.table("posts")
        named = self.table("index_memes").where(F.col("key") == f"@{user}").select("post_id", F.lit(user).alias("target"), "ts")
        return lookup.user_related(p, named, user, self.window(start, end))

    # counts -------------------------------------------------------------------------------------------------------------------
    def _index(self, kind: str, words: str) -> DataFrame:
        if kind == "user":
            return self.table("posts").where(F.col("user_id").isin([int(w) for w in re.split(r"[,\s]+", words) if w])).withColumn("key", F.col("user_id").cast("string"))
        return self.table({"meme": "index_memes", "text": "index_text"}[kind]).where(keyword(F.col("key"), words))

    def timestamp_count(self, kind: str, words: str, start: str, end: str) -> DataFrame:
        """Posts a day by meme, text or user; the end is left out."""
        return counts.per_day(self._index(kind, words), self.window(start, end, "left"))

    def post_count(self, kind: str, words: str, start: str | None = None, end: str | None = None) -> DataFrame:
        return counts.per_key(self._index(kind, words), self.window(start, end))

    def user_post_count(self, kind: str, words: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Posts of each ``name(id)``, named as in the post."""
        found = self.get(kind, words, start, end).withColumn("name", F.col("user.screen_name"))
        return counts.per_user(found, None, "name")

    def cooccur_count(self, words: str, start: str | None = None, end: str | None = None) -> DataFrame:
        return counts.cooccurring(self.table("index_memes"), self.ids("meme", words, start, end))

    def reshare_edges(self, words: str, direction: str = "out", start: str | None = None, end: str | None = None) -> DataFrame:
        """Who reshared whom among the posts of a meme."""
        p = self.table("posts")
        original = p.select(F.col("post_id").alias("reshared_id"), F.col("user_id").alias("target"))
        return counts.edges(lookup.fetch(p, self.ids("meme", words, start, end)).join(original, "reshared_id"), direction)

    def mention_edges(self, words: str, direction: str = "out", start: str | None = None, end: str | None = None) -> DataFrame:
        named = self.table("index_memes").where(keys.kind(F.col("key")) == "mention").withColumn("target", F.substring("key", 2, 30).cast("bigint"))
        return counts.edges(lookup.fetch(named, self.ids("meme", words, start, end)), direction)

    # analyses of one's own -----------------------------------------------------------------------------------------------------
    def analyze(self, ids: DataFrame, each: Step, gather: Step | None = None) -> DataFrame:
        """One's own steps over the posts with the ids: ``each`` maps, ``gather`` reduces or is left out."""
        found = lookup.fetch(self.table("posts"), ids).transform(each)
        return found if gather is None else found.transform(gather)

    def get_and_analyze(self, kind: str, words: str, start: str | None, end: str | None, each: Step, gather: Step | None = None) -> tuple[DataFrame, DataFrame]:
        """The analysis, and how many posts it is of."""
        ids = self.ids(kind, words, start, end)
        return self.analyze(ids, each, gather), ids.agg(F.count("*").alias("n"))

    def process_ids(self, path: str, each: Step, gather: Step | None = None) -> DataFrame:
        """The same over ids from files."""
        return self.analyze(files.read_ids(self.spark, path).select("post_id").distinct(), each, gather)

    def analyze_by_name(self, kind: str, words: str, start: str, end: str, each: str, gather: str | None = None) -> DataFrame:
        """get_and_analyze with steps that are named ``module:function``, for the command line."""
        return self.get_and_analyze(kind, words, start, end, step(each), step(gather) if gather else None)[0]

    def process_by_name(self, path: str, each: str, gather: str | None = None) -> DataFrame:
        return self.process_ids(path, step(each), step(gather) if gather else None)

    def create_by_name(self, months: str) -> None:
        """Tables for months between commas."""
        self.create([m.strip() for m in months.split(",") if m.strip()])

    def request(self, text: str, limit: int = 100) -> DataFrame:
        """``userId:7``, ``meme:#a`` or ``sname:ann``, with ``;[start,end]`` or without: posts, newest first."""
        m = re.fullmatch(r"\s*(userId|meme|sname):([^;]+?)\s*(?:;\s*\[([^,]*),([^\]]*)\])?\s*", text)
        if not m:
            raise ValueError(f"{text!r} is no request")
        kind, words, start, end = m.groups()
        p = self.table("posts")
        if kind == "sname":
            found = lookup.within(lookup.posts_by_name(self.table("index_names"), p, words), self.window(start, end))
        else:
            found = lookup.fetch(p, self.ids({"userId": "user", "meme": "meme"}[kind], words, start, end))
        return lookup.newest(found, limit)


def step(name: str) -> Step:
    """A step by its name, ``module:function``."""
    module, colon, function = name.partition(":")
    if not colon:
        raise ValueError(f"{name!r} isn't module:function")
    return getattr(import_module(module), function)


#: Command -> (method, fixed arguments).
COMMANDS: dict[str, tuple[str, tuple]] = {
    "load": ("load", ()), "load-list": ("load_list", ()), "delete-table": ("drop", ()), "list-tables": ("tables", ()), "read-table": ("read", ()), "dump-table": ("dump", ()),
    "get-posts-with-meme": ("get", ("meme",)), "get-posts-with-text": ("get", ("text",)), "get-posts-with-phrase": ("get", ("phrase",)), "get-posts-with-userid": ("get", ("user",)),
    "get-posts-with-coordinates": ("get", ("box",)), "get-posts-with-time": ("get_by_time", ()), "get-reshares": ("get", ("reshared",)), "get-uids-with-name": ("get_users_by_name", ()),
    "get-posts-with-query": ("get_by_query", ()), "get-post-ids-and-times": ("get_ids_and_times", ()), "get-user-related": ("get_user_related", ()),
    "timestamp-count": ("timestamp_count", ("meme",)), "text-timestamp-count": ("timestamp_count", ("text",)), "userid-timestamp-count": ("timestamp_count", ("user",)),
    "meme-post-count": ("post_count", ("meme",)), "text-post-count": ("post_count", ("text",)), "userid-post-count": ("post_count", ("user",)),
    "user-post-count": ("user_post_count", ("meme",)), "user-post-count-by-text": ("user_post_count", ("text",)), "meme-cooccur-count": ("cooccur_count", ()),
    "get-reshare-edges": ("reshare_edges", ()), "get-mention-edges": ("mention_edges", ()), "request": ("request", ()),
    "create-tables": ("create_by_name", ()), "get-and-analyze": ("analyze_by_name", ()), "process-ids": ("process_by_name", ()),
}


def run(store: Store, command: str, *arguments: str) -> object:
    """A command by name; ValueError for one that isn't there."""
    if command not in COMMANDS:
        raise ValueError(f"no command is called {command!r}; there are {', '.join(COMMANDS)}")
    method, fixed = COMMANDS[command]
    typed = [int(a) if (method, i) in (("read", 1), ("request", 1), ("get_user_related", 0)) else a for i, a in enumerate(arguments)]
    return getattr(store, method)(*fixed, *typed)
