"""Look-ups of posts through indexes: by key, phrase, place, time, user, name; and what is returned of them.

Each is one plan: a predicate on the index that reaches its scan, and a semi-join of the posts with what is left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import STOP_WORDS
from quillon.functions.timespan import TimeWindow
from quillon.plans.constraints import keyword


def within(rows: DataFrame, window: TimeWindow | None, ts: str = "ts") -> DataFrame:
    """Rows of a window; also by month where the table is partitioned by it."""
    if window is None:
        return rows
    found = rows.where(window.holds(F.col(ts), dict(rows.dtypes)[ts] == "timestamp_ntz"))
    return found.where(window.months(F.col("month"))) if "month" in rows.columns else found


def by_keyword(index: DataFrame, text: str, window: TimeWindow | None = None) -> DataFrame:
    """Distinct ids of posts by keywords (see plans.constraints.keyword)."""
    return within(index, window).where(keyword(F.col("key"), text)).select("post_id").distinct()


def by_keys(index: DataFrame, keys: DataFrame, window: TimeWindow | None = None) -> DataFrame:
    """Distinct ids of posts with a key of a table of keys, such as a file of them."""
    return within(index, window).join(keys, "key", "left_semi").select("post_id").distinct()


def by_phrase(posts: DataFrame, phrase: str, window: TimeWindow | None = None, id_col: str = "post_id", text_col: str = "text") -> DataFrame:
    """Ids of posts whose text holds the phrase, whatever the case.  Every word of it must be there, which is what
    a term index answers; the text itself decides."""
    found = within(posts, window) if window else posts
    return found.where(F.contains(F.lower(text_col), F.lit(phrase.lower()))).select(id_col)


def inner_words(phrase: str) -> list[str]:
    """Words of letters with a blank on either side within the phrase: whatever text holds the phrase has them as whole terms."""
    return sorted({w for w in re.findall(r"(?<=\s)[^\W\d_]+(?=\s)", phrase.lower()) if w not in STOP_WORDS})


def by_phrase_indexed(posts: DataFrame, index: DataFrame, phrase: str, window: TimeWindow | None = None, id_col: str = "post_id", text_col: str = "text") -> DataFrame:
    """The same through an index of terms: the postings of the phrase's inner words are intersected, and only the posts that are left
    are read.  Without such a word the texts are scanned."""
    wanted = inner_words(phrase)
    if not wanted:
        return by_phrase(posts, phrase, window, id_col, text_col)
    found = within(index, window).where(F.col("key").isin(wanted)).groupBy(id_col).agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(wanted))
    return by_phrase(fetch(within(posts, window), found.select(id_col), id_col), phrase, None, id_col, text_col)


def by_box(places: DataFrame, low: str, high: str, window: TimeWindow | None = None) -> DataFrame:
    """Ids of posts in a box of cells from ``x_y`` to ``x_y``, both inclusive."""
    (x0, y0), (x1, y1) = (map(int, c.split("_")) for c in (low, high))
    x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    if not (-18000 <= x0 <= x1 <= 18000 and -9000 <= y0 <= y1 <= 9000):
        raise ValueError("a box off the globe")
    return within(places, window).where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).select("post_id").distinct()


def by_time(posts: DataFrame, start: str, end: str, id_col: str = "post_id") -> DataFrame:
    """Ids of posts from start on and before end."""
    return within(posts, TimeWindow(start, end, "left")).select(id_col)


def by_user(posts: DataFrame, user_id: int, window: TimeWindow | None = None) -> DataFrame:
    return within(posts, window).where(F.col("user_id") == user_id).select("post_id")


def reshares_of(posts: DataFrame, post_id: int, window: TimeWindow | None = None) -> DataFrame:
    return within(posts, window).where(F.col("reshared_id") == post_id).select("post_id")


def users_by_name(names: DataFrame, name: str) -> DataFrame:
    """Distinct ids of the users who had a screen name; no window applies."""
    return names.where(F.col("key") == name.lower()).select("user_id").distinct()


def posts_by_name(names: DataFrame, posts: DataFrame, name: str) -> DataFrame:
    """Posts of the user who had the name last."""
    latest = names.where(F.col("key") == name.lower()).agg(F.max_by("user_id", "ts").alias("user_id"))
    return posts.join(F.broadcast(latest), "user_id", "left_semi")  # one row


def fetch(posts: DataFrame, ids: DataFrame, on: str = "post_id") -> DataFrame:
    """Posts with the ids."""
    return posts.join(ids, on, "left_semi")


def with_users(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Posts with what was known of their users at the time, by user and post; null where nothing was."""
    return posts.join(users, ["user_id", "post_id"], "left")


def with_reshared(posts: DataFrame, columns: list[str]) -> DataFrame:
    """Posts with columns of the post they reshare, one level deep, prefixed ``original_``."""
    original = posts.select(F.col("post_id").alias("reshared_id"), *(F.col(c).alias(f"original_{c}") for c in columns))
    return posts.join(original, "reshared_id", "left")


def scan_keys(posts: DataFrame, wanted: list[str], window: TimeWindow | None = None, memes: str = "memes") -> DataFrame:
    """Ids of posts by keys without an index: the brute-force twin of by_keyword."""
    return within(posts, window).where(F.arrays_overlap(memes, F.array(*(F.lit(w.lower()) for w in wanted)))).select("post_id")


def scan_pattern(posts: DataFrame, pattern: str, window: TimeWindow | None = None, memes: str = "memes") -> DataFrame:
    """Ids of posts with a key that a regular expression matches whole, without an index."""
    return within(posts, window).where(F.exists(memes, lambda m: F.lower(m).rlike(rf"\A(?:{pattern})\z"))).select("post_id")


def first_rows(rows: DataFrame, key: str, n: int, start: object = None) -> DataFrame:
    """The first n rows by key, from a key on: top-k, no full sort."""
    found = rows if start is None else rows.where(F.col(key) >= F.lit(start))
    return found.orderBy(key).limit(n)


def newest(rows: DataFrame, n: int, ts: str = "ts", id_col: str = "post_id") -> DataFrame:
    """n rows, newest first; ties by id, the greater first."""
    return rows.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)


def ids_and_times(rows: DataFrame, id_col: str = "post_id", ts: str = "ts") -> DataFrame:
    return rows.select(id_col, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at")).distinct()


def user_related(posts: DataFrame, mentions: DataFrame, user: int, window: TimeWindow | None = None) -> DataFrame:
    """(leg, post_id): a user's posts, the reshares of those, and the posts that mention the user; legs aren't merged.

    mentions: (post_id, target, ts)."""
    own = within(posts, window).where(F.col("user_id") == user).select("post_id")
    again = within(posts, window).join(own.select(F.col("post_id").alias("reshared_id")), "reshared_id", "left_semi").select("post_id")
    named = within(mentions, window).where(F.col("target") == user).select("post_id")
    return own.select(F.lit("post").alias("leg"), "post_id").unionByName(again.select(F.lit("reshare").alias("leg"), "post_id")).unionByName(named.select(F.lit("mention").alias("leg"), "post_id"))


def only_reshares(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("reshared_id").isNotNull())


def latest_per_key(rows: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, value) with each key's last value."""
    return rows.groupBy(key).agg(F.max_by(value, ts).alias(value))


def project(rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Fields by dotted path, nested ones too: only those of include, then without those of exclude.  Structs are rebuilt;
    one of which nothing is left goes.  Unknown paths are errors."""
    known = set(_paths(rows.schema))
    for p in [*(include or []), *(exclude or [])]:
        if p not in known:
            raise ValueError(f"there is no field {p!r}")

    def keep(path: str) -> bool | None:
        """Whole, not at all, or (None) in part."""
        if any(path == e or path.startswith(e + ".") for e in exclude or []):
            return False
        if include is not None and not any(path == i or path.startswith(i + ".") for i in include):
            return None if any(i.startswith(path + ".") for i in include) else False
        return None if any(e.startswith(path + ".") for e in exclude or []) else True

    def build(schema: T.StructType, at: Column | None, base: str) -> list[Column]:
        out = []
        for f in schema.fields:
            path = f"{base}{f.name}"
            c = F.col(f"`{f.name}`") if at is None else at[f.name]
            how = keep(path)
            if how:
                out.append(c.alias(f.name))
            elif how is None and isinstance(f.dataType, T.StructType):
                inner = build(f.dataType, c, path + ".")
                if inner:
                    out.append(F.when(c.isNotNull(), F.struct(*inner)).alias(f.name))
        return out

    return rows.select(*build(rows.schema, None, ""))


def _paths(schema: T.StructType, base: str = "") -> list[str]:
    out = []
    for f in schema.fields:
        out.append(base + f.name)
        if isinstance(f.dataType, T.StructType):
            out += _paths(f.dataType, f"{base}{f.name}.")
    return out


def ranked(rows: DataFrame, by: list[Column], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= k)
