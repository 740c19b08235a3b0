"""Indexers of posts, users, texts, places, documents and books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import keys
from quillon.functions.text import STOP_WORDS, analyze, blank_out, explode_terms, split_terms, terms
from quillon.operators import postings
from quillon.plans.index import register


def meme_array(entities: str = "entities") -> Column:
    """Keys of a post's mentions, hashtags, addresses and expanded addresses; no nulls."""
    e = F.col(entities)
    mentions = F.transform(e["user_mentions"], lambda m: keys.mention(m["id"]))
    tags = F.transform(e["hashtags"], lambda t: keys.hashtag(t["text"]))
    urls = F.transform(e["urls"], lambda u: u["url"])
    wide = F.transform(e["urls"], lambda u: u["expanded_url"])
    parts = [F.coalesce(x, F.array().cast("array<string>")) for x in (mentions, tags, urls, wide)]
    return F.array_distinct(F.filter(F.concat(*parts), lambda k: k.isNotNull()))


def explode_keys(posts: DataFrame, memes: Column | str = "memes") -> DataFrame:
    """(key, post_id, user_id, ts): one row for each key of each post.  The user rides along, so that counts by
    user need no look-up of the post."""
    return posts.select(F.explode(memes).alias("key"), "post_id", "user_id", "ts")


@register("memes")
def meme_index(posts: DataFrame) -> DataFrame:
    return explode_keys(posts, meme_array() if "entities" in posts.columns else F.col("memes"))


@register("post-text")
def text_index(posts: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(key, post_id, user_id, ts): distinct terms of the text once its memes are blanked out."""
    text = blank_out(F.col("text"), F.col("memes")) if "memes" in posts.columns else F.col("text")
    return posts.select(F.explode(terms(text, stop_words)).alias("key"), "post_id", "user_id", "ts")


@register("screen-names")
def name_index(users: DataFrame) -> DataFrame:
    """(key, user_id, ts): names in lower case; ts is when the account was made."""
    return users.select(F.lower("screen_name").alias("key"), "user_id", "ts").where("key is not null")


@register("places")
def geo_index(posts: DataFrame) -> DataFrame:
    """(key, x, y, post_id, user_id, ts): cells of a hundredth of a degree; coordinates [lon, lat] before geo [lat, lon]."""
    lon = F.coalesce(F.get(F.col("coordinates.coordinates"), F.lit(0)), F.get(F.col("geo.coordinates"), F.lit(1)))
    lat = F.coalesce(F.get(F.col("coordinates.coordinates"), F.lit(1)), F.get(F.col("geo.coordinates"), F.lit(0)))
    return geo_rows(posts, lon, lat)


def geo_rows(posts: DataFrame, lon: Column, lat: Column) -> DataFrame:
    rows = posts.select(keys.cell_index(lon).alias("x"), keys.cell_index(lat).alias("y"), "post_id", "user_id", "ts").where("x is not null and y is not null")
    return rows.select(F.concat_ws("_", F.col("x").cast("string"), F.col("y").cast("string")).alias("key"), "x", "y", "post_id", "user_id", "ts")


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS, section: tuple[int, int] | None = None) -> DataFrame:
    """(term, doc_id, freq); numbers left out.  section (k, n) takes the documents whose id modulo n is k."""
    rows = docs if section is None else docs.where(F.pmod(F.col(id_col), F.lit(section[1])) == section[0])
    return postings.postings(rows, id_col, text_col, stop_words, False)


def positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, doc_id, positions): places among the terms that are kept, from 0, ascending."""
    return postings.postings(docs, id_col, text_col, stop_words, True).drop("freq")


def frequencies_and_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Both of the above: (term, doc_id, freq, positions)."""
    return postings.postings(docs, id_col, text_col, stop_words, True)


def metadata_index(books: DataFrame, id_col: str, analyzed: list[str], split: list[str], stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(field, term, doc_id, freq): fields of prose are analyzed, fields of lists split at commas."""

    def of(name: str, found: Column) -> Column:
        return F.transform(found, lambda t: F.struct(F.lit(name).alias("field"), t.alias("term")))

    entries = [of(f, analyze(F.col(f), stop_words)) for f in analyzed] + [of(f, split_terms(F.col(f), ",")) for f in split]
    empty = F.array().cast("array<struct<field:string,term:string>>")
    rows = books.select(F.col(id_col).alias("doc_id"), F.explode(F.concat(*(F.coalesce(e, empty) for e in entries))).alias("e"))
    return rows.groupBy("e.field", "e.term", "doc_id").agg(F.count("*").alias("freq"))


def page_positions(pages: DataFrame, book_col: str = "book", page_col: str = "page", text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, book, pages, freq): the pages that hold a term, ascending, and how often the book does."""
    rows = explode_terms(pages, F.col(text_col), "term", [F.col(book_col).alias("book"), F.col(page_col).alias("page")], stop_words, drop_numbers=True)
    return rows.groupBy("term", "book").agg(F.sort_array(F.collect_set("page")).alias("pages"), F.count("*").alias("freq"))
