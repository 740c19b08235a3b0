"""Statistics of terms, searches over postings, and pairs of neighbouring terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import STOP_WORDS, TOKEN, analyze, whole_word
from quillon.operators import postings


def term_stats(frequencies: DataFrame) -> DataFrame:
    """(term, docs, freq, bytes): documents, occurrences, and bytes of postings of each term (its text and eight bytes a document)."""
    return frequencies.groupBy("term").agg(F.count("*").alias("docs"), F.sum("freq").alias("freq"), F.sum(F.octet_length("term").cast("long") + 8).alias("bytes"))


def term_hits(frequencies: DataFrame, more_than: int = 1) -> DataFrame:
    """(term, hits) of the terms with more hits in all."""
    return frequencies.groupBy("term").agg(F.sum("freq").alias("hits")).where(F.col("hits") > more_than)


def docs_per_term(index: DataFrame, by: list[str]) -> DataFrame:
    """Documents of each term, or of each term of each field."""
    return index.groupBy(*by).agg(F.count_distinct("doc_id").alias("docs"))


def both_terms(index: DataFrame, first: str, second: str, limit: int | None = None) -> DataFrame:
    """Documents with both terms, ascending; the postings are intersected."""
    found = index.where(F.col("term") == first).select("doc_id").intersect(index.where(F.col("term") == second).select("doc_id"))
    return found if limit is None else found.orderBy("doc_id").limit(limit)


def all_fields(index: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Documents whose every named field has its term: one pass and one aggregate, however many fields."""
    hit = F.lit(False)
    for field, term in wanted.items():
        hit = hit | ((F.col("field") == field) & (F.col("term") == term))
    return index.where(hit).groupBy("doc_id").agg(F.count_distinct("field").alias("k")).where(F.col("k") == len(wanted)).select("doc_id")


def fields_of(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same with (field, term) from a table, which has a row a field."""
    k = wanted.agg(F.count("*").alias("all"))
    hit = index.join(F.broadcast(wanted), ["field", "term"], "left_semi").groupBy("doc_id").agg(F.count_distinct("field").alias("k"))
    return hit.join(F.broadcast(k), F.col("k") == F.col("all"), "left_semi").select("doc_id")


def scan_words(docs: DataFrame, word: str, other: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with a whole word, and with another string anywhere."""
    found = docs.where(F.contains(F.col(text_col), F.lit(word)) & whole_word(F.col(text_col), word))
    return (found if other is None else found.where(F.contains(F.col(text_col), F.lit(other)))).select(id_col)


def any_term(docs: DataFrame, wanted: list[str], columns: list[str], text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The named columns of documents that have one of the terms."""
    return docs.where(F.arrays_overlap(analyze(F.col(text_col), stop_words), F.array(*map(F.lit, wanted)))).select(*columns)


def neighbours(docs: DataFrame, text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS, both_ways: bool = False) -> DataFrame:
    """(t1, t2, forward, backward), t1 not behind t2 as text: how often t1 has t2 behind it, and the other way about.  A term behind
    itself, and one at a document's end, count forward with t2 = t1.  both_ways leaves out what is seen one way only, where it is
    summed.  Counted in pieces of documents before the one shuffle."""
    return postings.pair_counts(docs, text_col, stop_words, both_ways)


def counts_in_pieces(docs: DataFrame, text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, freq) of pieces of documents, as term_hits sums them."""
    return postings.term_counts(docs, text_col, stop_words)


def pair_frequencies(pairs: DataFrame) -> DataFrame:
    """(t1, t2, forward, backward) of the neighbours that are seen both ways."""
    return pairs.where("t1 <> t2 and forward > 0 and backward > 0")


def synonyms(pairs: DataFrame, hits: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """(t1, t2, plus, min_score, p, forward, backward, c1, c2): plus = (f + b) / (c1 c2), min_score = min(f, b) / (c1 c2), p = max / min.

    Terms without hits count once; terms with digits or any of ``. _ , :`` are left out; min_score must exceed the threshold and
    p one."""
    plain = lambda c: ~F.col(c).rlike(r"[0-9._,:]")
    rows = pairs.where(plain("t1") & plain("t2"))
    c1 = hits.select(F.col("term").alias("t1"), F.col("hits").alias("h1"))
    c2 = hits.select(F.col("term").alias("t2"), F.col("hits").alias("h2"))
    both = rows.join(c1, "t1", "left").join(c2, "t2", "left").withColumns({"c1": F.coalesce("h1", F.lit(1)), "c2": F.coalesce("h2", F.lit(1))})
    size = F.col("c1") * F.col("c2")
    low, high = F.least("forward", "backward"), F.greatest("forward", "backward")
    found = both.select("t1", "t2", ((F.col("forward") + F.col("backward")) / size).alias("plus"), (low / size).alias("min_score"), (high / low).alias("p"), "forward", "backward", "c1", "c2")
    return found.where((F.col("min_score") > threshold) & (F.col("p") > 1))


def sections(docs: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """(section, docs): documents by id modulo n."""
    return docs.groupBy(F.pmod(F.col(id_col), F.lit(n)).alias("section")).agg(F.count("*").alias("docs"))


def token_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(term, n) of all tokens, stop words too."""
    return texts.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(TOKEN), F.lit(0))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
