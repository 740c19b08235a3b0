"""One query for each operator of this subpackage, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import audio, bpe, decontaminate, langid, licenses, quality, secrets, simhash, sstable, substrings
from quillon.session import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of documents: (doc_id, kept_doc_id, distance)."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: (doc_id, lang_pred, bits_per_byte, margin_bits)."""
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as shards and read back by looking up every identifier."""
    return sstable.round_trip(documents(spark, sf_dir), "doc_id", ["text", "lang", "source", "n_chars"])


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-mel windows of every document's bytes, heard as 8-bit samples at 8 kHz with a pause after every eight lines, which are a
    segment so: the tables hold no other media."""
    docs = documents(spark, sf_dir)
    return audio.features(docs.select("doc_id", F.when(F.length("text") > 0, audio.wav(audio.read_aloud(F.col("text")))).alias("audio")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of lines of documents that hold a license notice."""
    return licenses.scan(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: (doc_id, probability, accepted)."""
    docs = documents(spark, sf_dir)
    return quality.scores(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark items, with each longest match: these are the ones to remove."""
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents that occurred before, with their places: these are the ones to remove."""
    return substrings.repeats(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings in documents that look like secrets, with their tests."""
    return secrets.secrets(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: (doc_id, n_tokens, tokens, round_trip)."""
    return bpe.encode(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_langid, op3_sstable, op4_audio, op5_licenses, op6_quality, op7_decontaminate, op8_substrings, op9_secrets, op10_bpe)}

#: SQL of the queries that SQL can express; the others hash, learn or tokenise, and tests hold them against brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op3_sstable": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "op5_licenses": licenses.ORACLE_SQL,
    "op8_substrings": substrings.ORACLE_SQL,
}
