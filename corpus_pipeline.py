"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontaminate, quality, secrets, simhash
from quillon.llm.common import own_folder


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among docs.  Null and empty texts go; a null id only
    keeps a row from being learned from; repeated rows and other columns, whatever their names, come through as they are."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the least id, of equal ids the first in the files, one without an id
    only where no other is.  Null and empty texts all stay."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark, as they were; null texts have none, and nor has anything where the benchmark is
    empty.  Repeated rows go or stay together."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; n_chars follows the text, and is null for a null one."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, also of those without an id; a null text has null tokens, an empty one none; repeated rows are
    encoded each."""
    return bpe.encode(docs)


STAGES = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("tokens", tokens)]
#: The stages learn, hash and tokenise, which SQL can't express; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = own_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
    return docs
