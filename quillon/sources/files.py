"""Lists of ids and keys, dumps, and the ways in which results are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(post_id, month): an id a line; the month begins the file's name."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return spark.read.text(path).select(F.trim("value").try_cast("bigint").alias("post_id"), F.regexp_extract(name, r"^(\d{4}-\d{2})_", 1).alias("month")).where("post_id is not null")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key): a key a line, in lower case, without blanks and leading commas; empty lines are passed over."""
    key = F.lower(F.regexp_replace(F.regexp_replace("value", r"^[,\s]+", ""), r"\s+", ""))
    return spark.read.text(path).select(key.alias("key")).where("key <> ''").distinct()


def dump(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(value): the columns between tabs; a null is an empty field."""
    return rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or rows.columns)).alias("value"))


def head(rows: DataFrame, count: int, **types: str) -> DataFrame:
    """The first rows, columns cast as told; what can't be cast is null."""
    return rows.limit(count).select(*(F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in rows.columns))


def write_rolling(lines: DataFrame, path: str, most: int, compression: str = "none") -> None:
    """Text files of at most so many lines."""
    lines.write.mode("overwrite").option("maxRecordsPerFile", most).option("compression", compression).text(path)


def write_sorted(rows: DataFrame, path: str, key: str, files: int) -> None:
    """Files in order of a key, each sorted."""
    rows.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_split(lines: DataFrame, path: str, parts: int) -> None:
    """Packed text files of like size."""
    lines.repartition(parts).write.mode("overwrite").option("compression", "gzip").text(path)


def write_by(rows: DataFrame, path: str, column: str, value: Column | str) -> None:
    """A folder of packed text for each value of a column."""
    rows.select(F.col(column), (F.col(value) if isinstance(value, str) else value).cast("string").alias("value")).write.mode("overwrite").partitionBy(column).option("compression", "gzip").text(path)


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Several tables made from one input; each is one job, and each can be repeated alone."""
    for name, rows in tables.items():
        rows.write.mode(mode).parquet(f"{folder}/{name}")


def write_ids(rows: DataFrame, path: str, most: int = 300_000) -> None:
    """Ids as text, a folder a month, at most so many a file."""
    rows.select("month", F.col("post_id").cast("string").alias("value")).write.mode("overwrite").partitionBy("month").option("maxRecordsPerFile", most).text(path)


def multi_scan(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """Rows of some months of a table partitioned by month; the others aren't read."""
    return spark.read.parquet(path).where(F.col("month").isin(months))
