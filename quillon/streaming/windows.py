"""Event-time windows over streams, with watermarks for late rows; the same functions serve batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.workspace import new_folder


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "json", files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """A stream of a folder's files; files_per_trigger holds back what comes too fast."""
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def counts(rows: DataFrame, size: str, slide: str | None = None, late: str | None = None, by: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """(start, end, *by, n): tumbling windows, or sliding ones.  Rows later than ``late`` behind the latest are dropped by a
    stream.  A time without zone is taken as UTC, since watermarks need a zone."""
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    if late and rows.isStreaming:
        timed = timed.withWatermark(ts, late)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return timed.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(rows: DataFrame, gap: str, by: str, late: str | None = None, ts: str = "ts") -> DataFrame:
    """(by, start, end, n): stretches of a key without a gap."""
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    if late and rows.isStreaming:
        timed = timed.withWatermark(ts, late)
    found = timed.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return found.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def checkpoint_folder(spark: SparkSession) -> str:
    """A new folder for a stream's progress, in the cluster's shared one where it names one."""
    return new_folder(spark, "stream")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now, and return what it gives: for results that are small, such as windows' counts."""
    spark, name = stream.sparkSession, f"drained_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint_folder(spark)).start()
    query.awaitTermination()
    return spark.table(name)


def echo(stream: DataFrame, folder: str):  # noqa: ANN201
    """Start a stream that appends its rows to Parquet files."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint_folder(stream.sparkSession)).trigger(availableNow=True).start()


def replay(rows: DataFrame, start: str, step_seconds: int, steps: int, ts: str = "ts") -> DataFrame:
    """Rows of so many steps from a start, each with its step's number; [start, end) of each step."""
    at = F.unix_millis(F.col(ts).cast("timestamp")) - F.unix_millis(F.lit(start).cast("timestamp"))
    found = rows.withColumn("step", F.floor(at / F.lit(step_seconds * 1000)).cast("long"))
    return found.where((F.col("step") >= 0) & (F.col("step") < steps))
