"""A session with the settings that the operators assume."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: UTC everywhere, AQE with skew splitting, and runtime Bloom filters on joins; sizes stay the cluster's business.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "quillon", master: str | None = None, **settings: str) -> SparkSession:
    """Get or create a session; keyword settings use ``_`` for the dots of their names."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


#: Bytes of a table, as its files tell, above which its rows aren't dealt out anew.
SMALL = 64 << 20


def spread(table: DataFrame) -> DataFrame:
    """A small table as it was read, its rows dealt out anew if it came in fewer parts than there are cores, as a file of one
    row group does; for work that costs far more than moving the rows.  A table of more than SMALL bytes is never moved."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    plan = table._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > SMALL:
        return table
    parts = plan.toRdd().getNumPartitions()  # a scan has no stage to run for this
    return table.repartition(cores) if parts < cores else table


@contextmanager
def small_parts(table: DataFrame) -> Iterator[None]:
    """While what a table gives is written: as many shuffle partitions as its size asks for, of few MB each, so that what a task sorts stays
    small however large the table is.  A scan's parts are 128 MB at most."""
    spark = table.sparkSession
    parts = table._jdf.queryExecution().toRdd().getNumPartitions()
    now = {"spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * parts)), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(8 << 20)}
    before = {k: spark.conf.get(k, None) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
