"""Analyses of ordered series: lifetimes of daily series, neighbours, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive(series: DataFrame, unit_days: int = 1, array: str = "series") -> DataFrame:
    """(key, units, first, last, freq) of each stretch of a key's series.

    A date belongs to a stretch's unit floor((date - start) / unit) + 1; the stretch goes on while that is at most one more
    than the unit before.  Since a stretch's start depends on the stretch before, one fold over the sorted array does it."""
    day = lambda d: F.unix_date(d.cast("date"))
    kind = "array<struct<units:bigint,first:string,last:string,freq:bigint>>"
    items = F.array_sort(F.col(array))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        unit = F.floor((day(x["date"]) - day(last["first"])) / F.lit(unit_days)).cast("bigint") + 1
        grown = F.struct(unit.alias("units"), last["first"].alias("first"), x["date"].alias("last"), (last["freq"] + x["freq"]).alias("freq"))
        fresh = F.struct(F.lit(1).cast("bigint").alias("units"), x["date"].alias("first"), x["date"].alias("last"), x["freq"].cast("bigint").alias("freq"))
        return F.when(F.size(acc) == 0, F.array(fresh)).when(unit <= last["units"] + 1, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    folded = F.aggregate(items, F.array().cast(kind), lambda acc, x: step(acc, x).cast(kind))
    return series.select("key", F.explode(folded).alias("s")).select("key", "s.units", "s.first", "s.last", "s.freq")


def consecutive_days(frequencies: DataFrame) -> DataFrame:
    """The same for units of one day, as gaps and islands over (key, date, freq) rows, for series too long for one row."""
    by = Window.partitionBy("key").orderBy("date")
    d = F.unix_date(F.col("date").cast("date"))
    rows = frequencies.groupBy("key", "date").agg(F.sum("freq").alias("freq")).withColumn("d", d)
    island = F.sum(F.when(F.col("d") - F.lag("d").over(by) <= 1, 0).otherwise(1)).over(by)
    found = rows.withColumn("island", island).groupBy("key", "island")
    return found.agg((F.max("d") - F.min("d") + 1).cast("long").alias("units"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("freq").alias("freq")).drop("island")


def total_lifetime(frequencies: DataFrame, unit_days: int = 1) -> DataFrame:
    """(key, units, lifespan, days, freq): distinct units with posts, units from the first to the last, days with posts, posts."""
    d = F.unix_date(F.col("date").cast("date"))
    rows = frequencies.select("key", d.alias("d"), "freq")
    start = rows.groupBy("key").agg(F.min("d").alias("d0"))
    unit = F.floor((F.col("d") - F.col("d0")) / F.lit(unit_days))
    found = rows.join(start, "key").groupBy("key")
    return found.agg(F.count_distinct(unit).alias("units"), (F.max(unit) + 1).cast("long").alias("lifespan"), F.count_distinct("d").alias("days"), F.sum("freq").alias("freq"))


def turns(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each row with the next value of its group: (by, order, value, next)."""
    return rows.select(by, order, value, F.lead(value).over(Window.partitionBy(by).orderBy(order)).alias("next"))


def runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, value, run, n): stretches of equal values of each group, in order."""
    w = Window.partitionBy(by).orderBy(order)
    change = F.sum(F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)).over(w)
    return rows.withColumn("run", change).groupBy(by, value, "run").agg(F.count("*").alias("n"))
