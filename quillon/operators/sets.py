"""Sets of ids: unions, intersections, differences, repeats; balanced parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(parts: list[DataFrame]) -> DataFrame:
    """Distinct rows of all parts."""
    return reduce(DataFrame.unionByName, parts).distinct()


def intersection(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, parts)


def difference(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of the left, repeats kept, that the right hasn't."""
    return left.join(right, on, "left_anti")


def repeats(rows: DataFrame, column: str) -> DataFrame:
    """One row: distinct values, and rows beyond those."""
    per = rows.groupBy(column).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("distinct_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"))


def users_of(posts: DataFrame, original_user: str | None = None) -> DataFrame:
    """Distinct users of posts and of what they reshare, ascending."""
    own = posts.select("user_id")
    every = own if original_user is None else own.unionByName(posts.select(F.col(original_user).alias("user_id")))
    return every.where("user_id is not null").distinct().orderBy("user_id")


def range_bounds(rows: DataFrame, column: str, parts: int, error: float = 0.001) -> list[float]:
    """Values that divide the rows into parts of like size."""
    return rows.approxQuantile(column, [i / parts for i in range(1, parts)], error)


def snake(rows: DataFrame, weight: str, ties: str, parts: int) -> DataFrame:
    """Rows dealt to parts in turn, forth and back, the heaviest first.

    The rank is global; it is taken in ranged parts whose sizes are summed first, so no task sorts everything."""
    ranged = rows.repartitionByRange(F.col(weight).desc(), F.col(ties)).withColumn("__p", F.spark_partition_id())
    own = F.row_number().over(Window.partitionBy("__p").orderBy(F.col(weight).desc(), F.col(ties)))
    before = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    base = before.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__base")  # one row a partition
    place = F.col("__own") + F.col("__base") - 1
    turn = F.pmod(place, F.lit(2 * parts))
    dealt = ranged.withColumn("__own", own).join(F.broadcast(base), "__p")
    return dealt.withColumn("part", F.when(turn < parts, turn).otherwise(2 * parts - 1 - turn).cast("int")).drop("__p", "__own", "__base")


def halved(rows: DataFrame, weight: str, ties: str, levels: int) -> DataFrame:
    """Rows in 2^levels parts: each part is dealt to two, forth and back, the heaviest first, and again, level by level.

    Ranks within parts come from one range partitioning a level by (part, weight): no task sorts a whole part."""
    now = rows.withColumn("part", F.lit(0))
    order = [F.col("part"), F.col(weight).desc(), F.col(ties)]
    for _ in range(levels):
        ranged = now.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
        own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
        sizes = ranged.groupBy("__p", "part").agg(F.count("*").alias("__n"))  # a row a partition and part
        before = F.coalesce(F.sum("__n").over(Window.orderBy("part", "__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        place = sizes.withColumn("__all", before).withColumn("__first", F.min("__all").over(Window.partitionBy("part"))).withColumn("__base", F.min("__all").over(Window.partitionBy("__p")))
        ranked = ranged.withColumn("__own", own).join(F.broadcast(place.select("__p", "part", "__base", "__first")), ["__p", "part"])
        turn = F.pmod(F.col("__own") - 1 + F.col("__base") - F.col("__first"), F.lit(4))
        now = ranked.withColumn("part", (F.col("part") * 2 + F.when(turn < 2, turn).otherwise(3 - turn)).cast("int")).drop("__p", "__own", "__base", "__first")
    return now
