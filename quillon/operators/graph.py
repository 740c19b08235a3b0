"""Graphs of users: neighbours, numbering, and a force-directed layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.workspace import shared_folder


def neighbour_sets(links: DataFrame, source: str, target: str) -> DataFrame:
    """(v, neighbours): of both directions, each once, ascending; no loops."""
    e = links.select(F.col(source).alias("v"), F.col(target).alias("w")).where("w is not null and v <> w")
    both = e.union(e.select("w", "v")).distinct()
    return both.groupBy("v").agg(F.sort_array(F.collect_list("w")).alias("neighbours"))


def adjacency_lines(neighbours: DataFrame) -> DataFrame:
    """(value): ``v``, a tab, and its neighbours between tabs."""
    return neighbours.select(F.concat_ws("\t", F.col("v").cast("string"), F.array_join(F.transform("neighbours", lambda n: n.cast("string")), "\t")).alias("value"))


def read_adjacency(lines: DataFrame, column: str = "value") -> DataFrame:
    """(src, dst) from such lines."""
    part = F.split(column, "\t")
    return lines.select(F.get(part, F.lit(0)).alias("src"), F.explode(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))).alias("dst")).where("dst <> ''")


def number_vertices(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(name, id): ids from 0 in order of names.  Ranks are taken in ranged parts whose sizes are summed first."""
    names = edges.select(F.col(src).alias("name")).union(edges.select(F.col(dst))).where("name is not null").distinct()
    ranged = names.repartitionByRange("name").withColumn("__p", F.spark_partition_id())
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    base = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy("name")) - 1
    return ranged.withColumn("o", own).join(F.broadcast(base), "__p").select("name", (F.col("o") + F.col("b")).alias("id"))


def start_layout(vertices: DataFrame, column: str = "v", seed: int = 42) -> DataFrame:
    """(v, x, y) in [-1, 1], from the vertex and the seed alone."""
    at = lambda k: F.pmod(F.xxhash64(F.col(column), F.lit(seed), F.lit(k)), F.lit(2_000_001)) / F.lit(1_000_000.0) - 1
    return vertices.select(F.col(column).alias("v"), at(0).alias("x"), at(1).alias("y")).distinct()


#: Vertices up to which all pairs repel one by one, and cells of the grid beyond.
EXACT, CELLS = 4096, 1024


def _push(dx: Column, dy: Column, area: float, times: Column | None = None) -> list[Column]:
    """Repulsion (fx, fy) of a vertex from another, or from so many at one place."""
    d = F.sqrt(dx * dx + dy * dy)
    size = F.lit(area) / (d * d) - d / F.lit(area)
    size = size if times is None else size * times
    return [(dx / d * size).alias("fx"), (dy / d * size).alias("fy")]


def repulsion(now: DataFrame, n: int, area: float, exact: int = EXACT, cells: int = CELLS) -> DataFrame:
    """(a, fx, fy), several rows a vertex: what pushes each vertex of (v, x, y) away.

    Up to ``exact`` vertices, all pairs.  Beyond, pairs within a cell of a grid and its eight neighbours, which meet by
    an equi-join on the cell, and for the cells beyond those their number of vertices at their centre of mass: the table of cells has
    ``cells`` rows at most and is broadcast, so a round takes n * cells steps at most besides the near pairs."""
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    if n <= exact:
        a, b = now.select(F.col("v").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), now.select(F.col("v").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        return a.crossJoin(b).where("a <> b and (ax <> bx or ay <> by)").select("a", *_push(dx, dy, area))
    box = now.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    side = max(1, math.isqrt(cells))
    at = lambda c, low, high: F.least(F.floor((F.col(c) - low) / F.lit(max(high - low, 1e-300)) * side), F.lit(side - 1)).cast("int")
    placed = now.withColumns({"cx": at("x", box.x0, box.x1), "cy": at("y", box.y0, box.y1)})
    mass = placed.groupBy(F.col("cx").alias("gx"), F.col("cy").alias("gy")).agg(F.count("*").alias("n"), F.avg("x").alias("bx"), F.avg("y").alias("by"))
    own = placed.select(F.col("v").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy")
    far = own.join(F.broadcast(mass), (F.abs(F.col("cx") - F.col("gx")) > 1) | (F.abs(F.col("cy") - F.col("gy")) > 1)).select("a", *_push(dx, dy, area, F.col("n")))
    around = F.array(*(F.struct((F.col("cx") + i).alias("gx"), (F.col("cy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    other = placed.select(F.col("cx").alias("gx"), F.col("cy").alias("gy"), F.col("v").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = own.select("a", "ax", "ay", F.explode(around).alias("g")).select("a", "ax", "ay", "g.*").join(other, ["gx", "gy"]).where("a <> b and (ax <> bx or ay <> by)")
    return far.union(near.select("a", *_push(dx, dy, area)))


def layout(edges: DataFrame, iterations: int = 10, max_delta: float | None = None, area: float | None = None, src: str = "src", dst: str = "dst", seed: int = 42, places: DataFrame | None = None) -> DataFrame:
    """(v, x, y) by Fruchterman and Reingold: every pair repels by ks / d^2 - d / area (see repulsion), every edge attracts by d / k, and
    a step is at most max_delta (left / iterations)^1.5.  Lineage is cut in the shared folder every round."""
    spark = edges.sparkSession
    shared_folder(spark)
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = e.union(e.select("b", "a")).distinct()
    now = (places or start_layout(e.select(F.col("a").alias("v")), "v", seed)).checkpoint()
    n = now.count()
    if not n:
        return now
    max_delta, area = max_delta or float(n), area or float(n * n)
    k = math.sqrt(area / n)
    for i in range(iterations, 0, -1):
        cap = max_delta * (i / iterations) ** 1.5
        a, b = now.select(F.col("v").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), now.select(F.col("v").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        d = F.sqrt(dx * dx + dy * dy)
        toward = e.join(a, "a").join(b, "b").select("a", (-dx * d / F.lit(k)).alias("fx"), (-dy * d / F.lit(k)).alias("fy"))
        force = repulsion(now, n, area).union(toward).groupBy("a").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        size = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
        scale = F.when(size > cap, F.lit(cap) / size).otherwise(F.lit(1.0))
        moved = now.join(force.withColumnRenamed("a", "v"), "v", "left").select("v", (F.col("x") + F.coalesce(F.col("fx") * scale, F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce(F.col("fy") * scale, F.lit(0.0))).alias("y"))
        now = moved.checkpoint()
    return now


def plain_split(numbered: DataFrame, parts: int) -> DataFrame:
    """Numbered vertices in parts of like size, in order of their numbers."""
    total = numbered.agg(F.count("*").alias("__n"))
    return numbered.crossJoin(F.broadcast(total)).withColumn("part", F.floor(F.col("id") * parts / F.col("__n")).cast("int")).drop("__n")  # one row is broadcast


def split_stats(parts: DataFrame, weight: str, part: str = "part") -> DataFrame:
    """(part, vertices, weight) of a split of vertices."""
    return parts.groupBy(part).agg(F.count("*").alias("vertices"), F.sum(weight).alias("weight"))
