"""Similarity of documents, sets and clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import jaccard, plogp


def tf_idf(frequencies: DataFrame, n_docs: DataFrame | int) -> DataFrame:
    """(term, doc_id, tfidf): tf ln(N / df)."""
    # a window, not a join, so that terms are found and shuffled once; it spills where a term has many documents
    rows = frequencies.withColumn("df", F.count("*").over(Window.partitionBy("term")))
    if isinstance(n_docs, int):
        return rows.select("term", "doc_id", (F.col("freq") * F.ln(F.lit(n_docs) / F.col("df"))).alias("tfidf"))
    total = n_docs.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(total)).select("term", "doc_id", (F.col("freq") * F.ln(F.col("n") / F.col("df"))).alias("tfidf"))


def cosine_pairs(vectors: DataFrame, row: str, key: str, weight: str, least: float = 0.0) -> DataFrame:
    """(a, b, cosine) of rows a < b that share a key, from tall (row, key, weight).

    The join is on keys, so pairs that share none never meet; norms are joined to the sums."""
    norms = vectors.groupBy(row).agg(F.sqrt(F.sum(F.col(weight).cast("double") * F.col(weight))).alias("norm"))
    left = vectors.select(F.col(row).alias("a"), F.col(key).alias("k"), F.col(weight).cast("double").alias("x"))
    right = vectors.select(F.col(row).alias("b"), F.col(key).alias("k"), F.col(weight).cast("double").alias("y"))
    dots = left.join(right, "k").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    na, nb = norms.select(F.col(row).alias("a"), F.col("norm").alias("na")), norms.select(F.col(row).alias("b"), F.col("norm").alias("nb"))
    found = dots.join(na, "a").join(nb, "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))
    return found.where(F.col("cosine") >= least) if least > 0 else found


def best_of(parts: list[DataFrame]) -> DataFrame:
    """(a, b, similarity): the greatest of several kinds of (a, b, cosine); a kind without a pair counts 0 for it."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("a", "b").agg(F.max("cosine").alias("similarity"))


def similarity_histogram(pairs: DataFrame, step: float, column: str = "cosine") -> DataFrame:
    """(bucket, n): pairs by floor(similarity / step)."""
    return pairs.groupBy(F.floor(F.col(column) / F.lit(step)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def jaccard_pairs(members: DataFrame, row: str, key: str, threshold: float) -> DataFrame:
    """(a, b, jaccard) of rows whose sets of keys overlap enough."""
    sets = members.select(F.col(row).alias("r"), F.col(key).alias("k")).distinct()
    sizes = sets.groupBy("r").agg(F.count("*").alias("n"))
    shared = sets.select(F.col("r").alias("a"), "k").join(sets.select(F.col("r").alias("b"), "k"), "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    found = shared.join(sizes.select(F.col("r").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("r").alias("b"), F.col("n").alias("nb")), "b")
    return found.select("a", "b", jaccard(F.col("both"), F.col("na"), F.col("nb")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def lfk_nmi(left: DataFrame, right: DataFrame, item: str = "item", cluster: str = "cluster") -> DataFrame:
    """One row (nmi): normalised mutual information of two covers, which may overlap, after Lancichinetti, Fortunato and Kertesz.

    H(X_i | Y) is the least over j of H(X_i | Y_j), over those j whose joint counts pass the usual condition, or H(X_i) if none
    does; each is divided by H(X_i), averaged, both ways; nmi = 1 - the mean of the two.  Everything comes from the table
    of overlaps, whose rows are pairs of clusters that share an item, and from cluster sizes; a pair that shares
    none enters through its sizes alone."""
    x = left.select(F.col(item).alias("i"), F.col(cluster).alias("c")).distinct()
    y = right.select(F.col(item).alias("i"), F.col(cluster).alias("c")).distinct()
    total = x.select("i").union(y.select("i")).distinct().agg(F.count("*").cast("double").alias("n"))
    sx, sy = (t.groupBy("c").agg(F.count("*").cast("double").alias("s")) for t in (x, y))
    overlap = x.select("i", F.col("c").alias("cx")).join(y.select("i", F.col("c").alias("cy")), "i").groupBy("cx", "cy").agg(F.count("*").cast("double").alias("o"))

    def one_way(own, other, o):  # noqa: ANN001, ANN202
        pairs = own.select(F.col("c").alias("cx"), F.col("s").alias("sx")).crossJoin(other.select(F.col("c").alias("cy"), F.col("s").alias("sy")))
        rows = pairs.join(o, ["cx", "cy"], "left").crossJoin(F.broadcast(total)).withColumn("o", F.coalesce("o", F.lit(0.0)))
        n = F.col("n")
        p11, p10, p01 = F.col("o") / n, (F.col("sx") - F.col("o")) / n, (F.col("sy") - F.col("o")) / n
        p00 = F.greatest(F.lit(0.0), 1 - p11 - p10 - p01)
        hy, hx = plogp(F.col("sy") / n) + plogp(1 - F.col("sy") / n), plogp(F.col("sx") / n) + plogp(1 - F.col("sx") / n)
        joint = plogp(p11) + plogp(p10) + plogp(p01) + plogp(p00)
        fits = plogp(p11) + plogp(p00) >= plogp(p01) + plogp(p10)
        each = rows.select("cx", hx.alias("hx"), F.when(fits, F.least(hx, F.greatest(F.lit(0.0), joint - hy))).alias("cond"))
        best = each.groupBy("cx").agg(F.first("hx").alias("hx"), F.min("cond").alias("cond"))
        return best.agg(F.avg(F.when(F.col("hx") > 0, F.coalesce("cond", "hx") / F.col("hx")).otherwise(F.lit(0.0))).alias("h"))

    a = one_way(sx, sy, overlap).select(F.col("h").alias("ha"))
    b = one_way(sy, sx, overlap.select(F.col("cy").alias("cx"), F.col("cx").alias("cy"), "o")).select(F.col("h").alias("hb"))
    return a.crossJoin(b).select((1 - (F.col("ha") + F.col("hb")) / 2).alias("nmi"))


def cluster_sizes(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    return members.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("size"))


def largest(members: DataFrame, k: int = 2, cluster: str = "cluster") -> DataFrame:
    """The k largest clusters; ties by name."""
    return cluster_sizes(members, cluster).orderBy(F.col("size").desc(), "cluster").limit(k)


def percentiles(rows: DataFrame, column: str, at: list[float], exact: bool = True) -> DataFrame:
    """One row, a column p<percent> each."""
    f = (lambda q: F.percentile(column, F.lit(q))) if exact else (lambda q: F.percentile_approx(column, q).cast("double"))
    return rows.agg(*(f(q).alias(f"p{round(q * 100)}") for q in at))


def map_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, least, greatest, mean) sizes of maps or arrays."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.size(c).alias("size")) for c in columns)))
    return rows.select(pairs.alias("p")).groupBy("p.column").agg(F.min("p.size").alias("least"), F.max("p.size").alias("greatest"), F.avg("p.size").alias("mean"))


def distinct_by_type(rows: DataFrame, kind: str, marker: str) -> DataFrame:
    """(type, n): distinct markers of each type."""
    return rows.groupBy(F.col(kind).alias("type")).agg(F.count_distinct(marker).alias("n"))
