"""Arithmetic of sparse vectors held as maps, sets and counts; entropies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_squares(counts: Column) -> Column:
    """Of a map's values."""
    return F.aggregate(F.map_values(counts), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Over the keys that both maps have."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(both, F.lit(0.0), lambda s, k: s + F.get(F.map_values(F.map_filter(a, lambda x, _: x == k)), F.lit(0)).cast("double") * F.get(F.map_values(F.map_filter(b, lambda x, _: x == k)), F.lit(0)).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Of two maps; 0 where either is empty."""
    norm = F.sqrt(sum_squares(a)) * F.sqrt(sum_squares(b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def set_cosine(a: Column, b: Column) -> Column:
    """Of two sets held as arrays."""
    norm = F.sqrt(F.size(a).cast("double") * F.size(b).cast("double"))
    return F.when(norm > 0, F.size(F.array_intersect(a, b)) / norm).otherwise(F.lit(0.0))


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    """From the sizes of the intersection and of both sets."""
    union = a + b - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def tf_idf(tf: Column, n_docs: Column, df: Column) -> Column:
    return tf * F.ln(n_docs / df)


def plogp(p: Column) -> Column:
    """-p ln p, and 0 at 0."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))
