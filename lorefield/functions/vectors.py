"""Vector expressions; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    from lorefield.functions.arrays import let

    return let(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / F.nullif(n, F.lit(0.0))))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similarity_from_distance(distance: Column) -> Column:
    """1 - distance; a missing distance scores 0."""
    return F.lit(1.0) - F.coalesce(distance, F.lit(1.0))


def has_dimension(vector: Column, dim: int) -> Column:
    return F.coalesce(F.size(vector) == dim, F.lit(False))
