"""Dense-vector expressions over array columns (JVM side, no Python worker)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / F.greatest(norm(left) * norm(right), F.lit(1e-12))


def absolute_difference(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: F.abs(x - y))


def elementwise_product(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: x * y)


def pair_features(left: Column, right: Column, *numeric: Column) -> Column:
    """[cosine of unit vectors, numerics, |a-b|, a*b] as one float array."""
    head = F.array(dot(left, right).cast("float"), *[n.cast("float") for n in numeric])
    return F.concat(
        head,
        F.transform(absolute_difference(left, right), lambda x: x.cast("float")),
        F.transform(elementwise_product(left, right), lambda x: x.cast("float")),
    )
