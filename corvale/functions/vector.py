"""Vector functions over array columns, summed as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Of length one; null for a zero vector."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    """Inner product of the unit vectors; null if one is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def checked(a: Column, dimension: int) -> Column:
    """The vector; fails if it has another dimension."""
    return F.when(F.size(a) == dimension, a).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimension} dimensions, got "), F.size(a).cast("string"))).cast("array<float>"))
