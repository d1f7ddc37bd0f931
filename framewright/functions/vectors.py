"""Functions of array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalise(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: F.try_divide(x, size))


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)


def softmax(a: Column) -> Column:
    """Shifted by the maximum, so that no exponential overflows."""
    top = F.array_max(a)
    weights = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda x: x / total)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def argmax(a: Column) -> Column:
    """Position from 0 of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_gap(a: Column) -> Column:
    """The largest element less the second largest; null for fewer than two."""
    ordered = F.sort_array(a, asc=False)
    return F.get(ordered, 0) - F.get(ordered, 1)


def gram(features: Column) -> Column:
    """The products of all pairs of rows of a matrix (channels of positions), by its number of cells, as one array."""
    cells = F.aggregate(features, F.lit(0), lambda n, x: n + F.size(x))
    return F.flatten(F.transform(features, lambda x: F.transform(features, lambda y: dot(x, y) / cells)))
