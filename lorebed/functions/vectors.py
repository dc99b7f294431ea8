"""Distances and checks on arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def closeness(distance: Column) -> Column:
    """A score between 0 and 1 that falls with the distance."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


def is_null_or_zero(vector: Column) -> Column:
    return vector.isNull() | F.forall(vector, lambda x: x == 0)


def is_corrupt(vector: Column) -> Column:
    """Null, empty, or with a component that is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNull() | (F.size(vector) == 0) | F.coalesce(bad, F.lit(False))


def halfway(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)
