"""Vector arithmetic on fixed-order double arrays (B47); stays in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp01(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)


def norm(array: Column) -> Column:
    return F.sqrt(total(F.transform(array, lambda v: v * v)))


def distance(left: Column, right: Column) -> Column:
    return F.sqrt(total(F.zip_with(left, right, lambda a, b: (a - b) * (a - b))))


def weighted_distance(left: Column, right: Column, weights: Column) -> Column:
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    return F.sqrt(total(F.zip_with(squares, weights, lambda s, w: s * w)))


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def as_doubles(array: Column) -> Column:
    return F.transform(array, lambda v: v.cast("double"))


def top_dimensions(vector: Column, keys: Column, k: int = 4) -> Column:
    """Names of the ``k`` largest dimensions, ties by position."""
    pairs = F.zip_with(vector, F.sequence(F.lit(0), F.size(vector) - 1), lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.get(keys, p["i"]))
