"""Distances and similarities between array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.transform(col, lambda x: x.cast("double"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_total(F.transform(_doubles(a), lambda x: x * x)))


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def distance_similarity(distance: Column | str) -> Column:
    """1 / (1 + d)."""
    d = F.col(distance) if isinstance(distance, str) else distance
    return 1 / (1 + d)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine; an all-zero vector is similar to nothing (0)."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def similarity_from_distance(distance: Column | str) -> Column:
    """1 - d/2, the search score for a cosine distance."""
    d = F.col(distance) if isinstance(distance, str) else distance
    return 1 - d / 2
