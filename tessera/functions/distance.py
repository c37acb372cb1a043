"""Distances of points and vectors as column expressions; arrays of unequal length fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(a: Column, b: Column, f) -> Column:
    same = F.assert_true(F.size(a) == F.size(b), "vectors differ in length").isNull()
    return F.when(same, F.zip_with(a, b, lambda x, y: f(x.cast("double") - y.cast("double"))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(_pairs(a, b, lambda d: d * d)))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, F.abs))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(_pairs(a, b, F.abs))


def minkowski(p: float):
    """The metric of order p >= 1."""
    if p < 1:
        raise ValueError("p must be at least 1")
    return {1: manhattan, 2: euclidean}.get(p) or (lambda a, b: F.pow(_sum(_pairs(a, b, lambda d: F.pow(F.abs(d), F.lit(float(p))))), F.lit(1.0 / p)))


METRICS = {"euclidean": euclidean, "manhattan": manhattan, "chebyshev": chebyshev}


def d2(*pairs: tuple[Column, Column]) -> Column:
    """Squared Euclidean distance of points given coordinate by coordinate."""
    return reduce(lambda s, t: s + t, [(a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")) for a, b in pairs])


def to_segment2(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Squared distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    if not length2:
        return d2((x, F.lit(x1)), (y, F.lit(y1)))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / length2))
    return d2((x, x1 + t * dx), (y, y1 + t * dy))
