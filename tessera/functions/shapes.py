"""Predicates and algebra of rectangles, boxes and frusta as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("min_x", "min_y", "max_x", "max_y")


def rect(prefix: str = "") -> tuple[Column, ...]:
    """The four edge columns of a rectangle."""
    return tuple(F.col(prefix + e) for e in EDGES)


def _of(r) -> tuple[Column, ...]:
    return tuple(x if isinstance(x, Column) else F.lit(float(x)) for x in r)


def intersects(a, b) -> Column:
    """Closed rectangles: touching edges count."""
    a, b = _of(a), _of(b)
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def contained(inner, outer) -> Column:
    a, b = _of(inner), _of(outer)
    return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])


def holds_point(r, x, y) -> Column:
    a = _of(r)
    x, y = _of((x, y))
    return x.between(a[0], a[2]) & y.between(a[1], a[3])


def in_half_open(x: Column, y: Column, left: float, top: float, width: float, height: float) -> Column:
    """[left, left + width) x [top, top + height)."""
    return (x >= left) & (x < left + width) & (y >= top) & (y < top + height)


def area(r) -> Column:
    a = _of(r)
    return (a[2] - a[0]) * (a[3] - a[1])


def union(a, b) -> tuple[Column, ...]:
    a, b = _of(a), _of(b)
    return (F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def area_increase(a, b) -> Column:
    """What the union of two rectangles adds to the area of the first."""
    return area(union(a, b)) - area(a)


def in_box(values: list[Column], low: list[float], high: list[float]) -> Column:
    """Closed box in any number of dimensions."""
    if not len(values) == len(low) == len(high):
        raise ValueError("bounds and coordinates differ in number")
    return reduce(lambda p, q: p & q, [v.between(a, b) for v, a, b in zip(values, low, high, strict=True)])


def in_frustum(x: Column, y: Column, z: Column, planes: list[tuple[float, float, float, float]]) -> Column:
    """On the inner side of six planes (nx, ny, nz, d)."""
    if len(planes) != 6:
        raise ValueError("a frustum has six planes")
    return reduce(lambda p, q: p & q, [nx * x + ny * y + nz * z + d >= 0 for nx, ny, nz, d in planes])


def box_distance2(values: list[Column], low: list[float], high: list[float]) -> Column:
    """Squared distance of a point to a closed box, 0 inside; a sphere meets the box where it is at most r squared."""
    outside = [F.greatest(F.lit(float(a)) - v, v - F.lit(float(b)), F.lit(0.0)) for v, a, b in zip(values, low, high, strict=True)]
    return reduce(lambda s, t: s + t, [o * o for o in outside])


def centre(r) -> tuple[Column, Column]:
    a = _of(r)
    return (a[0] + a[2]) / 2, (a[1] + a[3]) / 2


def boxes_meet(low_a: list[Column], high_a: list[Column], low_b: list[Column], high_b: list[Column]) -> Column:
    """Closed boxes of any number of dimensions; touching faces count."""
    return reduce(lambda p, q: p & q, [(la <= hb) & (ha >= lb) for la, ha, lb, hb in zip(low_a, high_a, low_b, high_b, strict=True)])


def box_in_frustum(low: list[Column], high: list[Column], planes: list[tuple[float, float, float, float]]) -> Column:
    """Whether no plane has a whole box (three dimensions) on its outer side, by the corner furthest along its normal."""
    corner = lambda n, i: n * (high[i] if n >= 0 else low[i])
    return reduce(lambda p, q: p & q, [corner(nx, 0) + corner(ny, 1) + corner(nz, 2) + d >= 0 for nx, ny, nz, d in planes])
