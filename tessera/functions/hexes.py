"""Axial hexagon geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six neighbour offsets (q, r) in their order.
DIRECTIONS = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]


def distance(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    dq, dr = q1 - q2, r1 - r2
    return ((F.abs(dq) + F.abs(dq + dr) + F.abs(dr)) / 2).cast("int")


def neighbours(q: Column, r: Column) -> Column:
    """Array of struct(side, q, r)."""
    return F.array(*[F.struct(F.lit(i).alias("side"), (q + a).alias("q"), (r + b).alias("r")) for i, (a, b) in enumerate(DIRECTIONS)])


def disc(q: Column, r: Column, d: int) -> Column:
    """Array of struct(q, r) within distance d."""
    cells = [(a, b) for a in range(-d, d + 1) for b in range(max(-d, -a - d), min(d, -a + d) + 1)]
    return F.array(*[F.struct((q + a).alias("q"), (r + b).alias("r")) for a, b in cells])


def ring(q: Column, r: Column, d: int) -> Column:
    return F.filter(disc(q, r, d), lambda c: distance(c["q"], c["r"], q, r) == d)


def rounded(q: Column, r: Column) -> Column:
    """struct(q, r) of the hexagon that holds fractional axial coordinates; halves go to even, the worst of three is repaired."""
    s = -q - r
    a, b, c = F.rint(q), F.rint(r), F.rint(s)
    da, db, dc = F.abs(a - q), F.abs(b - r), F.abs(c - s)
    return F.when((da > db) & (da > dc), F.struct((-b - c).cast("int").alias("q"), b.cast("int").alias("r"))).when(db > dc, F.struct(a.cast("int").alias("q"), (-a - c).cast("int").alias("r"))).otherwise(F.struct(a.cast("int").alias("q"), b.cast("int").alias("r")))


def line(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    """Array of struct(q, r) from one hexagon to another, both included."""
    d = distance(q1, r1, q2, r2)
    at = lambda i: F.when(d == 0, F.lit(0.0)).otherwise(i / d)
    return F.transform(F.sequence(F.lit(0), d), lambda i: rounded(q1 + (q2 - q1) * at(i), r1 + (r2 - r1) * at(i)))


#: Orientation matrices: hexagon to plane (four) and back (four).
FLAT = (1.5, 0.0, math.sqrt(3) / 2, math.sqrt(3), 2 / 3, 0.0, -1 / 3, math.sqrt(3) / 3)
POINTY = (math.sqrt(3), math.sqrt(3) / 2, 0.0, 1.5, math.sqrt(3) / 3, -1 / 3, 0.0, 2 / 3)


def to_pixel(q: Column, r: Column, size: float, layout=POINTY, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    return (layout[0] * q + layout[1] * r) * size + x0, (layout[2] * q + layout[3] * r) * size + y0


def from_pixel(x: Column, y: Column, size: float, layout=POINTY, x0: float = 0.0, y0: float = 0.0) -> Column:
    """struct(q, r) of the hexagon around a point: hexagonal binning."""
    u, v = (x - x0) / size, (y - y0) / size
    return rounded(layout[4] * u + layout[5] * v, layout[6] * u + layout[7] * v)


def to_cube(q: Column, r: Column) -> Column:
    """struct(x, y, z) with a sum of 0."""
    return F.struct(q.alias("x"), (-q - r).alias("y"), r.alias("z"))


def from_cube(x: Column, y: Column, z: Column) -> Column:
    """struct(q, r); cube coordinates whose sum is not 0 are an error."""
    ok = F.assert_true(x + y + z == 0, "cube coordinates must sum to 0").isNull()
    return F.when(ok, F.struct(x.alias("q"), z.alias("r")))


def rectangle(left: int, right: int, top: int, bottom: int) -> Column:
    """Array of struct(q, r) of a closed range of both axes."""
    return F.array(*[F.struct(F.lit(q).alias("q"), F.lit(r).alias("r")) for q in range(left, right + 1) for r in range(top, bottom + 1)])
