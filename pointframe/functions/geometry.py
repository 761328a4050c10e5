"""Vectors, planes, balls, boxes and grids as column expressions.

A vector is a tuple of three columns; everything stays inside generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]

#: Coordinates closer than this on every axis are the same point.
EPS = 1e-5


def vec(prefix: str = "", names: str = "xyz", suffix: str = "") -> Vec:
    """Columns such as x, y, z with a prefix and suffix."""
    return tuple(F.col(f"{prefix}{n}{suffix}") for n in names)  # type: ignore[return-value]


def lit(*values: float) -> Vec:
    return tuple(F.lit(float(v)) for v in values)  # type: ignore[return-value]


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))  # type: ignore[return-value]


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))  # type: ignore[return-value]


def scale(k: Column | float, a: Vec) -> Vec:
    return tuple(k * p for p in a)  # type: ignore[return-value]


def divide(a: Vec, k: Column | float) -> Vec:
    return tuple(p / k for p in a)  # type: ignore[return-value]


def negate(a: Vec) -> Vec:
    return tuple(-p for p in a)  # type: ignore[return-value]


def inner_product(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross_product(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(inner_product(a, a))


def squared_distance(a: Vec, b: Vec) -> Column:
    d = sub(b, a)
    return inner_product(d, d)


def squared_distance_kd(a: Column, b: Column) -> Column:
    """Of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: (v - u) * (v - u)), F.lit(0.0), lambda s, t: s + t)


def floating_point_equals(a: Column, b: Column | float, eps: float = EPS) -> Column:
    return F.abs(a - b) < eps


def are_vectors_equal(a: Vec, b: Vec, eps: float = EPS) -> Column:
    """Equal on every axis: a small box, not a small ball."""
    return reduce(Column.__and__, (floating_point_equals(p, q, eps) for p, q in zip(a, b, strict=True)))


def normalized(a: Vec) -> Vec:
    return divide(a, norm(a))


def signed_distance(point: Vec, origin: Vec, normal: Vec) -> Column:
    """From a plane to a point."""
    return inner_product(sub(point, origin), normal)


def plane_contains(point: Vec, origin: Vec, normal: Vec, eps: float = EPS) -> Column:
    return F.abs(signed_distance(point, origin, normal)) < eps


def projection(p: Vec, normal: Vec, s: Vec) -> Vec:
    """``s`` moved along ``normal`` by the inner product of p - s with it: onto p's tangent plane."""
    return add(s, scale(inner_product(sub(p, s), normal), normal))


def in_ball(point: Vec, center: Vec, radius: Column | float) -> Column:
    return squared_distance(center, point) <= radius * radius


def ball_box(point: Vec, center: Vec, radius: Column | float) -> Column:
    """The ball's bounding box: implied by ``in_ball``, and scans can use it."""
    return in_box(point, tuple(c - radius for c in center), tuple(c + radius for c in center))  # type: ignore[arg-type]


def in_box(point: Vec, low: Vec, high: Vec) -> Column:
    return reduce(Column.__and__, ((p >= lo) & (p <= hi) for p, lo, hi in zip(point, low, high, strict=True)))


def in_box_kd(coords: Column, low: Column, high: Column) -> Column:
    return F.forall(F.zip_with(F.zip_with(coords, low, lambda c, lo: c >= lo), F.zip_with(coords, high, lambda c, hi: c <= hi), lambda a, b: a & b), lambda t: t)


def box_center(low: Vec, high: Vec) -> Vec:
    return divide(add(low, high), 2)


def nearest_in_box(point: Vec, low: Vec, high: Vec) -> Vec:
    """The point of a box nearest to ``point``."""
    return tuple(F.least(F.greatest(p, lo), hi) for p, lo, hi in zip(point, low, high, strict=True))  # type: ignore[return-value]


def nearest_in_box_kd(coords: Column, low: Column, high: Column) -> Column:
    return F.zip_with(F.zip_with(coords, low, lambda c, lo: F.greatest(c, lo)), high, lambda c, hi: F.least(c, hi))


def boxes_intersect(low1: Vec, high1: Vec, low2: Vec, high2: Vec) -> Column:
    return reduce(Column.__and__, ((a <= d) & (c <= b) for a, b, c, d in zip(low1, high1, low2, high2, strict=True)))


def boxes_intersect_kd(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    return F.forall(F.zip_with(F.zip_with(low1, high2, lambda a, d: a <= d), F.zip_with(low2, high1, lambda c, b: c <= b), lambda p, q: p & q), lambda t: t)


def balls_intersect(c1: Vec, r1: Column, c2: Vec, r2: Column) -> Column:
    return squared_distance(c1, c2) <= (r1 + r2) * (r1 + r2)


def box_ball_intersect(low: Vec, high: Vec, center: Vec, radius: Column) -> Column:
    return squared_distance(nearest_in_box(center, low, high), center) <= radius * radius


def gaussian(sigma: float, r: Column) -> Column:
    return F.exp(-(r * r) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))


def dgaussian(sigma: float, r: Column) -> Column:
    """Derivative of ``gaussian`` by r."""
    return -r * F.exp(-(r * r) / (2 * sigma * sigma)) / (sigma**3 * math.sqrt(2 * math.pi))


def theta(h: float, r2: Column) -> Column:
    """Smooth fall-off within a radius h, of the squared distance."""
    return F.exp(-r2 / (h * h / 16))


def tokenize(text: Column) -> Column:
    """Words between runs of white space."""
    return F.array_remove(F.split(text, r"\s+"), "")


@dataclass(frozen=True)
class Grid:
    """A regular grid: origin, cell size and number of cells on each axis."""

    x: float
    y: float
    z: float
    dx: float
    dy: float
    dz: float
    sx: int
    sy: int
    sz: int

    @classmethod
    def containing(cls, low: tuple[float, float, float], high: tuple[float, float, float], cells: tuple[int, int, int]) -> Grid:
        """Covers a box with ``cells`` cells and one more on each side."""
        d = [(b - a) / n for a, b, n in zip(low, high, cells, strict=True)]
        return cls(*(a - s for a, s in zip(low, d, strict=True)), *d, *(n + 2 for n in cells))

    def world(self, i: Column, j: Column, k: Column) -> Vec:
        return (F.lit(self.x) + i * F.lit(self.dx), F.lit(self.y) + j * F.lit(self.dy), F.lit(self.z) + k * F.lit(self.dz))

    def cell_of(self, p: Vec) -> Vec:
        """Indices of the cell that holds a point of the grid."""
        return tuple(F.floor((c - o) / s).cast("long") for c, o, s in zip(p, (self.x, self.y, self.z), (self.dx, self.dy, self.dz), strict=True))  # type: ignore[return-value]

    def linear(self, i: Column, j: Column, k: Column) -> Column:
        return i + j * F.lit(self.sx) + k * F.lit(self.sx * self.sy)

    def unlinear(self, index: Column) -> Vec:
        n, m = F.lit(self.sx), F.lit(self.sx * self.sy)
        return (index % n, (F.floor(index / n) % F.lit(self.sy)).cast("long"), F.floor(index / m).cast("long"))
