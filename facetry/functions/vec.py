"""Vector columns: a vector is three DOUBLE columns named by a prefix and x, y, z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
TINY = 1e-12


def vec(prefix: str = "") -> Vec:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def named(v: Vec, prefix: str = "", digits: int | None = None) -> list[Column]:
    return [(rounded(c, digits) if digits is not None else c).alias(f"{prefix}{a}") for c, a in zip(v, "xyz", strict=True)]


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def scale(a: Vec, s: Column | float) -> Vec:
    return a[0] * s, a[1] * s, a[2] * s


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """Of length one; null where the length is at most 1e-12."""
    n = norm(a)
    n = F.when(n > TINY, n)
    return a[0] / n, a[1] / n, a[2] / n


def angle(a: Vec, b: Vec) -> Column:
    """Degrees between two unit vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))
