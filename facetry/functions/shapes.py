"""Columns about points, segments, triangles and cylinders: nearest points, hits and depths.

A point is three DOUBLE columns (`Vec`); a nearest point comes as STRUCT<distance, x, y, z, ...>. Alternatives are
arrays of such structs, of which the least by distance is taken, the first of equals by their place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import Vec, add, cross, distance, dot, norm, scale, sub

FLAT, SHORT = 1e-14, 1e-24


def of(c: Column) -> Vec:
    """The vector in a struct."""
    return c["x"], c["y"], c["z"]


def struct(v: Vec, **more: Column) -> Column:
    return F.struct(*[c.alias(a) for c, a in zip(v, "xyz", strict=True)], *[c.alias(n) for n, c in more.items()])


def clamp(c: Column, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.greatest(low, F.least(high, c))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once and not once for each place where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def along_segment(point: Vec, start: Vec, end: Vec) -> Column:
    """Where on a segment a point's nearest one is, 0 to 1; 0 on a segment without length."""
    way = sub(end, start)
    length = dot(way, way)
    return F.when(length > SHORT, clamp(dot(sub(point, start), way) / length)).otherwise(0.0)


def on_segment(point: Vec, start: Vec, end: Vec) -> Vec:
    """The segment's point nearest to a point."""
    return of(let(along_segment(point, start, end), lambda t: struct(add(start, scale(sub(end, start), t)))))


def weights(point: Vec, a: Vec, b: Vec, c: Vec) -> tuple[Column, Column, Column]:
    """Barycentric weights of the point's foot in the triangle's plane; null for a degenerate triangle."""
    u, v, w = sub(b, a), sub(c, a), sub(point, a)
    n = cross(u, v)
    area = dot(n, n)
    area = F.when(area > SHORT, area)
    wb, wc = dot(cross(w, v), n) / area, dot(cross(u, w), n) / area
    return 1 - wb - wc, wb, wc


def on_triangle(point: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """The triangle's point nearest to a point, with its distance and weights wa, wb, wc: the foot in the plane if it
    lies inside, else the nearest on the three edges. A degenerate triangle is its edges."""

    def placed(w: Column) -> Column:
        return add(add(scale(a, w["wa"]), scale(b, w["wb"])), scale(c, w["wc"]))

    def near(place: int, w: Column) -> Column:
        return let(struct(placed(w)), lambda at: F.struct(distance(point, of(at)).alias("distance"), F.lit(place).alias("place"), *[at[x].alias(x) for x in "xyz"], *[w[x].alias(x) for x in ("wa", "wb", "wc")]))

    named = lambda *w: F.struct(*[x.alias(n) for x, n in zip(w, ("wa", "wb", "wc"), strict=True)])
    zero = F.lit(0.0)
    ways = [
        let(along_segment(point, a, b), lambda t: near(0, named(1 - t, t, zero))),
        let(along_segment(point, b, c), lambda t: near(1, named(zero, 1 - t, t))),
        let(along_segment(point, c, a), lambda t: near(2, named(t, zero, 1 - t))),
    ]
    inside = lambda w: (w["wa"] >= 0) & (w["wb"] >= 0) & (w["wc"] >= 0)
    return let(named(*weights(point, a, b, c)), lambda w: F.when(inside(w), near(0, w)).otherwise(F.array_min(F.array(*ways))))


def between_segments(p: Vec, q: Vec, r: Vec, s: Vec) -> Column:
    """The nearest points of the segments pq and rs: distance, x, y, z on the first and ox, oy, oz on the second."""
    u, v, w = sub(q, p), sub(s, r), sub(p, r)
    dots = F.struct(dot(u, u).alias("uu"), dot(u, v).alias("uv"), dot(v, v).alias("vv"), dot(u, w).alias("uw"), dot(v, w).alias("vw"))

    def along(d: Column) -> Column:
        det = d["uu"] * d["vv"] - d["uv"] * d["uv"]
        det = F.when(det > SHORT, det)
        return F.struct(((d["uv"] * d["vw"] - d["vv"] * d["uw"]) / det).alias("t"), ((d["uu"] * d["vw"] - d["uv"] * d["uw"]) / det).alias("k"))

    ends = [_pair(p, on_segment(p, r, s), 0), _pair(q, on_segment(q, r, s), 1), _pair(on_segment(r, p, q), r, 2), _pair(on_segment(s, p, q), s, 3)]
    crossing = lambda x: x["t"].between(0, 1) & x["k"].between(0, 1)
    inner = lambda x: _pair(add(p, scale(u, x["t"])), add(r, scale(v, x["k"])), 0)
    return let(let(dots, along), lambda x: F.when(crossing(x), inner(x)).otherwise(F.array_min(F.array(*ends))))


def _pair(one: Vec, two: Vec, place: int) -> Column:
    both = F.struct(*[c.alias(a) for c, a in zip(one, "xyz", strict=True)], *[c.alias(f"o{a}") for c, a in zip(two, "xyz", strict=True)])
    names = ("x", "y", "z", "ox", "oy", "oz")
    return let(both, lambda b: F.struct(distance(of(b), (b["ox"], b["oy"], b["oz"])).alias("distance"), F.lit(place).alias("place"), *[b[n].alias(n) for n in names]))


def segment_and_triangle(p: Vec, q: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """The nearest points of a triangle (x, y, z) and a segment (ox, oy, oz): where the segment pierces the triangle,
    else the nearest of its ends to the triangle and of the edges to it."""
    n = cross(sub(b, a), sub(c, a))
    sides = F.struct(dot(sub(p, a), n).alias("one"), dot(sub(q, a), n).alias("two"))
    at = let(sides, lambda d: F.when((d["one"] * d["two"] <= 0) & (d["one"] != d["two"]), struct(add(p, scale(sub(q, p), d["one"] / (d["one"] - d["two"]))))))

    def pierced(x: Column) -> Column:
        held = F.struct(*[w.alias(k) for w, k in zip(weights(of(x), a, b, c), ("wa", "wb", "wc"), strict=True)])
        return let(held, lambda w: F.when((w["wa"] >= 0) & (w["wb"] >= 0) & (w["wc"] >= 0), _pair(of(x), of(x), 0)))

    def from_end(end: Vec, place: int) -> Column:
        return let(on_triangle(end, a, b, c), lambda x: _pair(of(x), end, place))

    def from_edge(e: Vec, f: Vec, place: int) -> Column:
        return let(between_segments(e, f, p, q), lambda x: _pair(of(x), (x["ox"], x["oy"], x["oz"]), place))

    ways = [from_end(p, 0), from_end(q, 1), from_edge(a, b, 2), from_edge(b, c, 3), from_edge(c, a, 4)]
    return F.coalesce(let(at, pierced), F.array_min(F.array(*ways)))


def in_triangle(point: Vec, a: Vec, b: Vec, c: Vec, normal: Vec, eps: float = 1e-10) -> Column:
    """Is a point of the plane inside: the edges' crosses all have one sign, up to eps."""
    signs = [dot(cross(sub(q, p), sub(point, p)), normal) for p, q in ((a, b), (b, c), (c, a))]
    return (F.least(*signs) >= -eps) | (F.greatest(*signs) <= eps)


def in_convex_polygon(corners: Column, eps: float = 1e-12) -> Column:
    """Is the origin inside an ordered convex polygon, an array of structs with u and v?"""
    after = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    crosses = F.zip_with(corners, after, lambda p, q: p["u"] * q["v"] - p["v"] * q["u"])
    return (F.array_min(crosses) >= -eps) | (F.array_max(crosses) <= eps)


def nearest_of_polygon(corners: Column) -> Column:
    """The point of an ordered convex polygon (structs with u and v) nearest to the origin: square, u, v. The origin
    itself if it lies inside."""
    after = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))

    def near(p: Column, q: Column) -> Column:
        du, dv = q["u"] - p["u"], q["v"] - p["v"]
        length = du * du + dv * dv
        t = F.when(length > SHORT, clamp(-(p["u"] * du + p["v"] * dv) / length)).otherwise(0.0)
        u, v = p["u"] + t * du, p["v"] + t * dv
        return F.struct((u * u + v * v).alias("square"), u.alias("u"), v.alias("v"))

    zero = F.lit(0.0)
    inside = F.struct(zero.alias("square"), zero.alias("u"), zero.alias("v"))
    return F.when((F.size(corners) > 2) & in_convex_polygon(corners), inside).otherwise(F.array_min(F.zip_with(corners, after, near)))


def ray_hit(origin: Vec, direction: Vec, a: Vec, b: Vec, c: Vec, eps: float = 1e-10) -> Column:
    """How far along a unit direction a ray meets the triangle; null where it misses, is parallel, or meets it at or
    before its origin. The triangle's rim counts, up to eps."""
    u, v, w = sub(b, a), sub(c, a), sub(origin, a)
    p = cross(direction, v)
    det = dot(u, p)
    inverse = 1 / F.when(F.abs(det) > eps, det)
    k, q = dot(w, p) * inverse, cross(w, u)
    m, t = dot(direction, q) * inverse, dot(v, q) * inverse
    return F.when((k >= -eps) & (k <= 1 + eps) & (m >= -eps) & (k + m <= 1 + eps) & (t > eps), t)


def cylinder_box(center: Vec, axis: Vec, radius: Column | float, width: Column | float, eps: float = 0.0) -> tuple[Vec, Vec]:
    """The lower and upper corner of the box around a finite cylinder with a unit axis."""
    reach = tuple(radius * F.sqrt(F.greatest(F.lit(0.0), 1 - a * a)) + width / 2 * F.abs(a) + eps for a in axis)
    return sub(center, reach), add(center, reach)


def to_cylinder(point: Vec, center: Vec, axis: Vec, radius: Column | float, width: Column | float) -> Vec:
    """A point moved to the cylinder's side at its height, which is cut at the caps; points on the axis stay on it."""
    rel = sub(point, center)
    height = dot(rel, axis)
    out = sub(rel, scale(axis, height))
    far = norm(out)
    factor = F.when(far > 1e-12, radius / far).otherwise(0.0)
    half = width / 2
    return add(add(center, scale(axis, clamp(height, -half, half))), scale(out, factor))


def depth_in_cylinder(point: Vec, center: Vec, axis: Vec, radius: Column | float, width: Column | float) -> Column:
    """How deep a point lies in a flat-ended cylinder: the least way out through side or caps, 0 outside."""
    rel = sub(point, center)
    height = dot(rel, axis)
    out = norm(sub(rel, scale(axis, height)))
    return F.greatest(F.lit(0.0), F.least(radius - out, width / 2 - F.abs(height)))


def ring_angle(direction: Vec, t: Vec, q: Vec) -> Column:
    """Degrees of a direction around the ring from t towards q, in [0, 360)."""
    degrees = F.pmod(F.degrees(F.atan2(dot(direction, q), dot(direction, t))), F.lit(360.0))
    return F.when(F.abs(degrees - 360) <= 1e-9, 0.0).otherwise(degrees)


def moved(point: Vec, size: Column | float, center: Vec) -> Vec:
    """A normalised point back in its source frame."""
    return add(scale(point, size), center)
