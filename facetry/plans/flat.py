"""Registered queries of nearest points and insides of flat shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.vec import add, cross, dot, named, rounded, scale, sub, vec
from .checks import _FACED, _dot, _faced
from .queries import _query, _round, _xyz


def _near(point: str, p: str, q: str) -> str:
    """Square distance of a point (a prefix) to a segment."""
    way = "(" + _xyz(f"({q}% - {p}%) ** 2", " + ") + ")"
    t = "greatest(0, least(1, (" + _xyz(f"({point}% - {p}%) * ({q}% - {p}%)", " + ") + f") / {way}))"
    return "(" + _xyz(f"({p}% + {t} * ({q}% - {p}%) - {point}%) ** 2", " + ") + ")"


def _two(p: str, q: str, r: str, s: str) -> str:
    """Square distance of two segments: inside both where the lines are nearest there, else at an end of one."""
    u, v, w = (_xyz(x, "|").split("|") for x in (f"({q}% - {p}%)", f"({s}% - {r}%)", f"({p}% - {r}%)"))
    d = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"
    uu, uv, vv, uw, vw = d(u, u), d(u, v), d(v, v), d(u, w), d(v, w)
    det = f"({uu} * {vv} - {uv} * {uv})"
    t, k = f"(({uv} * {vw} - {vv} * {uw}) / {det})", f"(({uu} * {vw} - {uv} * {uw}) / {det})"
    inner = " + ".join(f"({c} + {t} * {a} - {k} * {b}) ** 2" for a, b, c in zip(u, v, w, strict=True))
    return f"CASE WHEN {det} > 1e-24 AND {t} BETWEEN 0 AND 1 AND {k} BETWEEN 0 AND 1 THEN {inner} ELSE least({_near(p, r, s)}, {_near(q, r, s)}, {_near(r, p, q)}, {_near(s, p, q)}) END"


_LINED = f"{_FACED}, ln AS (SELECT pf.*, {_xyz('% AS p%')}, {_xyz('% + 0.3e0 * n% AS q%')} FROM pf)"


@_query(f"{_LINED} SELECT point_index, round(sqrt({_two('p', 'q', 'a', 'b')}), 6) AS distance FROM ln")
def segment_pairs(spark, d):
    """Distance of the segment from each point along its normal to the first edge of its triangle."""
    near = shapes.between_segments(vec(), add(vec(), scale(vec("n"), 0.3)), vec("a"), vec("b"))
    return _round(_faced(spark, d).select("point_index", near["distance"].alias("distance")))


_KNOWN = f"""{_LINED}
, k0 AS (SELECT *, (by - ay) * (cz - az) - (bz - az) * (cy - ay) AS mx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS my, (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) AS mz FROM ln),
k1 AS (SELECT *, ({_xyz('(p% - a%) * m%', ' + ')}) AS one, ({_xyz('(q% - a%) * m%', ' + ')}) AS two, {_dot('m', 'm')} AS mm FROM k0),
k2 AS (SELECT *, {_xyz('p% - one / mm * m% AS h%')}, {_xyz('q% - two / mm * m% AS g%')}, {_xyz('p% + one / (one - two) * (q% - p%) AS i%')} FROM k1)"""


def _inside(h: str) -> str:
    """Is the point of the plane (a prefix) in the triangle a, b, c with the normal m?"""
    turn = lambda p, q: f"mx * (({q}y - {p}y) * ({h}z - {p}z) - ({q}z - {p}z) * ({h}y - {p}y)) + my * (({q}z - {p}z) * ({h}x - {p}x) - ({q}x - {p}x) * ({h}z - {p}z)) + mz * (({q}x - {p}x) * ({h}y - {p}y) - ({q}y - {p}y) * ({h}x - {p}x))"
    return " AND ".join(f"{turn(*e)} >= 0" for e in ("ab", "bc", "ca"))


def _face(point: str, foot: str, height: str) -> str:
    return f"CASE WHEN {_inside(foot)} THEN {height} * {height} / mm ELSE least({_near(point, 'a', 'b')}, {_near(point, 'b', 'c')}, {_near(point, 'c', 'a')}) END"


@_query(f"""{_KNOWN} SELECT point_index, round(CASE WHEN one * two <= 0 AND one <> two AND {_inside('i')} THEN 0 ELSE sqrt(least({_face('p', 'h', 'one')}, {_face('q', 'g', 'two')}, {_two('a', 'b', 'p', 'q')}, {_two('b', 'c', 'p', 'q')}, {_two('c', 'a', 'p', 'q')})) END, 6) AS distance FROM k2""")
def segment_triangle(spark, d):
    """Distance of each triangle to the segment from its point along the normal."""
    near = shapes.segment_and_triangle(vec(), add(vec(), scale(vec("n"), 0.3)), vec("a"), vec("b"), vec("c"))
    return _round(_faced(spark, d).select("point_index", near["distance"].alias("distance")))


@_query(f"{_KNOWN} SELECT point_index, {_inside('h')} AS inside FROM k2")
def feet_inside(spark, d):
    """Does each point's foot on the plane of its triangle lie in the triangle?"""
    normal = cross(sub(vec("b"), vec("a")), sub(vec("c"), vec("a")))
    rows = _faced(spark, d)
    rows = rows.select("*", *named(normal, "m"))
    foot = sub(vec(), scale(vec("m"), dot(sub(vec(), vec("a")), vec("m")) / dot(vec("m"), vec("m"))))
    return rows.select("point_index", shapes.in_triangle(foot, vec("a"), vec("b"), vec("c"), vec("m")).alias("inside"))


_CENTRED = f"{_FACED}, ce AS (SELECT point_index, {', '.join(f'{k}{a} - {a} * 0.1e0 - (a{a} + b{a} + c{a}) / 3 AS {k}{a}' for k in 'abc' for a in 'xy')} FROM pf)"


def _edge(p: str, q: str) -> str:
    way = f"(({q}x - {p}x) ** 2 + ({q}y - {p}y) ** 2)"
    t = f"greatest(0, least(1, -({p}x * ({q}x - {p}x) + {p}y * ({q}y - {p}y)) / {way}))"
    return f"(({p}x + {t} * ({q}x - {p}x)) ** 2 + ({p}y + {t} * ({q}y - {p}y)) ** 2)"


_TURNS = [f"({p}x * {q}y - {p}y * {q}x)" for p, q in ("ab", "bc", "ca")]


@_query(f"""{_CENTRED}, ie AS (SELECT *, least({", ".join(_TURNS)}) >= -1e-12 OR greatest({", ".join(_TURNS)}) <= 1e-12 AS inside FROM ce)
SELECT point_index, inside, round(CASE WHEN inside THEN 0 ELSE sqrt(least({_edge('a', 'b')}, {_edge('b', 'c')}, {_edge('c', 'a')})) END, 6) AS distance FROM ie""")
def polygon_origin(spark, d):
    """Triangles in the plane, laid around the origin: do they hold it, and how far is it?"""
    rows = _faced(spark, d)
    corner = lambda k: F.struct(*[(F.col(f"{k}{a}") - F.col(a) * 0.1 - (F.col(f"a{a}") + F.col(f"b{a}") + F.col(f"c{a}")) / 3).alias(n) for a, n in (("x", "u"), ("y", "v"))])
    rows = rows.select("point_index", F.array(*map(corner, "abc")).alias("corners"))
    near = F.sqrt(shapes.nearest_of_polygon(F.col("corners"))["square"])
    return rows.select("point_index", shapes.in_convex_polygon(F.col("corners")).alias("inside"), rounded(near).alias("distance"))
