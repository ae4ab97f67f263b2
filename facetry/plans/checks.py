"""Registered queries of the exact checks, and their SQL. The SQL works on rows (edges, chords) and 3D vectors, where the
operators work on arrays in the tool's frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.vec import named, rounded, vec
from ..operators import collision, poses
from . import views
from .queries import _CANDIDATES, ANGLES, RADIUS, WIDTH, _framed, _query, _round, _xyz

DEPTH, DEGREES = 0.01, 60.0
_E = "1e-10"
_HALF = f"({WIDTH / 2}e0 + {_E})"


def _dot(a: str, b: str) -> str:
    return "(" + _xyz(f"{a}% * {b}%", " + ") + ")"


def _poses(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of all points, moved by half the width along the axis, with their target."""
    framed = _framed(spark, d).withColumns({f"p{a}": F.col(a) for a in "xyz"})
    return poses.offset(poses.candidates(framed, RADIUS, ANGLES), WIDTH)


def _lean(spark: SparkSession, d: str) -> DataFrame:
    """Of the poses what pairs need."""
    return _poses(spark, d).select(*collision.KEYS, "rho", *[f"{k}{a}" for k in ("", "a", "p") for a in "xyz"])


_POSES = f"""{_CANDIDATES}
, po AS MATERIALIZED (SELECT cd.point_index, cd.branch_id, angle_index AS candidate_index, {_xyz(f"c% + {WIDTH / 2}e0 * a% AS x%")}, {_xyz("a%")}, {_xyz("g.% AS p%")} FROM cd JOIN g_points g USING (point_index)),
bx AS (SELECT *, {_xyz("least(a%, b%, c%) AS l%")}, {_xyz("greatest(a%, b%, c%) AS h%")} FROM g_tris)"""
_CORNERS = ", ".join(f"t.{k}{a} - po.x{a} AS {k}{a}" for k in "abc" for a in "xyz")
_MET = f"""{_POSES}
, bo AS (SELECT *, {_xyz(f"{RADIUS}e0 * sqrt(greatest(0, 1 - a% * a%)) + {WIDTH / 2}e0 * abs(a%) + {_E} AS e%")} FROM po),
pr AS MATERIALIZED (SELECT po.point_index, po.candidate_index, t.face_id, {_xyz("po.a% AS d%")}, {_xyz("po.p% - po.x% AS t%")}, {_CORNERS}
  FROM bo po JOIN bx t ON {_xyz("t.l% <= po.x% + po.e% AND t.h% >= po.x% - po.e%", " AND ")})"""
_EDGES = " UNION ALL ".join(f"SELECT point_index, candidate_index, face_id, {_xyz('d%')}, {_xyz('t%')}, {_xyz(f'{p}% AS p%')}, {_xyz(f'{q}% AS q%')} FROM pr" for p, q in ("ab", "bc", "ca"))
_ID = "point_index, candidate_index, face_id"
_CONTACT = f"""{_MET}
, e0 AS ({_EDGES}),
e1 AS (SELECT *, {_dot('p', 'd')} AS zp, {_dot('q', 'd')} AS zq FROM e0),
e2 AS (SELECT *, CASE WHEN zp = zq THEN 0 ELSE greatest(0, least((-{_HALF} - zp) / (zq - zp), ({_HALF} - zp) / (zq - zp))) END AS s0,
  CASE WHEN zp = zq THEN (CASE WHEN abs(zp) <= {_HALF} THEN 1 ELSE -1 END) ELSE least(1, greatest((-{_HALF} - zp) / (zq - zp), ({_HALF} - zp) / (zq - zp))) END AS s1 FROM e1),
xc0 AS (SELECT e1.*, s.sign, (s.sign * {_HALF} - zp) / (zq - zp) AS f FROM e1, (VALUES (1), (-1)) s(sign) WHERE (s.sign * zp > {_HALF}) <> (s.sign * zq > {_HALF})),
xc1 AS (SELECT {_ID}, sign, {_xyz("any_value(d%) AS d%")}, {_xyz("any_value(t%) AS t%")}, {_xyz("first(p% + f * (q% - p%) ORDER BY f, px) AS u%")}, {_xyz("last(p% + f * (q% - p%) ORDER BY f, px) AS v%")} FROM xc0 GROUP BY ALL),
sg AS (SELECT {_ID}, {_xyz('d%')}, {_xyz('t%')}, {_xyz('p% + s0 * (q% - p%) AS u%')}, {_xyz('p% + s1 * (q% - p%) AS v%')} FROM e2 WHERE s0 <= s1
  UNION ALL SELECT {_ID}, {_xyz('d%')}, {_xyz('t%')}, {_xyz('u%')}, {_xyz('v%')} FROM xc1),
s1 AS (SELECT *, {_dot('u', 'd')} AS zu, {_dot('v', 'd')} AS zv FROM sg),
s2 AS (SELECT *, {_xyz('u% - zu * d% AS ru%')}, {_xyz('v% - zv * d% AS rv%')} FROM s1),
s3 AS (SELECT *, {_xyz('rv% - ru% AS w%')} FROM s2),
s4 AS (SELECT *, {_dot('w', 'w')} AS ww, {_dot('ru', 'w')} AS uw, {_dot('ru', 'ru')} AS uu, {_dot('rv', 'rv')} AS vv FROM s3),
s5 AS (SELECT *, CASE WHEN ww > 1e-24 THEN greatest(0, least(1, -uw / ww)) ELSE 0 END AS t, CASE WHEN ww > 1e-24 AND uw * uw >= ww * (uu - {RADIUS**2!r}) THEN sqrt(uw * uw - ww * (uu - {RADIUS**2!r})) END AS root FROM s4),
s6 AS (SELECT *, uu + 2 * t * uw + t * t * ww AS near, zu + t * (zv - zu) AS zn,
  CASE WHEN uu <= ({RADIUS}e0 + {_E}) ** 2 THEN sqrt({_xyz('(u% - t%) ** 2', ' + ')}) END AS d1, CASE WHEN vv <= ({RADIUS}e0 + {_E}) ** 2 THEN sqrt({_xyz('(v% - t%) ** 2', ' + ')}) END AS d2,
  CASE WHEN (-uw - root) / ww BETWEEN 0 AND 1 THEN sqrt({_xyz('(u% + (-uw - root) / ww * (v% - u%) - t%) ** 2', ' + ')}) END AS d3,
  CASE WHEN (-uw + root) / ww BETWEEN 0 AND 1 THEN sqrt({_xyz('(u% + (-uw + root) / ww * (v% - u%) - t%) ** 2', ' + ')}) END AS d4 FROM s5),
n0 AS (SELECT *, (by - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) AS nz FROM pr),
n1 AS (SELECT *, {_dot('n', 'a')} / {_dot('n', 'd')} AS z0, abs({_dot('n', 'd')}) / sqrt({_dot('n', 'n')}) AS align FROM n0),
""" + ",\n".join(
    f"n{i} AS (SELECT *, nx * ((y{q} - y{p}) * (z0 * dz - z{p}) - (z{q} - z{p}) * (z0 * dy - y{p})) + ny * ((z{q} - z{p}) * (z0 * dx - x{p}) - (x{q} - x{p}) * (z0 * dz - z{p})) + nz * ((x{q} - x{p}) * (z0 * dy - y{p}) - (y{q} - y{p}) * (z0 * dx - x{p})) AS k{i} FROM n{i - 1})".replace(
        "x" + p, p + "x").replace("y" + p, p + "y").replace("z" + p, p + "z").replace("x" + q, q + "x").replace("y" + q, q + "y").replace("z" + q, q + "z")
    for i, (p, q) in enumerate(("ab", "bc", "ca"), 2)
) + f""",
pc AS (SELECT {_ID}, align, CASE WHEN k2 >= 0 AND k3 >= 0 AND k4 >= 0 AND abs(z0) <= {_HALF} THEN z0 END AS z0, sqrt({_xyz('(z0 * d% - t%) ** 2', ' + ')}) AS dz0 FROM n4),
ag AS (SELECT {_ID}, min(near) AS near, arg_min(zn, near) AS zn, greatest(0, max(greatest(zu, zv)) + {WIDTH / 2}e0) AS axial, max(greatest(coalesce(d1, -1), coalesce(d2, -1), coalesce(d3, -1), coalesce(d4, -1))) AS patch FROM s6 GROUP BY ALL),
ct0 AS (SELECT {_ID}, align, axial, CASE WHEN z0 IS NULL THEN near ELSE 0 END AS near, coalesce(z0, zn) AS zw, CASE WHEN patch >= 0 THEN patch ELSE dz0 END AS patch FROM ag JOIN pc USING ({_ID})),
ct AS MATERIALIZED (SELECT *, greatest(0, {RADIUS}e0 - sqrt(near)) AS radial, CASE WHEN abs(abs(zw) - {WIDTH / 2}e0) <= 2e-10 THEN zw <= 0 END AS near_cap FROM ct0 WHERE near <= ({RADIUS}e0 + {_E}) ** 2)"""


@_query(f"{_MET} SELECT point_index, candidate_index, count(*) AS faces FROM pr GROUP BY ALL")
def cylinder_pairs(spark, d):
    """How many triangles' boxes each cylinder's box meets."""
    return collision.pose_boxes(_lean(spark, d), views.triangles(spark, d), RADIUS, WIDTH)


@_query(f"{_CONTACT} SELECT {_ID}, round(least(axial, radial), 6) AS penetration, round(axial, 6) AS axial, round(radial, 6) AS radial, round(patch, 6) AS patch, round(align, 6) AS alignment, near_cap FROM ct")
def cylinder_contact(spark, d):
    """Every triangle that reaches into a cylinder, with its contact."""
    return collision.cylinder_hits(_lean(spark, d), views.triangles(spark, d), RADIUS, WIDTH, 6)


_CHECKED = f"""{_CONTACT}
, ex AS (SELECT *, coalesce(near_cap, true) AND least(axial, radial) <= {DEPTH}e0 + {_E} AND patch <= {2 * RADIUS}e0 + {_E} AND align >= cos(radians({DEGREES}e0)) - 1e-12 AS ok,
  CASE WHEN abs(sqrt(near) - {RADIUS}e0) <= 2e-10 THEN CASE WHEN near_cap IS NULL THEN 'cylinder_side_collision' ELSE 'cylinder_edge_collision' END WHEN near_cap IS NULL THEN 'triangle_interior_collision' ELSE 'cylinder_cap_collision' END AS kind FROM ct),
ck AS (SELECT point_index, candidate_index, bool_and(ok) AS feasible, count(*) FILTER (ok) AS contact_faces, max(CASE WHEN ok THEN least(axial, radial) ELSE 0 END) AS contact_penetration,
  max(CASE WHEN ok THEN patch ELSE 0 END) AS contact_patch, max(least(axial, radial)) AS penetration, arg_min(kind, face_id) FILTER (NOT ok) AS kind FROM ex GROUP BY ALL)"""


@_query(f"""{_CHECKED} SELECT po.point_index, po.candidate_index, coalesce(feasible, true) AS feasible, CASE WHEN NOT feasible THEN kind WHEN contact_faces > 0 THEN 'contact_patch_only_surface_only_non_closed_mesh' ELSE 'safe_surface_only_non_closed_mesh' END AS reason,
  CAST(coalesce(contact_faces, 0) AS BIGINT) AS contact_faces, round(coalesce(contact_penetration, 0), 6) AS contact_penetration, round(coalesce(contact_patch, 0), 6) AS contact_patch, round(coalesce(penetration, 0), 6) AS penetration
  FROM po LEFT JOIN ck USING (point_index, candidate_index)""")
def cylinder_checker(spark, d):
    """The verdict on every pose, with the kind of the first rejecting face."""
    out = collision.check_cylinders(_poses(spark, d), views.triangles(spark, d), RADIUS, WIDTH, False, contact_patch=True, max_penetration=DEPTH, normal_degrees=DEGREES)
    return _round(out.select("point_index", "candidate_index", "feasible", "reason", "contact_faces", "contact_penetration", "contact_patch", "penetration"))


@_query(f"""{_CONTACT}
, fl AS (SELECT unnest(list_filter([CASE WHEN NOT coalesce(near_cap, true) THEN 'near_cap' END, CASE WHEN least(axial, radial) > {DEPTH}e0 + {_E} THEN 'depth' END, CASE WHEN patch > {2 * RADIUS}e0 + {_E} THEN 'patch_distance' END,
  CASE WHEN align < cos(radians({DEGREES}e0)) - 1e-12 THEN 'normal_alignment' END], lambda x: x IS NOT NULL)) AS failed FROM ct)
SELECT failed, count(*) AS n FROM fl GROUP BY ALL""")
def rejecting_conditions(spark, d):
    """How often each condition of the contact patch fails."""
    return collision.failed_counts(_lean(spark, d), views.triangles(spark, d), RADIUS, WIDTH, DEPTH, 2 * RADIUS, DEGREES)


@_query(f"""{_CONTACT} SELECT point_index, candidate_index, CASE WHEN bool_and(coalesce(near_cap, true) AND patch <= {2 * RADIUS}e0 + {_E} AND align >= cos(radians({DEGREES}e0)) - 1e-12) THEN round(max(least(axial, radial)), 6) END AS depth_limit FROM ct GROUP BY ALL""")
def depth_thresholds(spark, d):
    """The depth limit from which on a pose would pass."""
    return _round(collision.pose_depths(_lean(spark, d), views.triangles(spark, d), RADIUS, WIDTH, 2 * RADIUS, DEGREES))


_DISKS = f"""{_POSES}
, pr AS (SELECT po.point_index, po.candidate_index, t.face_id, {_xyz("po.a% AS d%")}, {_xyz("po.p% AS t%")}, {_CORNERS}
  FROM po JOIN bx t ON {_xyz(f"t.l% <= po.x% + {RADIUS}e0 + {_E} AND t.h% >= po.x% - {RADIUS}e0 - {_E}", " AND ")}),
e0 AS ({_EDGES}),
e1 AS (SELECT *, {_dot('p', 'd')} AS zp, {_dot('q', 'd')} AS zq FROM e0),
xc0 AS (SELECT {_ID}, zp / (zp - zq) AS f, {_xyz('p%')}, {_xyz('q%')} FROM e1 WHERE (zp > 0) <> (zq > 0)),
xc1 AS (SELECT {_ID}, {_xyz("first(p% + f * (q% - p%) ORDER BY f, px) AS u%")}, {_xyz("last(p% + f * (q% - p%) ORDER BY f, px) AS v%")} FROM xc0 GROUP BY ALL),
xc2 AS (SELECT *, {_xyz('v% - u% AS w%')} FROM xc1),
xc3 AS (SELECT *, greatest(0, least(1, -{_dot('u', 'w')} / {_dot('w', 'w')})) AS f FROM xc2),
dh AS (SELECT point_index, candidate_index, face_id FROM xc3 WHERE sqrt({_xyz('(u% + f * w%) ** 2', ' + ')}) <= {RADIUS}e0 + {_E})"""


@_query(f"{_DISKS} SELECT * FROM dh")
def disk_pairs(spark, d):
    """Every triangle that a disk meets."""
    return collision.disk_hits(_lean(spark, d), views.triangles(spark, d))


@_query(f"""{_DISKS}
, n AS (SELECT point_index, candidate_index, count(*) AS faces FROM pr GROUP BY ALL)
SELECT po.point_index, po.candidate_index, h.n IS NULL AS feasible, CASE WHEN h.n IS NULL THEN 'safe_surface_only_non_closed_mesh' ELSE 'triangle_disk_segment_plane_intersection' END AS reason, coalesce(n.faces, 0) AS faces
FROM po LEFT JOIN n USING (point_index, candidate_index) LEFT JOIN (SELECT point_index, candidate_index, count(*) AS n FROM dh GROUP BY ALL) h USING (point_index, candidate_index)""")
def disk_checker(spark, d):
    out = collision.check_disks(_poses(spark, d), views.triangles(spark, d), RADIUS, False)
    return out.select("point_index", "candidate_index", "feasible", "reason", "faces")


_R = dict(zip("xyz", (f"{x!r}" for x in collision.RAY), strict=True))


@_query(f"""
, r0 AS (SELECT point_index, x + 32e-10 * {_R['x']} AS ox, y + 32e-10 * {_R['y']} AS oy, z + 32e-10 * {_R['z']} AS oz FROM g_points),
r1 AS (SELECT point_index, ox - ax AS wx, oy - ay AS wy, oz - az AS wz, bx - ax AS ux, by - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz FROM r0, g_tris),
r2 AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM r1),
r3 AS (SELECT *, {" + ".join(f"n{a} * {_R[a]}" for a in "xyz")} AS nd FROM r2),
r4 AS (SELECT *, -{_dot('n', 'w')} / nd AS t FROM r3 WHERE abs(nd) > {_E}),
r5 AS (SELECT *, {", ".join(f"w{a} + t * {_R[a]} AS h{a}" for a in "xyz")}, {_dot('n', 'n')} AS nn FROM r4 WHERE t > {_E}),
r6 AS (SELECT point_index, t, (nx * (hy * vz - hz * vy) + ny * (hz * vx - hx * vz) + nz * (hx * vy - hy * vx)) / nn AS k, (nx * (uy * hz - uz * hy) + ny * (uz * hx - ux * hz) + nz * (ux * hy - uy * hx)) / nn AS m FROM r5)
SELECT g.point_index, coalesce(h.n % 2 = 1, false) AS inside FROM g_points g LEFT JOIN (SELECT point_index, count(DISTINCT round(t, 10)) AS n FROM r6 WHERE k >= -{_E} AND m >= -{_E} AND k + m <= 1 + {_E} GROUP BY ALL) h USING (point_index)""")
def containment_parity(spark, d):
    """Is the number of crossings of each point's ray odd?"""
    return collision.containment(views.points(spark, d), views.triangles(spark, d), ["point_index"])


_FACED = f", pf AS (SELECT point_index, {_xyz('%')}, {', '.join(f'{k}{a}' for k in 'abc' for a in 'xyz')}, {_xyz('n%')} FROM g_points JOIN g_tris ON face_id = point_index JOIN g_normals USING (point_index))"


def _faced(spark: SparkSession, d: str) -> DataFrame:
    """Each point with the triangle and the axis of its number."""
    return views.points(spark, d).join(views.triangles(spark, d), F.col("face_id") == F.col("point_index")).join(views.normals(spark, d), "point_index")


def _sql_segment(p: str, q: str, at: str = "") -> str:
    """Square distance of the point x, y, z to a segment."""
    way = "(" + _xyz(f"({q}% - {p}%) ** 2", " + ") + ")"
    t = "greatest(0, least(1, (" + _xyz(f"(% - {p}%) * ({q}% - {p}%)", " + ") + f") / {way}))"
    return _xyz(f"({p}% + {t} * ({q}% - {p}%) - %) ** 2", " + ")


@_query(f"""{_FACED}
, n0 AS (SELECT *, (by - ay) * (cz - az) - (bz - az) * (cy - ay) AS mx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS my, (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) AS mz FROM pf),
n1 AS (SELECT *, ({_xyz('(% - a%) * m%', ' + ')}) / {_dot('m', 'm')} AS f FROM n0),
n2 AS (SELECT *, {_xyz('% - f * m% AS h%')} FROM n1),
""" + ",\n".join(f"n{i} AS (SELECT *, mx * (({q}y - {p}y) * (hz - {p}z) - ({q}z - {p}z) * (hy - {p}y)) + my * (({q}z - {p}z) * (hx - {p}x) - ({q}x - {p}x) * (hz - {p}z)) + mz * (({q}x - {p}x) * (hy - {p}y) - ({q}y - {p}y) * (hx - {p}x)) AS k{i} FROM n{i - 1})" for i, (p, q) in enumerate(("ab", "bc", "ca"), 3)) + f"""
SELECT point_index, round(CASE WHEN k3 >= 0 AND k4 >= 0 AND k5 >= 0 THEN abs(f) * sqrt({_dot('m', 'm')}) ELSE sqrt(least({_sql_segment('a', 'b')}, {_sql_segment('b', 'c')}, {_sql_segment('c', 'a')})) END, 6) AS distance FROM n5""")
def point_triangle(spark, d):
    """Distance of each point to the triangle of its number."""
    near = shapes.on_triangle(vec(), vec("a"), vec("b"), vec("c"))
    return _round(_faced(spark, d).select("point_index", near["distance"].alias("distance")))


_REL = f"(({_xyz('(% - a%) * n%', ' + ')}))"


@_query(f"""{_FACED}
, q0 AS (SELECT *, {_REL} AS h, {_xyz('% - a% AS r%')} FROM pf), q1 AS (SELECT *, sqrt(greatest(0, {_dot('r', 'r')} - h * h)) AS o FROM q0)
SELECT point_index, round(greatest(0, least(0.3e0 - o, 0.1e0 - abs(h))), 6) AS depth, {_xyz("round(a% - (0.3e0 * sqrt(1 - n% * n%) + 0.1e0 * abs(n%)), 6) + 0.0 AS lo%")},
  {_xyz("round(a% + greatest(-0.1e0, least(0.1e0, h)) * n% + 0.3e0 / o * (r% - h * n%), 6) + 0.0 AS s%")} FROM q1""")
def cylinder_points(spark, d):
    """Each point against a cylinder around the first corner of its triangle: depth, the box's lower corner, and the
    point moved to the side."""
    size = F.lit(0.3), F.lit(0.2)
    low, _ = shapes.cylinder_box(vec("a"), vec("n"), *size)
    side = shapes.to_cylinder(vec(), vec("a"), vec("n"), *size)
    depth = shapes.depth_in_cylinder(vec(), vec("a"), vec("n"), *size)
    return _faced(spark, d).select("point_index", rounded(depth).alias("depth"), *named(low, "lo", 6), *named(side, "s", 6))

