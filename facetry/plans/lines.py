"""Registered queries of path order, continuity repair, two-side bisectors, spare frames, sampled cylinders, refined arcs and
other axes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vec import add, named, rounded, unit, vec
from ..operators import bisectors, collision, continuity, curves, meshes, normals, patches, poses, refine
from . import views
from .checks import _DISKS, _dot, _poses
from .queries import _CANDIDATES, _JUDGED, _SAMPLES, ANGLES, RADIUS, WIDTH, _framed, _judged, _query, _round, _tangents, _xyz
from .surfaces import _MEMBERS, CONFIG, _mesh, roof_faces, roof_points, roof_vertices

ROUNDS = 6


def _ring(spark: SparkSession, d: str) -> DataFrame:
    """The points of each label in the order of a hash, closed where the label is even."""
    w = Window.partitionBy("branch_id").orderBy(F.md5(F.col("point_index").cast("string")))
    p = views.points(spark, d).select("branch_id", F.col("point_index").alias("a"), F.lead("point_index").over(w).alias("b"), F.first("point_index").over(w).alias("head"))
    closed = F.when(F.col("branch_id") % 2 == 0, F.col("head"))
    return p.select("a", F.coalesce("b", closed).alias("b")).where("b IS NOT NULL")


_ORDERED = """
, rw AS (SELECT branch_id, point_index AS a, row_number() OVER w AS n, lead(point_index) OVER w AS after, lag(point_index) OVER w AS before, first_value(point_index) OVER w AS head,
  last_value(point_index) OVER (PARTITION BY branch_id ORDER BY md5(CAST(point_index AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail, min(point_index) OVER (PARTITION BY branch_id) AS component
  FROM g_points WINDOW w AS (PARTITION BY branch_id ORDER BY md5(CAST(point_index AS VARCHAR)))),
nb AS (SELECT branch_id, component, a, CASE WHEN branch_id % 2 = 0 THEN coalesce(after, head) ELSE after END AS up, CASE WHEN branch_id % 2 = 0 THEN coalesce(before, tail) ELSE before END AS down,
  CASE WHEN branch_id % 2 = 0 THEN component ELSE least(head, tail) END AS start FROM rw),
ws AS (SELECT branch_id, component, a AS vertex_id, CAST(NULL AS BIGINT) AS prior, CAST(0 AS BIGINT) AS seq, CASE WHEN up IS NULL THEN down WHEN down IS NULL THEN up ELSE least(up, down) END AS next, start FROM nb WHERE a = start
  UNION ALL SELECT ws.branch_id, ws.component, ws.next, ws.vertex_id, ws.seq + 1, CASE WHEN nb.up = ws.vertex_id THEN nb.down ELSE nb.up END, ws.start FROM ws JOIN nb ON nb.a = ws.next WHERE ws.next <> ws.start)"""


@_query(f"{_ORDERED} SELECT vertex_id, component, seq FROM ws")
def path_order(spark, d):
    """Open and closed paths put in order from their edges."""
    return curves.ordered(views.points(spark, d).select(F.col("point_index").alias("vertex_id")), _ring(spark, d))


@_query(f"""{_ORDERED}
, cu AS (SELECT component AS branch_id, ws.seq, x, y, z FROM ws JOIN g_points ON point_index = vertex_id),
c0 AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS step, {_xyz("coalesce(lead(%) OVER w, %) - coalesce(lag(%) OVER w, %) AS d%")} FROM cu WINDOW w AS (PARTITION BY branch_id ORDER BY seq))
SELECT branch_id, seq, {_xyz("round(d% / sqrt(dx * dx + dy * dy + dz * dz), 6) + 0.0 AS t%")}, round(sum(step) OVER (PARTITION BY branch_id ORDER BY seq), 6) AS arc_length FROM c0""")
def branch_curves(spark, d):
    """A line drawing as curves with tangents and arc length."""
    vertices = views.points(spark, d).select(F.col("point_index").alias("vertex_id"), "x", "y", "z")
    return _round(curves.split_and_resample(vertices, _ring(spark, d)).select("branch_id", "seq", "tx", "ty", "tz", "arc_length"))


def _jumping(spark: SparkSession, d: str) -> DataFrame:
    """Smooth normals, with a jump at some points, their smoother patch normals, and tangents along x."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    off = F.when(F.col("vec_id") % 7 == 3, 6.0).otherwise(0.4)
    rows = views.embeddings(spark, d).select("vec_id", e(13).alias("u"), e(14).alias("v"), off.alias("k"))
    made = rows.select(F.col("vec_id").alias("point_index"), *named(unit((F.col("u") * F.col("k"), F.col("v") * F.col("k"), F.lit(1.0))), "n"), *named(unit((F.col("u") * 0.2, F.col("v") * 0.2, F.lit(1.0))), "p"))
    curve = views.points(spark, d).select("point_index", "branch_id", "seq", F.lit(1.0).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"))
    return continuity.corrected_tangents(curve.join(made, "point_index"))


@_query(None)
def continuity_repair(spark, d):
    """Normals whose jumps are mended in place, in order; tested against a plain loop."""
    return _round(continuity.repaired(_jumping(spark, d), block=16))


SIDES = bisectors.Sides()
_COSINE = repr(math.cos(math.radians(SIDES.degrees))) + "e0"
_TWO = f"""{_MEMBERS}
, tg AS (SELECT point_index, 0e0 AS tx, 1e0 AS ty, 0e0 AS tz, x, y, z FROM gq),
ctr AS (SELECT {_xyz("avg(%) AS g%")} FROM gv),
ar AS MATERIALIZED (SELECT rk.point_index, rk.rank, rk.face_id, rk.distance, {_xyz("rk.n%")}, {_xyz("md.q% AS m%")}, md.qx - tg.x AS ox, 0e0 AS oy, md.qz - tg.z AS oz FROM rk JOIN md USING (face_id) JOIN tg ON tg.point_index = rk.point_index),
us2 AS (SELECT *, ox / sqrt(ox * ox + oz * oz) AS ux, oz / sqrt(ox * ox + oz * oz) AS uz FROM ar WHERE sqrt(ox * ox + oz * oz) > {SIDES.least_offset}),
op AS (SELECT p.point_index, arg_min({{'x': p.ux - q.ux, 'z': p.uz - q.uz}}, (round(p.ux * q.ux + p.uz * q.uz, 12), p.rank, q.rank)) AS s FROM us2 p JOIN us2 q ON q.point_index = p.point_index GROUP BY ALL),
sp0 AS (SELECT us2.*, CASE WHEN ux * s.x + uz * s.z >= 0 THEN 0 ELSE 1 END AS side FROM us2 JOIN op USING (point_index)),
sp AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) FILTER (side = 0) OVER (PARTITION BY point_index) AS n0, count(*) FILTER (side = 1) OVER (PARTITION BY point_index) AS n1 FROM sp0) WHERE n0 >= 2 AND n1 >= 2 AND n0 + n1 >= 4),
sd AS (SELECT a.point_index, a.side, a.rank AS seed, {_xyz("any_value(a.n%) AS s%")}, count(*) AS support, median(b.distance) AS middle FROM sp a JOIN sp b ON a.point_index = b.point_index AND a.side = b.side AND abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) >= {_COSINE} GROUP BY ALL),
bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_index, side ORDER BY support DESC, middle, seed) AS n FROM sd) WHERE n = 1),
pl AS (SELECT * FROM (SELECT sp.*, support, {_xyz("CASE WHEN sx * nx + sy * ny + sz * nz < 0 THEN -n% ELSE n% END AS a%")}, row_number() OVER (PARTITION BY sp.point_index, sp.side ORDER BY sp.rank) AS n FROM sp JOIN bt ON bt.point_index = sp.point_index AND bt.side = sp.side WHERE abs(sx * nx + sy * ny + sz * nz) >= {_COSINE}) WHERE n <= {SIDES.take}),
pw2 AS (SELECT *, 1 / (distance + greatest({SIDES.least_distance}, median(distance) OVER (PARTITION BY point_index, side))) AS w FROM pl),
dr0 AS (SELECT point_index, side, any_value(support) AS support, {_xyz("sum(w * a%) AS d%")}, {_xyz("avg(m%) AS c%")} FROM pw2 GROUP BY ALL),
dr AS (SELECT point_index, side, support, {_xyz("CASE WHEN dx * (cx - gx) + dy * (cy - gy) + dz * (cz - gz) < 0 THEN -d% ELSE d% END / sqrt(dx * dx + dy * dy + dz * dz) AS d%")} FROM dr0, ctr),
bi AS (SELECT a.point_index, {_xyz("a.d% + b.d% AS e%")}, a.support AS support0, b.support AS support1 FROM dr a JOIN dr b ON a.point_index = b.point_index AND a.side = 0 AND b.side = 1)"""


def _roof_curve(spark: SparkSession, d: str) -> DataFrame:
    return roof_points(spark, d).withColumns({"tx": F.lit(0.0), "ty": F.lit(1.0), "tz": F.lit(0.0)})


@_query(f"{_TWO} SELECT point_index, {_xyz('round(e% / sqrt(ex * ex + ey * ey + ez * ez), 6) + 0.0 AS n%')}, support0, support1, 'projected_offset' AS way FROM bi")
def side_bisectors(spark, d):
    """The inner bisector of the surfaces on either side of lines along the roof."""
    mesh = _mesh(spark, d)
    center = mesh_center(spark, d)
    out = bisectors.two_side_bisectors(_roof_curve(spark, d), mesh.drop("nx", "ny", "nz", "area"), SIDES, center=center)
    return _round(out.select("point_index", "nx", "ny", "nz", "support0", "support1", F.col("by").alias("way")))


def mesh_center(spark: SparkSession, d: str) -> tuple[float, float, float]:
    return tuple(roof_vertices(spark, d).agg(*[F.avg(a) for a in "xyz"]).first())


PATCH = patches.Patch(radius=0.12)


@_query(f"""{_MEMBERS}
, rn AS (SELECT face_id, {_xyz("k% / sqrt(kx * kx + ky * ky + kz * kz) AS r%")} FROM (SELECT face_id, (by - ay) * (cz - az) - (bz - az) * (cy - ay) AS kx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ky, (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) AS kz FROM gt)),
k32 AS (SELECT point_index, face_id FROM kn WHERE n <= {PATCH.faces}),
e32 AS (SELECT ex.point_index, ex.face_id, distance, area, {_xyz("r%")}, row_number() OVER (PARTITION BY ex.point_index ORDER BY round(distance, 9), ex.face_id) AS rank FROM ex JOIN k32 ON k32.point_index = ex.point_index AND k32.face_id = ex.face_id JOIN rn ON rn.face_id = ex.face_id),
a32 AS (SELECT *, distance <= least(greatest(min(distance) OVER w * {PATCH.factor}e0, {PATCH.floor}), {PATCH.radius}e0) AS near, distance <= {PATCH.radius}e0 AS inside FROM e32 WINDOW w AS (PARTITION BY point_index)),
b32 AS (SELECT *, count(*) FILTER (near) OVER w AS n, count(*) FILTER (inside) OVER w AS m FROM a32 WINDOW w AS (PARTITION BY point_index)),
c32 AS MATERIALIZED (SELECT * FROM b32 WHERE rank = 1 OR CASE WHEN n >= {PATCH.least} THEN near WHEN m >= {PATCH.least} THEN rank <= {PATCH.least} ELSE inside END),
s32 AS (SELECT point_index, {_xyz("sum(area * r%) AS s%")} FROM c32 GROUP BY ALL),
t32 AS MATERIALIZED (SELECT c32.*, CASE WHEN rx * sx + ry * sy + rz * sz >= 0 THEN 1 ELSE -1 END AS sign FROM c32 JOIN s32 USING (point_index)),
m32 AS (SELECT point_index, {_xyz(f"sum(area / greatest(distance, {PATCH.floor}) * sign * r%) AS m%")}, abs(avg(sign)) AS sign_consistency, count(*) AS faces, max(distance) AS patch_radius FROM t32 GROUP BY ALL),
u32 AS (SELECT *, {_xyz("m% / sqrt(mx * mx + my * my + mz * mz) AS n%")} FROM m32),
w32 AS (SELECT point_index, max(degrees(acos(greatest(-1, least(1, sign * (rx * nx + ry * ny + rz * nz)))))) AS coherence FROM t32 JOIN u32 USING (point_index) GROUP BY ALL)
SELECT point_index, {_xyz("round(n%, 6) + 0.0 AS n%")}, round(coherence, 4) AS coherence, round(sign_consistency, 6) AS sign_consistency, faces, round(patch_radius, 6) AS patch_radius, faces < {PATCH.least} OR patch_radius > {PATCH.radius}e0 + 1e-12 AS low_support FROM u32 JOIN w32 USING (point_index)""")
def patch_normals(spark, d):
    """Mean directions of the faces next to each point, of a mesh with mixed windings."""
    triangles = normals.gathered(roof_faces(spark, d), roof_vertices(spark, d))
    out = patches.patch_normals(roof_points(spark, d), triangles, PATCH)
    return out.select("point_index", *[rounded(F.col(f"n{a}")).alias(f"n{a}") for a in "xyz"], rounded(F.col("coherence"), 4).alias("coherence"), rounded(F.col("sign_consistency")).alias("sign_consistency"), "faces", rounded(F.col("patch_radius")).alias("patch_radius"), "low_support")


@_query(None)
def continuous_normals(spark, d):
    """Patch normals of the roof's columns with their jumps mended: the whole method; its parts have SQL and loops."""
    i = F.col("point_index")
    curve = _roof_curve(spark, d).withColumns({"branch_id": (i % 16).cast("int"), "seq": F.floor(i / 16)})
    return _round(patches.surface_normals(curve, roof_faces(spark, d), roof_vertices(spark, d), "surface_patch_continuity", patch=PATCH, config=CONFIG))


@_query(f"""
, g0 AS (SELECT point_index, branch_id, seq, {_xyz("% / sqrt(x * x + y * y + z * z) AS u%")} FROM g_points),
g1 AS (SELECT g0.*, {_xyz("n%")}, {_xyz("CASE WHEN mod(point_index, 9) = 4 THEN n% ELSE u% END AS r%")} FROM g0 JOIN g_normals USING (point_index)),
g2 AS (SELECT *, {_xyz("r% - (rx * nx + ry * ny + rz * nz) * n% AS f%")} FROM g1),
g3 AS (SELECT *, CASE WHEN fx * fx + fy * fy + fz * fz > 1e-16 THEN {{'x': fx, 'y': fy, 'z': fz, 'n': sqrt(fx * fx + fy * fy + fz * fz)}} END AS own FROM g2),
g4 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY branch_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back, {_xyz("lead(r%) OVER (PARTITION BY branch_id ORDER BY seq) AS a%")}, {_xyz("lag(r%) OVER (PARTITION BY branch_id ORDER BY seq) AS b%")} FROM g3),
g5 AS (SELECT *, CASE WHEN own IS NOT NULL THEN [own.x, own.y, own.z] WHEN back IS NOT NULL THEN [back.x / back.n, back.y / back.n, back.z / back.n] ELSE [coalesce(ax, bx), coalesce(ay, by), coalesce(az, bz)] END AS c FROM g4),
g6 AS (SELECT *, c[1] - (c[1] * nx + c[2] * ny + c[3] * nz) * nx AS hx, c[2] - (c[1] * nx + c[2] * ny + c[3] * nz) * ny AS hy, c[3] - (c[1] * nx + c[2] * ny + c[3] * nz) * nz AS hz FROM g5)
SELECT point_index, {_xyz("round(h% / sqrt(hx * hx + hy * hy + hz * hz), 5) + 0.0 AS t%")} FROM g6""")
def spare_frames(spark, d):
    """Frames of points some of whose tangents are along the normal."""
    p = views.points(spark, d).join(views.normals(spark, d), "point_index")
    along = F.col("point_index") % 9 == 4
    own = unit(vec())
    curve = p.select("point_index", "branch_id", "seq", "x", "y", "z", *[F.when(along, F.col(f"n{a}")).otherwise(c).alias(f"t{a}") for c, a in zip(own, "xyz", strict=True)])
    out = poses.frames_with_spares(curve, views.normals(spark, d))
    return out.select("point_index", *[rounded(F.col(f"t{a}"), 5).alias(f"t{a}") for a in "xyz"])


def _normal_samples(spark: SparkSession, d: str) -> DataFrame:
    return meshes.surface_samples(views.triangles(spark, d)).select(F.struct("face_id", "kind").alias("sample_id"), "x", "y", "z", "nx", "ny", "nz")


@_query(f"""{_CANDIDATES}{_SAMPLES}
, nr AS (SELECT face_id, {_xyz("k% / sqrt(kx * kx + ky * ky + kz * kz) AS m%")} FROM (SELECT face_id, (by - ay) * (cz - az) - (bz - az) * (cy - ay) AS kx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ky, (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) AS kz FROM g_tris)),
sn AS (SELECT sm.*, {_xyz("m%")} FROM sm JOIN nr USING (face_id)),
nk0 AS (SELECT cd.point_index, cd.angle_index, arg_min({{'f': face_id, 'k': kind, 'x': sn.x, 'y': sn.y, 'z': sn.z, 'mx': mx, 'my': my, 'mz': mz}}, sqrt((cx - sn.x) ** 2 + (cy - sn.y) ** 2 + (cz - sn.z) ** 2), 12) AS l FROM cd, sn GROUP BY cd.point_index, cd.angle_index),
nk AS (SELECT point_index, angle_index, unnest(l) AS s FROM nk0),
dl AS (SELECT cd.point_index, cd.angle_index, s.f AS f, s.k AS kind, s.x - cx AS ux, s.y - cy AS uy, s.z - cz AS uz, s.mx AS mx, s.my AS my, s.mz AS mz, {_xyz("e%")}, {_xyz("a%")} FROM nk JOIN cd USING (point_index, angle_index)),
d1 AS (SELECT *, {_dot('u', 'e')} AS r, {_dot('u', 'a')} AS h, ux * (ay * ez - az * ey) + uy * (az * ex - ax * ez) + uz * (ax * ey - ay * ex) AS t, sqrt({_dot('u', 'u')}) AS distance, -{_dot('u', 'm')} AS o FROM dl),
d2 AS (SELECT *, sqrt(r * r + t * t) AS far, median(o) OVER (PARTITION BY point_index, angle_index) < -1e-9 AS inside FROM d1),
d3 AS (SELECT *, far <= {RADIUS}e0 AND abs(h) <= {WIDTH / 2}e0 AS hit, CASE WHEN far <= {RADIUS}e0 AND abs(h) <= {WIDTH / 2}e0 THEN -least({RADIUS}e0 - far, {WIDTH / 2}e0 - abs(h)) ELSE sqrt(greatest(far - {RADIUS}e0, 0) ** 2 + greatest(abs(h) - {WIDTH / 2}e0, 0) ** 2) END AS plain FROM d2),
d4 AS (SELECT *, CASE WHEN inside THEN least(plain, -greatest(distance, 1e-12)) ELSE plain END AS signed FROM d3),
d5 AS (SELECT point_index, angle_index, min(signed) AS signed, arg_min(CASE WHEN inside THEN 'workpiece_interior_collision' WHEN hit THEN CASE WHEN {WIDTH / 2}e0 - abs(h) <= {RADIUS}e0 - far THEN 'wheel_side_collision' ELSE 'wheel_outer_collision' END
  WHEN far <= {RADIUS}e0 THEN 'wheel_side_collision' WHEN abs(h) <= {WIDTH / 2}e0 THEN 'wheel_outer_collision' ELSE 'wheel_corner_collision' END, signed) AS region FROM d4 GROUP BY ALL)
SELECT point_index, CAST(angle_index AS BIGINT) AS candidate_index, signed >= 0.001e0 AS feasible, CASE WHEN signed < 0.001e0 THEN region ELSE 'safe' END AS reason, round(signed, 6) + 0.0 AS clearance FROM d5""")
def sampled_cylinder(spark, d):
    """Poses against the twelve surface samples nearest to their centre."""
    made = poses.candidates(_framed(spark, d), RADIUS, ANGLES)
    out = poses.sampled_cylinders(made, _normal_samples(spark, d), WIDTH, 0.001, 12)
    return _round(out.select("point_index", "candidate_index", "feasible", "reason", "clearance"))


@_query(f"""{_CANDIDATES}{_SAMPLES}
, nd AS (SELECT point_index, branch_id, angle_index, min(sqrt((cx - sm.x) ** 2 + (cy - sm.y) ** 2 + (cz - sm.z) ** 2)) AS near FROM cd, sm GROUP BY ALL)
SELECT point_index, branch_id, count(*) AS candidates, count(*) FILTER (near - {RADIUS}e0 >= 0) AS feasible, round(max(near) - {RADIUS}e0, 6) AS most, round(min(near) - {RADIUS}e0, 6) AS least FROM nd GROUP BY ALL""")
def pose_clearance(spark, d):
    """The room around the best and the worst pose of every point."""
    samples = meshes.surface_samples(views.triangles(spark, d)).select(F.struct("face_id", "kind").alias("sample_id"), "x", "y", "z")
    out = poses.clearances(poses.candidates(_framed(spark, d), RADIUS, ANGLES), samples)
    return _round(out.groupBy("point_index", "branch_id").agg(F.count("*").alias("candidates"), F.count_if("feasible").alias("feasible"), F.max("clearance").alias("most"), F.min("clearance").alias("least")))


def _disk(spark: SparkSession, d: str):
    return lambda made: collision.check_disks(poses.offset(made, WIDTH), views.triangles(spark, d), RADIUS, False, count=False)


@_query(None)
def arc_boundaries(spark, d):
    """Where rings turn from feasible to not, to a fraction of a degree; tested against 4,096 angles."""
    framed = _framed(spark, d).withColumns({f"p{a}": F.col(a) for a in "xyz"})
    judge = _disk(spark, d)
    states = judge(poses.candidates(framed, RADIUS, ANGLES)).select("point_index", F.col("candidate_index").alias("angle_index"), "feasible")
    return _round(refine.boundaries(framed, states, ANGLES, RADIUS, judge, ROUNDS))


def _envelope(spark: SparkSession, d: str):
    samples = meshes.surface_samples(views.triangles(spark, d))
    return lambda made: poses.envelope(made, samples, RADIUS)


@_query(f"""{_JUDGED}
, zr AS (SELECT point_index FROM jd GROUP BY ALL HAVING NOT bool_or(feasible)),
fa AS (SELECT vec_id AS point_index, {", ".join(f"CAST(embedding[{19 + i}] AS DOUBLE) AS f{a}" for i, a in enumerate("xyz"))} FROM embeddings),
fb AS (SELECT point_index, {_xyz("n%")}, {_xyz("f% / sqrt(fx * fx + fy * fy + fz * fz) AS f%")} FROM fa JOIN zr USING (point_index) JOIN g_normals USING (point_index)),
ax0 AS (SELECT point_index, 0 AS axis_index, {_xyz("n% AS a%")} FROM fb UNION ALL SELECT point_index, 2, {_xyz("f%")} FROM fb UNION ALL SELECT point_index, 3, {_xyz("n% + f%")} FROM fb),
ax1 AS (SELECT point_index, axis_index, {_xyz("a% / sqrt(ax * ax + ay * ay + az * az) AS a%")} FROM ax0),
ft AS (SELECT ax1.*, {_xyz("tg.%")}, {_xyz("t% - (tx * ax + ty * ay + tz * az) * a% AS g%")} FROM ax1 JOIN tg USING (point_index)),
f9 AS (SELECT *, {_xyz("g% / sqrt(gx * gx + gy * gy + gz * gz) AS s%")} FROM ft),
fq AS (SELECT *, ay * sz - az * sy AS qx, az * sx - ax * sz AS qy, ax * sy - ay * sx AS qz FROM f9),
fp AS (SELECT point_index, axis_index, {_xyz("a%")}, k, {_xyz(f"% + {RADIUS}e0 * (cos(k * 2 * pi() / {ANGLES}) * s% + sin(k * 2 * pi() / {ANGLES}) * q%) AS c%")} FROM fq, (SELECT unnest(range({ANGLES})) AS k)),
fh AS (SELECT DISTINCT point_index, axis_index, k FROM fp, sm WHERE {_xyz(f"abs(c% - %) < {RADIUS}e0", " AND ")} AND sqrt({_xyz("(c% - %) ** 2", " + ")}) < {RADIUS}e0),
fc AS (SELECT point_index, axis_index, {_xyz("a%")}, count(*) FILTER (fh.k IS NULL) AS feasible FROM fp LEFT JOIN fh USING (point_index, axis_index, k) GROUP BY ALL)
SELECT point_index, axis_index, {_xyz("round(a%, 6) + 0.0 AS a%")}, feasible FROM (SELECT *, row_number() OVER (PARTITION BY point_index ORDER BY feasible DESC, axis_index) AS n FROM fc WHERE feasible > 0) WHERE n = 1""")
def other_axes(spark, d):
    """Axes that give a pose to points without one: the normal (again, also twice), another direction, and their sum."""
    third = unit(tuple(F.element_at("embedding", 19 + i).cast("double") for i in range(3)))
    e = views.embeddings(spark, d).select(F.col("vec_id").alias("point_index"), *named(third, "f")).join(views.normals(spark, d), "point_index")
    lists = [vec("n"), vec("n"), vec("f"), add(vec("n"), vec("f"))]
    axes = e.select("point_index", F.explode(F.array(*[F.struct(F.lit(i).alias("axis_index"), *named(v, "a")) for i, v in enumerate(lists)])).alias("x")).select("point_index", "x.*")
    return _round(refine.other_axes(_tangents(spark, d), _judged(spark, d), axes, ANGLES, RADIUS, _envelope(spark, d)))


@_query(f"""{_DISKS}{_SAMPLES}
, eh AS (SELECT DISTINCT point_index, candidate_index FROM dh),
ev AS (SELECT DISTINCT po.point_index, po.candidate_index FROM po, sm WHERE {_xyz(f"abs(po.x% - sm.%) < {RADIUS}e0", " AND ")} AND sqrt({_xyz("(po.x% - sm.%) ** 2", " + ")}) - {RADIUS}e0 < 0),
fl AS (SELECT (point_index, candidate_index) NOT IN (SELECT (point_index, candidate_index) FROM eh) AS exact, (point_index, candidate_index) NOT IN (SELECT (point_index, candidate_index) FROM ev) AS baseline FROM po)
SELECT exact, baseline, CASE WHEN exact THEN 'safe_surface_only_non_closed_mesh' ELSE 'triangle_disk_segment_plane_intersection' END AS reason, count(*) AS n FROM fl GROUP BY ALL""")
def exact_and_envelope(spark, d):
    """How often the exact disk check and the spherical envelope agree."""
    made = _poses(spark, d)
    exact = collision.check_disks(made, views.triangles(spark, d), RADIUS, False, count=False)
    return refine.compared(exact, poses.envelope(made, meshes.surface_samples(views.triangles(spark, d)), RADIUS))
