"""The registered geometry queries over the views, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import angle, distance, dot, named, rounded, unit, vec
from ..operators import curves, meshes, orientation, paths, poses, spatial
from ..sources import text
from . import views
from .views import with_views

RADIUS, ANGLES, WIDTH = 0.05, 24, 0.02
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


def _round(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits."""
    return df.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _xyz(template: str, join: str = ", ") -> str:
    return join.join(template.replace("%", a) for a in "xyz")


_TANGENTS = f"""
, t0 AS (SELECT *, {_xyz("coalesce(lead(%) OVER w, %) - coalesce(lag(%) OVER w, %) AS d%")} FROM g_points WINDOW w AS (PARTITION BY branch_id ORDER BY seq)),
t1 AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM t0),
tg AS (SELECT point_index, branch_id, seq, x, y, z, CASE WHEN n > 1e-12 THEN dx / n ELSE 1 END AS tx, CASE WHEN n > 1e-12 THEN dy / n ELSE 0 END AS ty,
       CASE WHEN n > 1e-12 THEN dz / n ELSE 0 END AS tz FROM t1)"""
_FRAMES = f"""{_TANGENTS}
, f0 AS (SELECT tg.*, nx, ny, nz, tx * nx + ty * ny + tz * nz AS d FROM tg JOIN g_normals USING (point_index)),
f1 AS (SELECT *, {_xyz("t% - d * n% AS g%")} FROM f0),
f2 AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS n FROM f1),
f3 AS (SELECT point_index, branch_id, seq, x, y, z, {_xyz("g% / n AS tx".replace("tx", "t%"))}, nx AS ax, ny AS ay, nz AS az FROM f2),
fr AS (SELECT *, ay * tz - az * ty AS qx, az * tx - ax * tz AS qy, ax * ty - ay * tx AS qz FROM f3)"""
_SAMPLES = f"""
, sm AS (SELECT face_id, 'corner_a' AS kind, ax AS x, ay AS y, az AS z FROM g_tris UNION ALL SELECT face_id, 'corner_b', bx, by, bz FROM g_tris
  UNION ALL SELECT face_id, 'corner_c', cx, cy, cz FROM g_tris UNION ALL SELECT face_id, 'centroid', {_xyz("(a% + b% + c%) / 3")} FROM g_tris
  UNION ALL SELECT face_id, 'edge_ab', {_xyz("(a% + b%) / 2")} FROM g_tris UNION ALL SELECT face_id, 'edge_bc', {_xyz("(b% + c%) / 2")} FROM g_tris
  UNION ALL SELECT face_id, 'edge_ca', {_xyz("(c% + a%) / 2")} FROM g_tris)"""
_CANDIDATES = f"""{_FRAMES}
, c0 AS (SELECT *, k AS angle_index, k * (2 * pi() / {ANGLES}) AS angle FROM fr, (SELECT unnest(range({ANGLES})) AS k)),
c1 AS (SELECT *, {_xyz("cos(angle) * t% + sin(angle) * q% AS e%")} FROM c0),
cd AS (SELECT point_index, branch_id, seq, angle_index, angle, {_xyz("t%")}, {_xyz("q%")}, {_xyz("a%")}, {_xyz("e%")}, {_xyz("% + " + str(RADIUS) + "e0 * e% AS c%")} FROM c1)"""
_JUDGED = f"""{_CANDIDATES}{_SAMPLES}
, jd AS (SELECT cd.*, NOT coalesce(h.hit, false) AS feasible FROM cd LEFT JOIN (
    SELECT point_index, angle_index, bool_or(sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y) + (cz - z) * (cz - z)) - {RADIUS}e0 < 0) AS hit
    FROM cd, sm WHERE abs(cx - x) < {RADIUS}e0 AND abs(cy - y) < {RADIUS}e0 AND abs(cz - z) < {RADIUS}e0 GROUP BY ALL) h USING (point_index, angle_index))"""


def _tangents(spark: SparkSession, d: str) -> DataFrame:
    return curves.tangents(views.points(spark, d))


def _framed(spark: SparkSession, d: str) -> DataFrame:
    return poses.frames(_tangents(spark, d), views.normals(spark, d))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    made = poses.candidates(_framed(spark, d), RADIUS, ANGLES)
    return poses.envelope(made, meshes.surface_samples(views.triangles(spark, d)), RADIUS)


@_query(f"{_JUDGED} SELECT point_index, branch_id, count(*) AS candidates, count(*) FILTER (feasible) AS feasible, count(DISTINCT angle_index) FILTER (feasible) AS angles FROM jd GROUP BY ALL")
def pose_feasibility(spark, d):
    return poses.point_rollup(_judged(spark, d))


@_query(f"{_JUDGED} SELECT branch_id, CASE WHEN feasible THEN 'safe' ELSE 'wheel_outer_collision' END AS reason, count(*) AS n FROM jd GROUP BY ALL")
def reason_counts(spark, d):
    return poses.reason_counts(_judged(spark, d))


@_query(f"{_TANGENTS} SELECT point_index, {_xyz('round(t%, 6) + 0.0 AS t%')} FROM tg")
def curve_tangents(spark, d):
    return _round(_tangents(spark, d).select("point_index", "tx", "ty", "tz"))


_ARC = """
, st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS step FROM g_points WINDOW w AS (PARTITION BY branch_id ORDER BY seq)),
arc AS (SELECT point_index, branch_id, seq, x, y, z, sum(step) OVER (PARTITION BY branch_id ORDER BY seq) AS arc_length FROM st)"""


@_query(f"{_ARC} SELECT point_index, branch_id, round(arc_length, 6) AS arc_length FROM arc")
def curve_arc_length(spark, d):
    return _round(curves.arc_lengths(views.points(spark, d)).select("point_index", "branch_id", "arc_length"))


_ALLOCATION = f"""{_ARC}
, ln AS (SELECT branch_id, max(arc_length) AS length FROM arc GROUP BY branch_id),
sh AS (SELECT *, greatest(2, CAST(round_even(997e0 * length / sum(length) OVER (), 0) AS BIGINT)) AS share, branch_id = max(branch_id) OVER () AS final FROM ln),
al AS (SELECT branch_id, length, CASE WHEN final THEN greatest(2, 997 - sum(CASE WHEN final THEN 0 ELSE share END) OVER ()) ELSE share END AS points FROM sh)"""


@_query(f"{_ALLOCATION} SELECT branch_id, round(length, 6) AS length, CAST(points AS BIGINT) AS points FROM al")
def curve_allocation(spark, d):
    return _round(curves.allocation(views.points(spark, d), 997))


@_query(f"""{_ALLOCATION}
, sg AS (SELECT *, lead(arc_length) OVER w AS n_arc, {_xyz("lead(%) OVER w AS n%")} FROM arc WINDOW w AS (PARTITION BY branch_id ORDER BY seq)),
tt AS (SELECT branch_id, k AS target, k * (length / (points - 1)) AS s FROM al, (SELECT unnest(range(997)) AS k) WHERE k < points),
jn AS (SELECT tt.branch_id, target, s, sg.*, row_number() OVER (PARTITION BY tt.branch_id, target ORDER BY sg.seq) AS n FROM tt JOIN sg ON tt.branch_id = sg.branch_id AND n_arc >= s - 1e-9)
SELECT branch_id, target, {_xyz("round(% + (n% - %) * CASE WHEN n_arc > arc_length THEN (s - arc_length) / (n_arc - arc_length) ELSE 0 END, 5) + 0.0 AS %")} FROM jn WHERE n = 1""")
def curve_resample(spark, d):
    out = curves.resample(views.points(spark, d), 997)
    return out.select("branch_id", "target", *[rounded(F.col(a), 5).alias(a) for a in "xyz"])


@_query("""
, r AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM e_seq WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY seq) AS run FROM r)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(seq) AS start, max(seq) + 1 AS "end" FROM g GROUP BY ALL""")
def branch_runs(spark, d):
    return curves.runs(views.sequences(spark, d), "user_id", "seq", "event_type")


@_query("""
, st AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS step FROM g_points WINDOW w AS (PARTITION BY branch_id ORDER BY seq)),
lim AS (SELECT branch_id, greatest(1.5e0 * median(step) FILTER (step > 0), 1e-8) AS lim FROM st GROUP BY ALL)
SELECT point_index, branch_id, seq, CAST(sum(CASE WHEN step > lim THEN 1 ELSE 0 END) OVER (PARTITION BY branch_id ORDER BY seq) AS BIGINT) AS part FROM st JOIN lim USING (branch_id)""")
def branch_gaps(spark, d):
    return curves.gaps(views.points(spark, d), 1.5)


@_query("""
, un AS (SELECT a, b FROM g_edges UNION SELECT b, a FROM g_edges),
cc AS (SELECT point_index AS vertex_id, point_index AS reached FROM g_points UNION SELECT cc.vertex_id, un.b FROM cc JOIN un ON cc.reached = un.a)
SELECT vertex_id, min(reached) AS component FROM cc GROUP BY vertex_id""")
def components(spark, d):
    return curves.components(views.points(spark, d).select(F.col("point_index").alias("vertex_id")), views.edges(spark, d))


@_query(f"""
, bx AS (SELECT {_xyz("(min(%) + max(%)) / 2 AS m%")}, greatest({_xyz("max(%) - min(%)")}) AS size FROM g_points)
SELECT point_index, branch_id, seq, {_xyz("round((% - m%) / size, 6) + 0.0 AS %")} FROM g_points, bx""")
def bbox_normalize(spark, d):
    return _round(meshes.bbox_normalize(views.points(spark, d)))


_METRICS = f"""
, e0 AS (SELECT *, {_xyz("b% - a% AS u%")}, {_xyz("c% - a% AS w%")} FROM g_tris),
e1 AS (SELECT *, uy * wz - uz * wy AS kx, uz * wx - ux * wz AS ky, ux * wy - uy * wx AS kz FROM e0),
mt AS (SELECT *, sqrt(kx * kx + ky * ky + kz * kz) AS n FROM e1)"""


@_query(f"""{_METRICS} SELECT face_id, {_xyz("round(CASE WHEN n > 1e-12 THEN k% / n END, 6) + 0.0 AS n%")}, round(n / 2, 6) AS area,
{_xyz("round((a% + b% + c%) / 3, 6) + 0.0 AS m%")}, n > 1e-12 AS valid FROM mt""")
def triangle_metrics(spark, d):
    return _round(meshes.metrics(views.triangles(spark, d)).select("face_id", "nx", "ny", "nz", "area", "mx", "my", "mz", "valid"))


@_query(f"{_SAMPLES} SELECT face_id, kind, {_xyz('round(%, 6) + 0.0 AS %')} FROM sm")
def surface_samples(spark, d):
    return _round(meshes.surface_samples(views.triangles(spark, d)).select("face_id", "kind", "x", "y", "z"))


def _vertices(spark: SparkSession, d: str) -> DataFrame:
    return views.points(spark, d).select(F.col("point_index").alias("vertex_id"), "x", "y", "z")


@_query(f"""
, tr AS (SELECT v0, v1, v2, {_xyz("b.% - a.% AS u%")}, {_xyz("c.% - a.% AS w%")} FROM g_topo JOIN g_points a ON a.point_index = v0 JOIN g_points b ON b.point_index = v1 JOIN g_points c ON c.point_index = v2),
k AS (SELECT *, uy * wz - uz * wy AS kx, uz * wx - ux * wz AS ky, ux * wy - uy * wx AS kz FROM tr),
kn AS (SELECT *, sqrt(kx * kx + ky * ky + kz * kz) AS n FROM k),
ex AS (SELECT unnest([v0, v1, v2]) AS vertex_id, kx / n AS nx, ky / n AS ny, kz / n AS nz FROM kn WHERE n > 1e-12),
sm AS (SELECT vertex_id, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM ex GROUP BY vertex_id),
ln AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS n FROM sm)
SELECT vertex_id, {_xyz("round(CASE WHEN n > 1e-12 THEN n% / n END, 5) + 0.0 AS n%")} FROM ln""")
def vertex_normals(spark, d):
    out = meshes.vertex_normals(views.topology(spark, d), _vertices(spark, d))
    return out.select("vertex_id", *[rounded(F.col(f"n{a}"), 5).alias(f"n{a}") for a in "xyz"])


@_query("""
, e AS (SELECT least(p, q) AS a, greatest(p, q) AS b, count(*) AS uses FROM (SELECT v0 AS p, v1 AS q FROM g_topo UNION ALL SELECT v1, v2 FROM g_topo UNION ALL SELECT v2, v0 FROM g_topo) GROUP BY ALL)
SELECT bool_and(uses = 2) AS closed, count(*) FILTER (uses <> 2) AS open_edges FROM e""")
def closed_mesh(spark, d):
    return meshes.closed(views.topology(spark, d))


@_query("SELECT round(sum(ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)) / 6, 6) AS volume FROM g_tris")
def signed_volume(spark, d):
    return _round(meshes.signed_volume(views.triangles(spark, d)))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return meshes.surface_samples(views.triangles(spark, d)).select("face_id", "kind", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"))


_KNN = """, nn AS (SELECT p.point_index, s.face_id, s.kind, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2 + (p.z - s.z) ** 2) AS distance FROM g_points p, sm s),
rk AS (SELECT *, row_number() OVER (PARTITION BY point_index ORDER BY distance, face_id, kind) AS rank FROM nn)"""


@_query(f"{_SAMPLES}{_KNN} SELECT point_index, face_id, kind, round(distance, 6) AS distance, rank FROM rk WHERE rank <= 8")
def knn_samples(spark, d):
    near = spatial.nearest(views.points(spark, d), _samples(spark, d), "point_index", ["face_id", "kind"], 8)
    return _round(near.select("point_index", "face_id", "kind", "distance", F.col("rank").cast("long").alias("rank")))


@_query("""
, nn AS (SELECT p.point_index, c.point_id, sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2) AS distance FROM g_points p, g_cloud c WHERE c.label = 1)
SELECT point_index, point_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_index ORDER BY distance, point_id) AS r FROM nn) WHERE r = 1""")
def nearest_flash(spark, d):
    flash = views.cloud(spark, d).where("label = 1").select("point_id", *[F.col(a).alias(f"q{a}") for a in "xyz"])
    return _round(spatial.nearest(views.points(spark, d), flash, "point_index", ["point_id"]).select("point_index", "point_id", "distance"))


_HAUS = """SELECT max(m) AS m FROM (SELECT a.point_index, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS m FROM {} a, {} b GROUP BY ALL)"""


@_query(f"""
, c AS (SELECT point_id AS point_index, x, y, z FROM g_cloud), p AS (SELECT point_index, x, y, z FROM g_points)
SELECT round(greatest((SELECT m FROM ({_HAUS.format("p", "c")})), (SELECT m FROM ({_HAUS.format("c", "p")}))), 6) AS distance""")
def symmetric_nearest(spark, d):
    p = views.points(spark, d).select("point_index", "x", "y", "z")
    c = views.cloud(spark, d).select(F.col("point_id").alias("point_index"), "x", "y", "z")
    as_right = lambda df: df.select(*[F.col(a).alias(f"q{a}") for a in "xyz"])
    ways = [spatial.nearest(one, as_right(other), "point_index", ["qx", "qy", "qz"]).agg(F.max("distance").alias("m")) for one, other in ((p, c), (c, p))]
    return _round(ways[0].unionByName(ways[1]).agg(F.max("m").alias("distance")))


@_query(f"""
, bb AS (SELECT face_id, {_xyz("least(a%, b%, c%) AS lo%")}, {_xyz("greatest(a%, b%, c%) AS hi%")} FROM g_tris)
SELECT p.point_index, bb.face_id FROM g_points p, bb WHERE {_xyz("p.% - 0.05e0 <= hi% AND p.% + 0.05e0 >= lo%", " AND ")}""")
def aabb_pairs(spark, d):
    balls = views.points(spark, d).select("point_index", *[(F.col(a) - 0.05).alias(f"lo{a}") for a in "xyz"], *[(F.col(a) + 0.05).alias(f"hi{a}") for a in "xyz"])
    tri = meshes.boxes(views.triangles(spark, d)).select("face_id", *[F.col(f"{n}{a}").alias(f"q{n}{a}") for n in ("lo", "hi") for a in "xyz"])
    return spatial.overlapping(balls, tri).select("point_index", "face_id")


@_query(f"{_FRAMES} SELECT point_index, {_xyz('round(t%, 6) + 0.0 AS t%')}, {_xyz('round(q%, 6) + 0.0 AS q%')}, {_xyz('round(a%, 6) + 0.0 AS a%')} FROM fr")
def frames(spark, d):
    return _round(_framed(spark, d).select("point_index", *[f"{p}{a}" for p in "tqa" for a in "xyz"]))


@_query(f"{_CANDIDATES} SELECT point_index, CAST(angle_index AS BIGINT) AS candidate_index, {_xyz('round(c%, 6) + 0.0 AS %')} FROM cd")
def candidates_disk(spark, d):
    return _round(poses.candidates(_framed(spark, d), RADIUS, ANGLES).select("point_index", "candidate_index", "x", "y", "z"))


@_query(f"{_CANDIDATES} SELECT point_index, CAST(angle_index AS BIGINT) AS candidate_index, {_xyz(f'round(c% + {WIDTH / 2}e0 * a%, 6) + 0.0 AS %')} FROM cd")
def axial_offset(spark, d):
    return _round(poses.offset(poses.candidates(_framed(spark, d), RADIUS, ANGLES), WIDTH).select("point_index", "candidate_index", "x", "y", "z"))


@_query(f"{_CANDIDATES} SELECT count(*) AS poses, bool_and(greatest(abs(ax * tx + ay * ty + az * tz), abs(ax * ex + ay * ey + az * ez)) <= 1e-10) AS orthogonal FROM cd")
def pose_checks(spark, d):
    return poses.pose_checks(poses.candidates(_framed(spark, d), RADIUS, ANGLES))


def _scan_sql(radii: tuple[float, ...]) -> str:
    hit = "EXISTS (SELECT 1 FROM sm s WHERE sqrt(({0} + r * ex - s.x) ** 2 + ({1} + r * ey - s.y) ** 2 + ({2} + r * ez - s.z) ** 2) < r)".format("cx.x", "cx.y", "cx.z")
    return f"""{_CANDIDATES}{_SAMPLES}
, rr AS (SELECT unnest([{", ".join(f"{r}e0" for r in radii)}]) AS r), cx AS (SELECT point_index, c1.x, c1.y, c1.z, ex, ey, ez, r FROM c1, rr),
ok AS (SELECT r, point_index, NOT {hit} AS ok FROM cx), pt AS (SELECT r, point_index, count(*) AS n, count(*) FILTER (ok) AS k FROM ok GROUP BY ALL),
sc AS (SELECT r AS radius, avg(CASE WHEN k > 0 THEN 1e0 ELSE 0e0 END) AS coverage, sum(k) / sum(n) AS ratio FROM pt GROUP BY r)"""


_RADII = (0.02, 0.05, 0.1)


@_query(f"{_scan_sql(_RADII)} SELECT round(radius, 6) AS radius, round(coverage, 6) AS coverage, round(ratio, 6) AS ratio FROM sc")
def radius_scan(spark, d):
    return _round(poses.radius_scan(_framed(spark, d), meshes.surface_samples(views.triangles(spark, d)), list(_RADII), ANGLES))


@_query(f"{_scan_sql(_RADII)} SELECT coalesce(max(radius) FILTER (coverage >= 0.9 AND ratio >= 0.5), (SELECT radius FROM sc ORDER BY coverage DESC, ratio DESC, radius LIMIT 1)) AS radius FROM sc")
def radius_choice(spark, d):
    return poses.radius_choice(poses.radius_scan(_framed(spark, d), meshes.surface_samples(views.triangles(spark, d)), list(_RADII), ANGLES), 0.9, 0.5)


SCAN_ANGLES = 72
_FULL_SCAN = f"""{_FRAMES}{_SAMPLES}
, rr AS (SELECT unnest([{", ".join(f"{r}e0" for r in _RADII)}]) AS r),
cx AS (SELECT point_index, k, r, {_xyz("% + r * (cos(angle) * t% + sin(angle) * q%) AS c%")} FROM (SELECT *, k * (2 * pi() / {SCAN_ANGLES}) AS angle FROM fr, (SELECT unnest(range({SCAN_ANGLES})) AS k)), rr),
hs AS (SELECT DISTINCT point_index, k, r FROM cx, sm WHERE {_xyz("abs(c% - %) < r", " AND ")} AND sqrt({_xyz("(c% - %) ** 2", " + ")}) < r),
pt AS (SELECT r, point_index, count(*) AS n, count(*) FILTER (hs.k IS NULL) AS k FROM cx LEFT JOIN hs USING (point_index, k, r) GROUP BY r, point_index),
sc AS (SELECT r AS radius, avg(CASE WHEN k > 0 THEN 1e0 ELSE 0e0 END) AS coverage, sum(k) / sum(n) AS ratio FROM pt GROUP BY r)"""


def _full_scan(spark: SparkSession, d: str) -> DataFrame:
    return poses.radius_scan(_framed(spark, d), meshes.surface_samples(views.triangles(spark, d)), list(_RADII), SCAN_ANGLES)


@_query(f"{_FULL_SCAN} SELECT round(radius, 6) AS radius, round(coverage, 6) AS coverage, round(ratio, 6) AS ratio FROM sc")
def radius_scan_full(spark, d):
    return _round(_full_scan(spark, d))


@_query(f"{_FULL_SCAN} SELECT coalesce(max(radius) FILTER (coverage >= 0.9 AND ratio >= 0.5), (SELECT radius FROM sc ORDER BY coverage DESC, ratio DESC, radius LIMIT 1)) AS radius FROM sc")
def radius_choice_full(spark, d):
    return poses.radius_choice(_full_scan(spark, d), 0.9, 0.5)


@_query(f"""{_JUDGED}, isl AS (SELECT point_index, angle_index, angle_index - row_number() OVER (PARTITION BY point_index ORDER BY angle_index) AS g FROM jd WHERE feasible)
SELECT point_index, round(min(angle_index) * {360 / ANGLES}e0, 3) AS start, round((max(angle_index) + 1) * {360 / ANGLES}e0, 3) AS "end" FROM isl GROUP BY point_index, g""")
def angle_intervals(spark, d):
    return poses.angle_intervals(_judged(spark, d), ANGLES)


@_query(f"""{_JUDGED}, pv AS (SELECT point_index, angle_index AS i, feasible, (SELECT b.feasible FROM jd b WHERE b.point_index = a.point_index AND b.angle_index = (a.angle_index + {ANGLES - 1}) % {ANGLES}) AS before FROM jd a),
st AS (SELECT point_index, i, feasible FROM pv WHERE feasible <> before),
rn AS (SELECT point_index, feasible, i AS start, coalesce(lead(i) OVER w, first_value(i) OVER w + {ANGLES}) AS "end" FROM st WINDOW w AS (PARTITION BY point_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT point_index, feasible, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM rn
UNION ALL SELECT point_index, bool_and(feasible), 0, {ANGLES} FROM jd GROUP BY point_index HAVING bool_and(feasible) OR NOT bool_or(feasible)""")
def ring_runs(spark, d):
    return poses.ring_runs(_judged(spark, d), ANGLES).drop("run")


@_query(f"{_JUDGED}, sh AS (SELECT branch_id, point_index, avg(CASE WHEN feasible THEN 1e0 ELSE 0e0 END) AS s FROM jd GROUP BY ALL) SELECT branch_id, point_index FROM (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY abs(s - 0.5e0), point_index) AS n FROM sh) WHERE n = 1")
def representative_point(spark, d):
    return poses.representative(_judged(spark, d))


@_query(f"{_JUDGED}, sh AS (SELECT point_index, avg(CASE WHEN feasible THEN 1e0 ELSE 0e0 END) AS s FROM jd GROUP BY ALL) SELECT point_index FROM sh ORDER BY abs(s - 0.5e0), point_index LIMIT 1")
def explanation_point(spark, d):
    """The one point that explains most: nearest to half feasible."""
    return poses.explanation_point(_judged(spark, d))


def _sided(spark: SparkSession, d: str, radius: float = RADIUS) -> DataFrame:
    signed = paths.side_signs(_framed(spark, d))
    return paths.sides(poses.candidates(signed, radius, ANGLES))


_SIDED = f"""{_CANDIDATES}
, sg0 AS (SELECT *, qx * lag(qx) OVER w + qy * lag(qy) OVER w + qz * lag(qz) OVER w AS product FROM fr WINDOW w AS (PARTITION BY branch_id ORDER BY seq)),
sgn AS (SELECT point_index, CASE WHEN count(*) FILTER (product < 0) OVER (PARTITION BY branch_id ORDER BY seq) % 2 = 1 THEN -1 ELSE 1 END AS sign FROM sg0),
sd0 AS (SELECT cd.*, sign, (ex * qx + ey * qy + ez * qz) * sign AS along FROM cd JOIN sgn USING (point_index)),
sd AS (SELECT *, CASE WHEN along > 1e-9 THEN 1 WHEN along < -1e-9 THEN -1 ELSE 0 END AS lateral_side FROM sd0)"""


@_query(f"{_SIDED} SELECT point_index, CAST(angle_index AS BIGINT) AS candidate_index, sign, lateral_side FROM sd")
def lateral_side(spark, d):
    return _sided(spark, d).select("point_index", "candidate_index", "sign", "lateral_side")


_FEASIBLE = f"""{_JUDGED}{_SIDED.removeprefix(_CANDIDATES)}
, fz AS (SELECT sd.*, jd.feasible FROM sd JOIN jd USING (point_index, angle_index)),
fn AS (SELECT branch_id, lateral_side, seq, angle_index, angle, cx, cy, cz, dense_rank() OVER (PARTITION BY branch_id, lateral_side ORDER BY seq) AS layer FROM fz WHERE feasible AND lateral_side <> 0),
fp AS (SELECT *, CAST(0 AS DOUBLE) AS cost, CAST([angle_index] AS BIGINT[]) AS way FROM fn WHERE layer = 1
  UNION ALL (SELECT n.branch_id, n.lateral_side, n.seq, n.angle_index, n.angle, n.cx, n.cy, n.cz, n.layer, min(p.cost + sqrt((n.cx - p.cx) * (n.cx - p.cx) + (n.cy - p.cy) * (n.cy - p.cy) + (n.cz - p.cz) * (n.cz - p.cz))),
    list_append(arg_min(p.way, p.cost + sqrt((n.cx - p.cx) * (n.cx - p.cx) + (n.cy - p.cy) * (n.cy - p.cy) + (n.cz - p.cz) * (n.cz - p.cz))), max(n.angle_index))
  FROM fp p JOIN fn n ON n.branch_id = p.branch_id AND n.lateral_side = p.lateral_side AND n.layer = p.layer + 1 GROUP BY ALL)),
ft AS (SELECT branch_id, lateral_side, max(layer) AS layers FROM fn GROUP BY ALL),
fb AS (SELECT fp.branch_id, fp.lateral_side, layers, min(cost) AS cost, arg_min(way, cost) AS way FROM fp JOIN ft ON fp.branch_id = ft.branch_id AND fp.lateral_side = ft.lateral_side AND fp.layer = layers GROUP BY ALL)"""


_SIDES = _FEASIBLE.replace("WHERE feasible AND lateral_side <> 0", "WHERE lateral_side <> 0").replace(f"{_JUDGED}{_SIDED.removeprefix(_CANDIDATES)}", _SIDED).replace("SELECT sd.*, jd.feasible FROM sd JOIN jd USING (point_index, angle_index)", "SELECT * FROM sd")


def _side_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _sided(spark, d).where("lateral_side <> 0").select("branch_id", "lateral_side", "seq", "candidate_index", "angle", "x", "y", "z")


@_query(f"{_SIDES} SELECT branch_id, lateral_side, layers, round(cost, 6) AS cost FROM fb")
def layered_path(spark, d):
    """The shortest way through all poses of a side, feasible or not."""
    return _round(paths.layered(_side_nodes(spark, d)).drop("way"))


def _feasible_sided(spark: SparkSession, d: str, radius: float = RADIUS) -> DataFrame:
    judged = poses.envelope(_sided(spark, d, radius), meshes.surface_samples(views.triangles(spark, d)), radius)
    return judged.where("feasible AND lateral_side <> 0").select("branch_id", "lateral_side", "seq", "point_index", "candidate_index", "angle", "x", "y", "z", *[f"{k}{a}" for k in "aqe" for a in "xyz"])


@_query(f"{_FEASIBLE} SELECT branch_id, lateral_side, layers, round(cost, 6) AS cost FROM fb")
def feasible_path(spark, d):
    """The shortest way through all feasible poses of a side."""
    return _round(paths.chosen(_feasible_sided(spark, d)).select("branch_id", "lateral_side", "layers", "cost").distinct())


_MEASURED = """
, nd AS (SELECT fn.* FROM fn JOIN fb ON fn.branch_id = fb.branch_id AND fn.lateral_side = fb.lateral_side AND fn.angle_index = fb.way[fn.layer]),
sg AS (SELECT *, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2 + (cz - lag(cz) OVER w) ** 2) AS seg, abs(degrees(angle - lag(angle) OVER w)) AS t FROM nd WINDOW w AS (PARTITION BY branch_id, lateral_side ORDER BY seq))
SELECT branch_id, lateral_side, count(*) AS nodes, round(coalesce(sum(seg), 0), 6) AS length, round(max(seg), 6) AS max_segment, round(max(least(t, 360 - t)), 6) AS max_turn, round(avg(least(t, 360 - t)), 6) AS mean_turn FROM sg GROUP BY ALL"""


def _measured(nodes: DataFrame) -> DataFrame:
    way = paths.chosen(nodes).select("branch_id", "lateral_side", "seq", "candidate_index")
    return _round(paths.metrics(nodes.join(way, way.columns), ["branch_id", "lateral_side"]))


@_query(_FEASIBLE + _MEASURED)
def feasible_path_metrics(spark, d):
    """Metrics of the way that `feasible_path` chooses."""
    return _measured(_feasible_sided(spark, d))


@_query(_SIDES + _MEASURED)
def path_metrics(spark, d):
    """Metrics of the way that `layered_path` chooses."""
    return _measured(_side_nodes(spark, d))


@_query(f"""{_ARC}
, ms AS (SELECT branch_id, seq, arc_length AS s, point_index % 7 = 3 AS missing, lead(arc_length) OVER w AS after, lag(arc_length) OVER w AS before FROM arc WINDOW w AS (PARTITION BY branch_id ORDER BY seq)),
en AS (SELECT branch_id, max(s) AS total FROM ms GROUP BY ALL)
SELECT m.branch_id, m.seq, m.missing,
  round(greatest(m.s - 0.3e0, coalesce((SELECT coalesce((l.s + l.after) / 2, l.s) FROM ms l WHERE l.branch_id = m.branch_id AND l.missing AND l.seq <= m.seq ORDER BY l.seq DESC LIMIT 1), 0)), 6) AS "left",
  round(least(m.s + 0.3e0, coalesce((SELECT coalesce((l.s + l.before) / 2, l.s) FROM ms l WHERE l.branch_id = m.branch_id AND l.missing AND l.seq >= m.seq ORDER BY l.seq LIMIT 1), en.total)), 6) AS "right"
FROM ms m JOIN en USING (branch_id)""")
def coverage_bounds(spark, d):
    curve = curves.arc_lengths(views.points(spark, d)).withColumn("missing", F.col("point_index") % 7 == 3)
    return _round(paths.coverage_bounds(curve, 0.3))


@_query(f"{_JUDGED} SELECT point_index, branch_id FROM g_points WHERE point_index NOT IN (SELECT point_index FROM jd WHERE feasible)")
def skipped_points(spark, d):
    return views.points(spark, d).select("point_index", "branch_id").join(_judged(spark, d).where("feasible"), "point_index", "left_anti")


@_query(f"SELECT label, {_xyz('round(median(%), 6) + 0.0 AS %')} FROM g_cloud GROUP BY label")
def cloud_median(spark, d):
    return _round(poses.coordinate_median(views.cloud(spark, d), ["label"]))


@_query(f"""{_METRICS} SELECT face_id, round(degrees(acos(greatest(-1, least(1, (kx * nx + ky * ny + kz * nz) / n)))), 4) AS degrees
FROM mt JOIN g_normals ON point_index = face_id WHERE n > 1e-12""")
def normal_angles(spark, d):
    faces = meshes.metrics(views.triangles(spark, d)).where("valid").select(F.col("face_id").alias("point_index"), *[F.col(f"n{a}").alias(f"f{a}") for a in "xyz"])
    both = faces.join(views.normals(spark, d), "point_index")
    return both.select(F.col("point_index").alias("face_id"), F.round(angle(vec("f"), vec("n")), 4).alias("degrees"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat_ws(" ", F.lit("v"), *[F.col(a).cast("string") for a in "xyz"])
    verts = views.points(spark, d).select((F.col("point_index") * 2).alias("line_no"), v.alias("value"))
    n = views.points(spark, d).agg(F.count("*")).scalar()
    faces = views.topology(spark, d).select((n * 2 + F.col("face_id")).alias("line_no"), F.concat_ws(" ", F.lit("f"), F.concat(F.col("v0") + 1, F.lit("/1")), (F.col("v1") - n).cast("string"), F.col("v2") + 1, F.col("v0") + 1).alias("value"))
    groups = views.points(spark, d).where("point_index % 10 = 0").select((F.col("point_index") * 2 - 1).alias("line_no"), F.when(F.col("point_index") % 20 == 0, "g Flash_1").otherwise("g body_0").alias("value"))
    return verts.unionByName(faces).unionByName(groups).select(F.lit("mesh").alias("file"), "line_no", "value")


@_query("SELECT face_id, k AS part, v0, CASE k WHEN 1 THEN v1 ELSE v2 END AS v1, CASE k WHEN 1 THEN v2 ELSE v0 END AS v2 FROM g_topo, (SELECT unnest([1, 2]) AS k)")
def obj_faces(spark, d):
    n = views.points(spark, d).agg(F.count("*")).scalar()
    return text.obj_faces(_lines(spark, d)).select((F.col("line_no") - n * 2).alias("face_id"), "part", "v0", "v1", "v2")


@_query(f"SELECT point_index AS vertex_id, {_xyz('round(%, 6) + 0.0 AS %')} FROM g_points")
def obj_vertices(spark, d):
    return _round(text.obj_vertices(_lines(spark, d)).drop("file"))


@_query("SELECT CASE WHEN point_index // 10 % 2 = 0 THEN 1 ELSE 0 END AS label, count(*) AS n FROM g_points GROUP BY ALL")
def cloud_labels(spark, d):
    return text.labelled_points(_lines(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


@_query("SELECT p.point_index, c.point_id FROM g_points p JOIN g_cloud c ON sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2) <= 0.1e0")
def radius_pairs(spark, d):
    right = views.cloud(spark, d).select("point_id", *[F.col(a).alias(f"q{a}") for a in "xyz"])
    return spatial.within(views.points(spark, d), right, 0.1).select("point_index", "point_id")


@_query("SELECT p.point_index, round(sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2), 6) AS distance FROM g_points p JOIN g_cloud c ON p.point_index = c.point_id")
def paired_distance(spark, d):
    right = views.cloud(spark, d).select(F.col("point_id").alias("point_index"), *[F.col(a).alias(f"q{a}") for a in "xyz"])
    return _round(views.points(spark, d).join(right, "point_index").select("point_index", distance(vec(), vec("q")).alias("distance")))


@_query(f"SELECT point_index, {_xyz('round(n%, 6) + 0.0 AS n%')} FROM g_normals")
def unit_normals(spark, d):
    return _round(views.normals(spark, d).select("point_index", *[c.alias(f"n{a}") for c, a in zip(unit(vec("n")), "xyz", strict=True)]))


_SIDES = f"""{_TANGENTS}
, nb AS (SELECT p.point_index, c.label, c.x, c.y, c.z, row_number() OVER (PARTITION BY p.point_index, c.label ORDER BY sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2), c.point_id) AS r FROM tg p, g_cloud c),
md AS (SELECT point_index, {_xyz("median(%) FILTER (label = 1) - median(%) FILTER (label = 0) AS w%")} FROM nb WHERE r <= 32 GROUP BY point_index),
pr AS (SELECT point_index, {_xyz("w% - (wx * tx + wy * ty + wz * tz) * t% AS r%")} FROM md JOIN tg USING (point_index)),
dr AS (SELECT point_index, size, {_xyz("CASE WHEN size > 1e-12 THEN r% / size ELSE 0 END AS d%")} FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS size FROM pr))"""


def _sides(spark: SparkSession, d: str) -> DataFrame:
    cloud = views.cloud(spark, d).select("label", "point_id", *[F.col(a).alias(f"q{a}") for a in "xyz"])
    return orientation.cloud_directions(_tangents(spark, d), cloud.where("label = 1"), cloud.where("label = 0"))


@_query(f"{_SIDES} SELECT point_index, {_xyz('round(d%, 6) + 0.0 AS d%')}, round(size, 6) AS confidence FROM dr")
def side_directions(spark, d):
    return _round(_sides(spark, d))


_VOTES = f"""{_SIDES}
, sc AS (SELECT branch_id, nx * dx + ny * dy + nz * dz AS s FROM dr JOIN g_normals USING (point_index) JOIN g_points USING (point_index)),
vt0 AS (SELECT branch_id, coalesce(median(s) FILTER (abs(s) >= 0.08e0), median(s)) AS score FROM sc GROUP BY branch_id),
vt AS (SELECT branch_id, score, CASE WHEN score >= 0 THEN 1 ELSE -1 END AS sign FROM vt0)"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    both = _sides(spark, d).join(views.normals(spark, d), "point_index").select("point_index", dot(vec("n"), vec("d")).alias("score"))
    return orientation.branch_votes(both.join(views.points(spark, d).select("point_index", "branch_id"), "point_index"))


@_query(f"{_VOTES} SELECT branch_id, round(score, 6) AS score, sign FROM vt")
def branch_votes(spark, d):
    return _round(_votes(spark, d))


@_query(f"{_VOTES} SELECT point_index, {_xyz('round(sign * n%, 6) + 0.0 AS n%')} FROM g_points JOIN g_normals USING (point_index) JOIN vt USING (branch_id)")
def voted_axes(spark, d):
    """Normals turned by the vote of their branch."""
    axes = views.normals(spark, d).join(views.points(spark, d).select("point_index", "branch_id"), "point_index")
    return _round(orientation.voted_axes(axes, _votes(spark, d)).select("point_index", "nx", "ny", "nz"))


@_query(f"""
, mb AS (SELECT branch_id, nx, ny, nz FROM g_points JOIN g_normals USING (point_index)),
mn AS (SELECT branch_id, {_xyz("sum(n%) AS s%")} FROM mb GROUP BY branch_id),
mu AS (SELECT branch_id, {_xyz("s% / sqrt(sx * sx + sy * sy + sz * sz) AS m%")} FROM mn),
an AS (SELECT mb.*, degrees(acos(greatest(-1, least(1, nx * mx + ny * my + nz * mz)))) AS dev FROM mb JOIN mu USING (branch_id)),
ct AS (SELECT branch_id, greatest(median(dev) * 2.5e0, 5e0) AS lim, max(dev) AS widest FROM an GROUP BY branch_id),
wt AS (SELECT an.*, widest, CASE WHEN dev < lim THEN (1 - (dev / lim) ** 2) ** 2 ELSE 0e0 END AS w FROM an JOIN ct USING (branch_id)),
sw AS (SELECT branch_id, max(widest) AS widest, {_xyz("sum(w * n%) AS s%")} FROM wt GROUP BY branch_id)
SELECT branch_id, {_xyz("round(s% / sqrt(sx * sx + sy * sy + sz * sz), 5) + 0.0 AS n%")}, round(widest, 4) AS widest FROM sw""")
def robust_normals(spark, d):
    members = views.normals(spark, d).join(views.points(spark, d).select("point_index", "branch_id"), "point_index").select("branch_id", "nx", "ny", "nz")
    sums = members.groupBy("branch_id").agg(*[F.sum(f"n{a}").alias(f"s{a}") for a in "xyz"])
    out = orientation.robust_directions(members, sums.select("branch_id", *named(unit(vec("s")), "m")), "branch_id")
    return out.select("branch_id", *[rounded(F.col(f"n{a}"), 5).alias(f"n{a}") for a in "xyz"], F.round("widest", 4).alias("widest"))
