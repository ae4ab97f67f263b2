"""Registered queries of summaries and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shapes import moved, ring_angle
from ..functions.vec import named, rounded, vec
from ..operators import collision, paths, poses, reports
from . import views
from .checks import _CHECKED, _dot, _lean, _sql_segment
from .queries import _CANDIDATES, _JUDGED, ANGLES, RADIUS, WIDTH, _framed, _judged, _query, _round, _xyz
from .routes import _LAYERS, _nodes

_SLOW = "sqrt(least(" + ", ".join(_sql_segment(*e) for e in ("ab", "bc", "ca")) + "))"


@_query(f"{_JUDGED}, p AS (SELECT point_index, count(*) AS n, count(*) FILTER (feasible) AS ok FROM jd GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS poses, round(sum(ok) / sum(n), 6) AS feasible_share, count(*) AS points, round(avg(CASE WHEN ok > 0 THEN 1e0 ELSE 0e0 END), 6) AS point_share FROM p")
def feasible_shares(spark, d):
    return _round(reports.shares(_judged(spark, d)))


@_query(f"""{_JUDGED}, r AS (SELECT CASE WHEN feasible THEN 'safe' ELSE 'wheel_outer_collision' END AS reason FROM jd)
SELECT prefix, (SELECT count(*) FROM r WHERE starts_with(reason, prefix)) AS n FROM (VALUES ('safe'), ('wheel'), ('contact_patch_only')) v(prefix)""")
def reason_prefixes(spark, d):
    return reports.reasons_like(_judged(spark, d), ["safe", "wheel", "contact_patch_only"])


@_query(f"{_CANDIDATES} SELECT CAST(round_even((angle + 0.1e0) / (2 * pi()) * 12, 0) AS BIGINT) % 12 AS bucket, count(*) AS n FROM cd GROUP BY ALL")
def angle_buckets(spark, d):
    made = poses.candidates(_framed(spark, d), RADIUS, ANGLES)
    return made.select(reports.angle_bucket(F.col("angle") + 0.1, 12).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@_query(f"{_CANDIDATES} SELECT point_index, CAST(angle_index AS BIGINT) AS candidate_index, round(angle_index * {360 / ANGLES}e0, 6) AS degrees FROM cd")
def ring_angles(spark, d):
    made = poses.candidates(_framed(spark, d), RADIUS, ANGLES)
    return made.select("point_index", "candidate_index", F.pmod(rounded(ring_angle(vec("e"), vec("t"), vec("q"))), F.lit(360.0)).alias("degrees"))


@_query(f"""{_CHECKED}, dp AS (SELECT point_index, penetration FROM ck WHERE penetration > 0)
SELECT coalesce(dp.point_index, -1) AS point_index, count(*) AS n, round(min(penetration), 6) AS least, round(median(penetration), 6) AS middle, round(max(penetration), 6) AS most FROM dp GROUP BY ROLLUP (dp.point_index)""")
def depth_summary(spark, d):
    return _round(reports.depth_summary(collision.pose_penetrations(_lean(spark, d), views.triangles(spark, d), RADIUS, WIDTH)))


@_query(f"""{_JUDGED}, p AS (SELECT branch_id, point_index, count(*) AS n, count(*) FILTER (feasible) AS ok FROM jd GROUP BY ALL)
SELECT branch_id, CAST(sum(n) AS BIGINT) AS poses, CAST(sum(ok) AS BIGINT) AS feasible, count(*) AS points, count(*) FILTER (ok = 0) AS without, bool_and(ok > 0) AS complete FROM p GROUP BY branch_id""")
def case_summary(spark, d):
    """A branch as a case."""
    return reports.cases(_judged(spark, d), "branch_id")


@_query(f"""{_LAYERS}, st AS (SELECT branch_id, lateral_side FROM sl GROUP BY ALL HAVING count(*) FILTER (nodes = 0) = 0)
SELECT b.branch_id, max(st.lateral_side) AS lateral_side, CASE WHEN max(st.lateral_side) IS NULL THEN 'no side has a way' ELSE 'ok' END AS note
FROM (SELECT DISTINCT CAST(branch_id AS INTEGER) AS branch_id FROM g_points) b LEFT JOIN st USING (branch_id) GROUP BY b.branch_id""")
def preferred_side(spark, d):
    return reports.preferred_side(paths.planned(views.points(spark, d), _nodes(spark, d)))


@_query(" SELECT point_index, branch_id FROM (SELECT point_index, branch_id, row_number() OVER (PARTITION BY branch_id ORDER BY md5('7:' || point_index), point_index) AS n FROM g_points) WHERE n <= 5")
def sampled_points(spark, d):
    return reports.sampled(views.points(spark, d).select("point_index", "branch_id"), "branch_id", "point_index", 5, 7)


@_query("""
, o AS (SELECT point_index, branch_id, seq, row_number() OVER (PARTITION BY branch_id ORDER BY seq) - 1 AS place, count(*) OVER (PARTITION BY branch_id) AS many FROM g_points)
SELECT point_index, branch_id, seq FROM o WHERE many <= 8 OR place IN (SELECT CAST(floor(i * (many - 1) / 7e0) AS BIGINT) FROM range(8) r(i))""")
def even_points(spark, d):
    return reports.evenly(views.points(spark, d).select("point_index", "branch_id", "seq"), "branch_id", "seq", 8)


@_query(f" SELECT point_index, {_xyz('round(% * 2.5e0 + 0.25e0, 6) + 0.0 AS %')} FROM g_points")
def source_frame(spark, d):
    """Normalised points in their source frame."""
    quarter = F.lit(0.25)
    return views.points(spark, d).select("point_index", *named(moved(vec(), F.lit(2.5), (quarter, quarter, quarter)), "", 6))


@_query(f"""
, md AS (SELECT *, {_xyz('(a% + b% + c%) / 3 AS m%')} FROM g_tris),
kn AS (SELECT point_index, face_id, {_xyz('%')}, {', '.join(f'{k}{a}' for k in 'abc' for a in 'xyz')} FROM (SELECT g.point_index, {_xyz('g.%')}, md.*, row_number() OVER (PARTITION BY g.point_index ORDER BY sqrt({_xyz('(g.% - m%) ** 2', ' + ')}), face_id) AS n FROM g_points g, md) WHERE n <= 8),
n0 AS (SELECT *, (by - ay) * (cz - az) - (bz - az) * (cy - ay) AS mx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS my, (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) AS mz FROM kn),
n1 AS (SELECT *, ({_xyz('(% - a%) * m%', ' + ')}) / {_dot('m', 'm')} AS f FROM n0),
n2 AS (SELECT *, {_xyz('% - f * m% AS h%')} FROM n1),
""" + ",\n".join(f"n{i} AS (SELECT *, mx * (({q}y - {p}y) * (hz - {p}z) - ({q}z - {p}z) * (hy - {p}y)) + my * (({q}z - {p}z) * (hx - {p}x) - ({q}x - {p}x) * (hz - {p}z)) + mz * (({q}x - {p}x) * (hy - {p}y) - ({q}y - {p}y) * (hx - {p}x)) AS k{i} FROM n{i - 1})" for i, (p, q) in enumerate(("ab", "bc", "ca"), 3)) + f""",
ex AS (SELECT point_index, face_id, CASE WHEN k3 >= 0 AND k4 >= 0 AND k5 >= 0 THEN abs(f) * sqrt({_dot('m', 'm')}) ELSE {_SLOW} END AS distance FROM n5),
rk AS (SELECT *, row_number() OVER (PARTITION BY point_index ORDER BY distance, face_id) AS rank, count(*) FILTER (distance <= 0.15) OVER (PARTITION BY point_index) AS within FROM ex)
SELECT point_index, face_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM rk WHERE CASE WHEN within >= 3 THEN distance <= 0.15 ELSE rank <= 3 END""")
def nearest_faces(spark, d):
    return _round(reports.nearest_faces(views.points(spark, d), views.triangles(spark, d), 8, 0.15, 3))
