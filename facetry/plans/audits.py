"""Registered queries of picks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import add, named, rounded, unit, vec
from ..operators import audits, poses, reports
from ..sources import runs
from . import views
from .lines import _envelope, _normal_samples
from .queries import _CANDIDATES, _JUDGED, _SAMPLES, ANGLES, RADIUS, _framed, _judged, _query, _round, _tangents, _xyz

_CLEAR = f"""{_CANDIDATES}{_SAMPLES}
, cl AS MATERIALIZED (SELECT cd.point_index, cd.branch_id, cd.seq, cd.angle_index, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz, min(sqrt((cx - sm.x) ** 2 + (cy - sm.y) ** 2 + (cz - sm.z) ** 2)) - {RADIUS}e0 AS clearance FROM cd, sm GROUP BY ALL)"""


def _clear(spark: SparkSession, d: str) -> DataFrame:
    return poses.clearances(poses.candidates(_framed(spark, d), RADIUS, ANGLES), _normal_samples(spark, d).drop("nx", "ny", "nz"))


@_query(f"""{_CLEAR}, rp AS (SELECT point_index, arg_max(angle_index, clearance) FILTER (clearance >= 0) AS best, min(angle_index) FILTER (clearance < 0) AS collision, bool_or(clearance >= 0 AND angle_index = 7) AS seven FROM cl GROUP BY ALL)
SELECT point_index, CAST(coalesce(CASE WHEN seven AND mod(point_index, 10) = 3 THEN 7 ELSE best END, -1) AS BIGINT) AS feasible, CAST(coalesce(collision, -1) AS BIGINT) AS collision FROM rp""")
def representative_poses(spark, d):
    """The roomiest pose of each point and its first failing one; every tenth point asks for pose 7."""
    named_ = views.points(spark, d).where("point_index % 10 = 3").select("point_index", F.lit(7).cast("long").alias("candidate_index"))
    return audits.representative_poses(_clear(spark, d), named_).fillna(-1, ["feasible", "collision"])


@_query(f"""{_JUDGED}, mx AS (SELECT branch_id, seq, point_index, bool_or(feasible) AND NOT bool_and(feasible) AS mixed FROM jd GROUP BY ALL),
md AS (SELECT *, abs(seq - (min(seq) OVER (PARTITION BY branch_id) + count(*) OVER (PARTITION BY branch_id) // 2)) AS off FROM mx),
pk AS (SELECT branch_id, point_index FROM (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY mixed DESC, off, seq) AS n FROM md) WHERE n = 1),
ff AS (SELECT branch_id, min(angle_index) AS feasible FROM jd JOIN pk USING (branch_id, point_index) WHERE feasible GROUP BY ALL),
fp AS (SELECT ff.*, cx AS fx, cy AS fy, cz AS fz FROM ff JOIN pk USING (branch_id) JOIN jd ON jd.point_index = pk.point_index AND jd.angle_index = ff.feasible),
hh AS (SELECT jd.branch_id, arg_max(angle_index, (round(coalesce(sqrt((cx - fx) ** 2 + (cy - fy) ** 2 + (cz - fz) ** 2), 0), 12), -angle_index)) AS collision FROM jd JOIN pk USING (branch_id, point_index) LEFT JOIN fp ON fp.branch_id = jd.branch_id WHERE NOT jd.feasible GROUP BY ALL)
SELECT pk.branch_id, pk.point_index, CAST(coalesce(ff.feasible, -1) AS BIGINT) AS feasible, CAST(coalesce(collision, -1) AS BIGINT) AS collision FROM pk LEFT JOIN ff ON ff.branch_id = pk.branch_id LEFT JOIN hh ON hh.branch_id = pk.branch_id""")
def branch_representatives(spark, d):
    return audits.branch_representatives(_judged(spark, d)).fillna(-1, ["feasible", "collision"])


@_query(f"""{_JUDGED}, sh AS (SELECT point_index, avg(CASE WHEN feasible THEN 1e0 ELSE 0e0 END) AS share FROM jd GROUP BY ALL),
rn AS (SELECT *, row_number() OVER (ORDER BY point_index) - 1 AS rank, count(*) OVER () AS n FROM sh),
ev AS (SELECT point_index FROM rn WHERE rank IN (SELECT CAST(floor(i * (n - 1) / 11e0) AS BIGINT) FROM range(12) r(i))),
hf AS (SELECT arg_min(point_index, (abs(share - 0.5e0), point_index)) AS best FROM rn WHERE share > 0 AND share < 1)
SELECT point_index FROM ev, hf WHERE best IN (SELECT point_index FROM ev) OR point_index <> (SELECT max(point_index) FROM ev)
UNION SELECT best FROM hf WHERE best IS NOT NULL""")
def demo_points(spark, d):
    """Twelve points for a demonstration."""
    shares = _judged(spark, d).groupBy("point_index").agg(F.avg(F.col("feasible").cast("double")).alias("share"))
    return audits.demo_points(shares, 12)


_TAGS = ("infeasible", "branch7", "low_support", "low_confidence")


@_query(f"""{_JUDGED}, ft AS (SELECT point_index, count(*) FILTER (NOT feasible) AS bad FROM jd GROUP BY ALL),
kg AS (SELECT point_index, 'infeasible' AS tag FROM ft WHERE bad = {ANGLES} UNION ALL SELECT point_index, 'branch7' FROM g_points WHERE branch_id = 7 UNION ALL SELECT point_index, 'low_support' FROM ft WHERE bad = 0 UNION ALL SELECT point_index, 'low_confidence' FROM ft WHERE bad = {ANGLES // 2}),
pick1 AS (SELECT min(point_index) AS p FROM kg WHERE tag = 'infeasible'),
pick2 AS (SELECT min(point_index) AS p FROM kg, pick1 WHERE tag = 'branch7' AND point_index IS DISTINCT FROM pick1.p),
pick3 AS (SELECT min(point_index) AS p FROM kg, pick1, pick2 WHERE tag = 'low_support' AND point_index IS DISTINCT FROM pick1.p AND point_index IS DISTINCT FROM pick2.p),
pick4 AS (SELECT min(point_index) AS p FROM kg, pick1, pick2, pick3 WHERE tag = 'low_confidence' AND point_index IS DISTINCT FROM pick1.p AND point_index IS DISTINCT FROM pick2.p AND point_index IS DISTINCT FROM pick3.p),
tk AS (SELECT p FROM (SELECT * FROM pick1 UNION ALL SELECT * FROM pick2 UNION ALL SELECT * FROM pick3 UNION ALL SELECT * FROM pick4) WHERE p IS NOT NULL),
al AS (SELECT point_index, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM kg GROUP BY ALL),
re AS (SELECT *, row_number() OVER (ORDER BY point_index) - 1 AS rank, count(*) OVER () AS n, 10 - (SELECT count(*) FROM tk) AS more FROM al WHERE point_index NOT IN (SELECT p FROM tk))
SELECT point_index, tags FROM al WHERE point_index IN (SELECT p FROM tk)
UNION ALL SELECT point_index, tags FROM re WHERE rank IN (SELECT CAST(CASE WHEN least(more, n) > 1 THEN floor(i * (n - 1) / (least(more, n) - 1)) ELSE 0 END AS BIGINT) FROM range(10) r(i) WHERE i < least(more, n))""")
def inspection_points(spark, d):
    """Ten points to look at, one of each kind first."""
    bad = _judged(spark, d).groupBy("point_index").agg(F.count_if(~F.col("feasible")).alias("bad"))
    kinds = F.array_compact(F.array(F.when(F.col("bad") == ANGLES, "infeasible"), F.when(F.col("bad") == 0, "low_support"), F.when(F.col("bad") == ANGLES // 2, "low_confidence")))
    tags = bad.select("point_index", F.explode(kinds).alias("tag")).unionByName(views.points(spark, d).where("branch_id = 7").select("point_index", F.lit("branch7").alias("tag")))
    return audits.inspection_points(tags, _TAGS, 10).select("point_index", F.array_join("tags", ",").alias("tags"))


_AXES = f"""{_CANDIDATES}{_SAMPLES}
, fa AS (SELECT vec_id AS point_index, {", ".join(f"CAST(embedding[{19 + i}] AS DOUBLE) AS f{a}" for i, a in enumerate("xyz"))} FROM embeddings),
fb AS (SELECT point_index, {_xyz("n%")}, {_xyz("f% / sqrt(fx * fx + fy * fy + fz * fz) AS f%")} FROM fa JOIN g_normals USING (point_index)),
ax0 AS (SELECT point_index, 0 AS axis_index, {_xyz("n% AS a%")} FROM fb UNION ALL SELECT point_index, 1, {_xyz("f%")} FROM fb UNION ALL SELECT point_index, 2, {_xyz("n% + f%")} FROM fb),
ax1 AS MATERIALIZED (SELECT point_index, axis_index, {_xyz("a% / sqrt(ax * ax + ay * ay + az * az) AS a%")} FROM ax0),
ft AS (SELECT ax1.*, {_xyz("tg.%")}, {_xyz("t% - (tx * ax + ty * ay + tz * az) * a% AS g%")} FROM ax1 JOIN tg USING (point_index)),
f9 AS (SELECT *, {_xyz("g% / sqrt(gx * gx + gy * gy + gz * gz) AS s%")} FROM ft),
fq AS (SELECT *, ay * sz - az * sy AS qx, az * sx - ax * sz AS qy, ax * sy - ay * sx AS qz FROM f9),
fp AS MATERIALIZED (SELECT point_index, axis_index, k, {_xyz(f"% + {RADIUS}e0 * (cos(k * 2 * pi() / {ANGLES}) * s% + sin(k * 2 * pi() / {ANGLES}) * q%) AS c%")} FROM fq, (SELECT unnest(range({ANGLES})) AS k)),
fh AS (SELECT DISTINCT point_index, axis_index, k FROM fp, sm WHERE {_xyz(f"abs(c% - %) < {RADIUS}e0", " AND ")} AND sqrt({_xyz("(c% - %) ** 2", " + ")}) < {RADIUS}e0),
ac AS MATERIALIZED (SELECT point_index, axis_index, count(*) FILTER (fh.k IS NULL) AS feasible FROM fp LEFT JOIN fh USING (point_index, axis_index, k) GROUP BY ALL),
mr AS MATERIALIZED (SELECT CASE axis_index WHEN 0 THEN 'own' WHEN 1 THEN 'patch' ELSE 'bisector' END AS "method", point_index, branch_id, feasible, CASE WHEN feasible < 3 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN feasible = 0 THEN 'none' WHEN feasible = {ANGLES} THEN 'whole' ELSE 'part' END AS source, {_xyz("a% AS n%")} FROM ac JOIN ax1 USING (point_index, axis_index) JOIN (SELECT point_index, branch_id FROM g_points) USING (point_index))"""


def _axes(spark: SparkSession, d: str) -> DataFrame:
    third = unit(tuple(F.element_at("embedding", 19 + i).cast("double") for i in range(3)))
    e = views.embeddings(spark, d).select(F.col("vec_id").alias("point_index"), *named(third, "f")).join(views.normals(spark, d), "point_index")
    lists = [vec("n"), vec("f"), unit(add(vec("n"), vec("f")))]
    return e.select("point_index", F.explode(F.array(*[F.struct(F.lit(i).alias("axis_index"), *named(v, "a")) for i, v in enumerate(lists)])).alias("x")).select("point_index", "x.*")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return audits.axis_counts(_tangents(spark, d), _axes(spark, d), ANGLES, RADIUS, _envelope(spark, d))


def _methods(spark: SparkSession, d: str) -> DataFrame:
    rows = _counts(spark, d).join(_axes(spark, d), ["point_index", "axis_index"]).join(views.points(spark, d).select("point_index", "branch_id"), "point_index")
    method = F.when(F.col("axis_index") == 0, "own").when(F.col("axis_index") == 1, "patch").otherwise("bisector")
    source = F.when(F.col("feasible") == 0, "none").when(F.col("feasible") == ANGLES, "whole").otherwise("part")
    return rows.select(method.alias("method"), "point_index", "branch_id", "feasible", F.when(F.col("feasible") < 3, "low").otherwise("high").alias("confidence"), source.alias("source"), *named(vec("a"), "n"))


@_query(f"{_AXES} SELECT * FROM ac")
def axis_counts(spark, d):
    """How many poses three axes of every point give."""
    return _counts(spark, d)


@_query(f"""{_AXES}, sc AS (SELECT "method", source, count(*) AS n FROM mr GROUP BY ALL),
sj AS (SELECT "method", '{{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}}' AS source_counts FROM sc GROUP BY ALL)
SELECT "method", points, feasible_total, round(ratio, 6) AS feasible_ratio, zero_points, low_confidence, round(b4, 6) AS branch4_mean, round(b7, 6) AS branch7_mean, source_counts
FROM (SELECT "method", count(*) AS points, CAST(sum(feasible) AS BIGINT) AS feasible_total, sum(feasible) / (count(*) * {ANGLES}) AS ratio, count(*) FILTER (feasible = 0) AS zero_points, count(*) FILTER (confidence = 'low') AS low_confidence,
  avg(feasible) FILTER (branch_id = 4) AS b4, avg(feasible) FILTER (branch_id = 7) AS b7 FROM mr GROUP BY ALL) JOIN sj USING ("method")""")
def method_summary(spark, d):
    return _round(audits.method_summary(_methods(spark, d), ANGLES, (4, 7)))


@_query(f"""{_AXES} SELECT "method", {", ".join(f"CAST(sum(feasible) FILTER (branch_id = {b}) AS BIGINT) AS branch_{b}" for b in range(10))} FROM mr GROUP BY ALL""")
def method_matrix(spark, d):
    out = audits.method_matrix(_methods(spark, d), "branch_id", range(10))
    return out.select("method", *[F.col(str(b)).alias(f"branch_{b}") for b in range(10)])


@_query(f"""{_AXES} SELECT m."method", m.point_index, round(degrees(acos(greatest(-1, least(1, {_xyz('m.n% * b.n%', ' + ')})))), 4) AS degrees FROM mr m JOIN mr b ON b.point_index = m.point_index AND b."method" = 'own' WHERE m."method" <> 'own'""")
def method_angles(spark, d):
    """How far the other axes are from the point's own."""
    return audits.against_baseline(_methods(spark, d), "own").where("method <> 'own'").select("method", "point_index", rounded(F.col("degrees"), 4).alias("degrees"))


@_query(f"""{_AXES} SELECT point_index, before, after, after - before AS gain FROM (SELECT point_index, max(feasible) FILTER (axis_index = 0) AS before, max(feasible) FILTER (axis_index = 2) AS after FROM ac GROUP BY ALL) ORDER BY gain DESC, point_index LIMIT 30""")
def axis_improvements(spark, d):
    """A top-30 report: the points that gain most from the bisector."""
    return audits.improvements(_counts(spark, d), 0, 2, 30)


@_query(f"""{_AXES} SELECT branch_id, count(*) AS points, round(avg(feasible), 6) AS feasible_mean, round(median(feasible), 6) AS feasible_p50, round(quantile_cont(CAST(feasible AS DOUBLE), 0.95), 6) AS feasible_p95, count(*) FILTER (feasible < 3) AS few_low, count(*) FILTER (feasible > 12) AS many FROM mr GROUP BY ALL""")
def branch_thresholds(spark, d):
    out = audits.threshold_summary(_methods(spark, d), "branch_id", {"few_low": ("feasible", 3), "many": ("feasible", 12)}, ["feasible"])
    return _round(out)


@_query(f"""{_CANDIDATES}, fa AS (SELECT vec_id AS point_index, {", ".join(f"CAST(embedding[{13 + i}] AS DOUBLE) + 0.05e0 * CAST(embedding[{19 + i}] AS DOUBLE) AS p{a}" for i, a in enumerate("xyz"))} FROM embeddings),
fo AS (SELECT fr.*, {_xyz("p% / sqrt(px * px + py * py + pz * pz) AS p%")} FROM fr JOIN fa USING (point_index)),
fo2 AS (SELECT abs(tx * ax + ty * ay + tz * az) AS d, degrees(acos(greatest(-1, least(1, px * ax + py * ay + pz * az)))) AS patch FROM fo)
SELECT round(max(d), 6) AS max_tangent_dot_axis, 0e0 AS max_rotation, 0e0 AS median_rotation, round(max(patch), 4) AS max_patch, round(median(patch), 4) AS median_patch, count(*) FILTER (patch > 2) AS beyond_2, count(*) FILTER (patch > 5) AS beyond_5, count(*) FILTER (patch > 10) AS beyond_10 FROM fo2""")
def frame_audit(spark, d):
    """Frames against their normals and against slightly turned patch normals."""
    e = views.embeddings(spark, d)
    patch = e.select(F.col("vec_id").alias("point_index"), *named(tuple(F.element_at("embedding", 13 + i).cast("double") + 0.05 * F.element_at("embedding", 19 + i).cast("double") for i in range(3)), "p"))
    out = audits.frame_audit(_framed(spark, d).join(views.normals(spark, d), "point_index").join(patch, "point_index"))
    return out.select(*[rounded(F.col(c), 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@_query(f"""
, er AS (SELECT branch_id AS case_name, CASE WHEN branch_id = 5 THEN 'normalized' ELSE 'source_obj' END AS frame, max(sqrt({_xyz('(% - round(%, 3)) ** 2', ' + ')})) AS error FROM g_points GROUP BY ALL),
st AS (SELECT *, CASE WHEN frame = 'source_obj' AND error <= 0.00084e0 THEN 'pass' ELSE 'fail' END AS status FROM er)
SELECT case_name, frame, round(error, 6) AS error, status, count(*) FILTER (status = 'pass') OVER () AS passed, count(*) FILTER (status = 'fail') OVER () AS failed FROM st""")
def alignment_report(spark, d):
    """Branches whose exported points, of three digits, are where they were."""
    off = F.sqrt(sum(((F.col(a) - F.round(a, 3)) * (F.col(a) - F.round(a, 3)) for a in "xyz"), F.lit(0.0)))
    errors = views.points(spark, d).groupBy(F.col("branch_id").alias("case_name")).agg(F.max(off).alias("error")).withColumn("frame", F.when(F.col("case_name") == 5, "normalized").otherwise("source_obj"))
    return _round(audits.alignment_report(errors, 0.00084).select("case_name", "frame", "error", "status", "passed", "failed"))


@_query(f"""{_JUDGED}, p AS (SELECT branch_id, point_index, count(*) AS n, count(*) FILTER (feasible) AS ok FROM jd GROUP BY ALL),
cs AS (SELECT branch_id, CAST(sum(n) AS BIGINT) AS poses, CAST(sum(ok) AS BIGINT) AS feasible, round(sum(ok) / sum(n), 6) AS ratio, count(*) AS points, count(*) FILTER (ok = 0) AS without FROM p GROUP BY branch_id)
SELECT branch_id AS case_id, poses, feasible, ratio, points, without, 'completed' AS status, NULL AS error FROM cs WHERE branch_id <> 3
UNION ALL SELECT 3, -1, -1, NULL, -1, -1, 'failed', 'no root line'
UNION ALL SELECT -1, -1, -1, NULL, -1, -1, 'completed_with_failures', (SELECT count(*) FROM cs WHERE branch_id <> 3) || ' completed, 1 failed'""")
def batch_report(spark, d):
    """Branches as cases of a batch, one of which fails."""
    cases = reports.cases(_judged(spark, d), "branch_id").select(F.col("branch_id").alias("case_id"), "poses", "feasible", F.round(F.col("feasible") / F.col("poses"), 6).alias("ratio"), "points", "without")
    failed = views.points(spark, d).where("branch_id = 3").select(F.col("branch_id").alias("case_id"), F.lit("no root line").alias("error")).distinct()
    return audits.batch(cases.where("case_id <> 3"), failed).fillna(-1, ["case_id", "poses", "feasible", "points", "without"])


@_query(" SELECT point_index, CAST(round(x, 2) + 0.0e0 AS VARCHAR) || ';' || CAST(round(y, 2) + 0.0e0 AS VARCHAR) AS place FROM g_points")
def csv_cells(spark, d):
    """Vectors as cells of a CSV file."""
    return runs.csv_ready(views.points(spark, d).select("point_index", F.array(rounded(F.col("x"), 2), rounded(F.col("y"), 2)).alias("place")))
