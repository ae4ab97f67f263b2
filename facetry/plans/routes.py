"""Registered queries of side layers, refused sides, covering ways and their records. Their tool is small enough that some
sides have a way and others none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import rounded
from ..operators import curves, meshes, paths
from . import views
from .queries import _FEASIBLE, RADIUS, _feasible_sided, _query, _round, _xyz

HALF, TOOL = 0.5, 0.008

_WAYS = _FEASIBLE.replace(f"{RADIUS}e0", f"{TOOL}e0")
_LAYERS = f"""{_WAYS}
, sl AS MATERIALIZED (SELECT g.point_index, CAST(g.branch_id AS INTEGER) AS branch_id, g.seq, s.side AS lateral_side, (SELECT count(*) FROM fn WHERE fn.branch_id = g.branch_id AND fn.seq = g.seq AND fn.lateral_side = s.side) AS nodes FROM g_points g, (VALUES (1), (-1)) s(side))"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return _feasible_sided(spark, d, TOOL)


def _side_layers(spark: SparkSession, d: str) -> DataFrame:
    return paths.side_layers(views.points(spark, d), _nodes(spark, d))


@_query(f"{_LAYERS} SELECT point_index, branch_id, seq, lateral_side, nodes FROM sl")
def side_layers(spark, d):
    """Feasible poses of every point on either side."""
    return _side_layers(spark, d).select("point_index", "branch_id", "seq", "lateral_side", "nodes")


_PLANNED = f"{_LAYERS}, mi AS (SELECT branch_id, lateral_side, count(*) AS points, count(*) FILTER (nodes = 0) AS missing FROM sl GROUP BY ALL)"


@_query(f"""{_PLANNED}
SELECT mi.branch_id, mi.lateral_side, CASE WHEN missing = 0 THEN 'ok' ELSE 'no_path' END AS status, points, missing, CASE WHEN missing = 0 THEN round(cost, 6) END AS cost FROM mi LEFT JOIN fb ON fb.branch_id = mi.branch_id AND fb.lateral_side = mi.lateral_side""")
def layered_status(spark, d):
    """Is there a way through one feasible pose of every point, and its cost."""
    return _round(paths.planned(views.points(spark, d), _nodes(spark, d)))


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return curves.arc_lengths(views.points(spark, d)).select("point_index", "branch_id", "seq", "arc_length")



_COVERING = f"""{_LAYERS}
, ar0 AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS step FROM g_points WINDOW w AS (PARTITION BY branch_id ORDER BY seq)),
ar AS MATERIALIZED (SELECT point_index, sum(step) OVER (PARTITION BY branch_id ORDER BY seq) AS s FROM ar0),
cb0 AS (SELECT sl.*, s, nodes = 0 AS missing, lead(s) OVER w AS after, lag(s) OVER w AS before, max(s) OVER (PARTITION BY branch_id, lateral_side) AS total FROM sl JOIN ar USING (point_index) WINDOW w AS (PARTITION BY branch_id, lateral_side ORDER BY seq)),
cb AS MATERIALIZED (SELECT *, greatest(s - {HALF}e0, coalesce(last_value(CASE WHEN missing THEN coalesce((s + after) / 2, s) END IGNORE NULLS) OVER (PARTITION BY branch_id, lateral_side ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) AS "left",
  least(s + {HALF}e0, coalesce(first_value(CASE WHEN missing THEN coalesce((s + before) / 2, s) END IGNORE NULLS) OVER (PARTITION BY branch_id, lateral_side ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), total)) AS "right", greatest(1, total) * 1e-9 AS tol FROM cb0),
cn AS (SELECT cb.branch_id, cb.lateral_side, list({{'seq': cb.seq, 'k': angle_index, 'x': cx, 'y': cy, 'z': cz, 's': s, 'l': "left", 'r': "right"}} ORDER BY cb.seq, angle_index) AS ns, any_value(total) AS total, any_value(tol) AS tol
  FROM fn JOIN cb ON fn.branch_id = cb.branch_id AND fn.lateral_side = cb.lateral_side AND fn.seq = cb.seq WHERE "left" <= "right" + tol GROUP BY ALL),
cr AS (SELECT *, 0 AS i, CAST([] AS DOUBLE[]) AS costs, CAST([] AS BIGINT[]) AS before FROM cn
  UNION ALL SELECT branch_id, lateral_side, ns, total, tol, i + 1, list_append(costs, CASE WHEN ns[i + 1].l <= tol THEN 0e0 ELSE coalesce(ways[1].c, 'infinity'::DOUBLE) END), list_append(before, CASE WHEN ns[i + 1].l <= tol THEN 0 ELSE coalesce(ways[1].j, 0) END)
  FROM (SELECT *, list_sort(list_filter(list_transform(range(1, i + 1), lambda j: CASE WHEN ns[j].seq < ns[i + 1].seq AND ns[i + 1].l <= ns[j].r + tol AND ns[i + 1].r > ns[j].r + tol AND ns[i + 1].s - ns[j].s <= {2 * HALF}e0 + tol
    THEN {{'c': costs[j] + sqrt((ns[j].x - ns[i + 1].x) ** 2 + (ns[j].y - ns[i + 1].y) ** 2 + (ns[j].z - ns[i + 1].z) ** 2), 'j': j}} END), lambda w: w IS NOT NULL)) AS ways FROM cr WHERE i < len(ns))),
ce AS (SELECT branch_id, lateral_side, ns, before, e.c AS cost, e.j AS at_node FROM (SELECT *, list_sort(list_filter(list_transform(range(1, len(ns) + 1), lambda j: CASE WHEN ns[j].r >= total - tol AND costs[j] < 'infinity'::DOUBLE THEN {{'c': costs[j], 'j': j}} END), lambda w: w IS NOT NULL))[1] AS e FROM cr WHERE i = len(ns)) WHERE e IS NOT NULL),
ct AS (SELECT * FROM ce UNION ALL SELECT branch_id, lateral_side, ns, before, cost, before[at_node] FROM ct WHERE before[at_node] > 0),
cw AS (SELECT branch_id, lateral_side, ns[at_node].seq AS seq, ns[at_node].k AS candidate_index, ns[at_node].l AS "left", ns[at_node].r AS "right", cost FROM ct)"""


@_query(f"""{_COVERING} SELECT CAST(branch_id AS INTEGER) AS branch_id, lateral_side, seq, CAST(candidate_index AS BIGINT) AS candidate_index, round("left", 6) AS "left", round("right", 6) AS "right", round(cost, 6) AS cost FROM cw""")
def coverage_path(spark, d):
    """The chosen poses of the shortest covering way of every branch and side."""
    return _round(paths.covering(_curve(spark, d), _nodes(spark, d), HALF))


@_query(f"""{_COVERING}, gp AS (SELECT *, greatest(0, lead("left") OVER (PARTITION BY branch_id, lateral_side ORDER BY seq) - "right") AS gap FROM cw),
fd AS (SELECT branch_id, lateral_side, any_value(cost) AS cost, count(*) AS chosen, coalesce(max(gap), 0) AS gap, min("left") AS low, max("right") AS high FROM gp GROUP BY ALL),
en AS (SELECT branch_id, lateral_side, count(*) AS points, any_value(total) AS total, any_value(tol) AS tol FROM cb GROUP BY ALL)
SELECT en.branch_id, en.lateral_side, CASE WHEN chosen IS NULL THEN 'no_path' ELSE 'ok' END AS status, round(cost, 6) AS cost, coalesce(chosen, 0) AS chosen, points - coalesce(chosen, 0) AS skipped, round(gap, 6) AS gap, coalesce(low <= tol AND high >= total - tol AND gap <= tol, false) AS union_ok
FROM en LEFT JOIN fd ON fd.branch_id = en.branch_id AND fd.lateral_side = en.lateral_side""")
def coverage_check(spark, d):
    """Status, cost and gaps of every covering way."""
    return _round(paths.covered(_curve(spark, d), paths.covering(_curve(spark, d), _nodes(spark, d), HALF)))


_FRAME = f", bx AS (SELECT {_xyz('(min(%) + max(%)) / 2 AS m%')}, greatest({_xyz('max(%) - min(%)')}) AS size FROM g_points)"


def _frame(spark: SparkSession, d: str) -> DataFrame:
    return meshes.bbox_frame(views.points(spark, d))


@_query(f"""{_WAYS}{_FRAME}, nd AS (SELECT fn.* FROM fn JOIN fb ON fn.branch_id = fb.branch_id AND fn.lateral_side = fb.lateral_side AND fn.angle_index = fb.way[fn.layer])
SELECT CAST(nd.branch_id AS INTEGER) AS branch_id, nd.lateral_side, nd.seq, fz.point_index, CAST(nd.angle_index AS BIGINT) AS candidate_index, round(degrees(nd.angle), 6) AS angle_deg, round(fz.ex * fz.qx + fz.ey * fz.qy + fz.ez * fz.qz, 6) + 0.0 AS lateral_projection,
  {_xyz('round(nd.c%, 6) + 0.0 AS norm_%')}, {_xyz('round(nd.c% * size + m%, 6) + 0.0 AS source_%')}, {_xyz('round(fz.a%, 6) + 0.0 AS a%')}
FROM nd JOIN fz ON fz.branch_id = nd.branch_id AND fz.seq = nd.seq AND fz.angle_index = nd.angle_index, bx""")
def path_records(spark, d):
    """The nodes of the shortest ways in the normalised and the source frame."""
    nodes = _nodes(spark, d)
    way = paths.chosen(nodes).select("branch_id", "lateral_side", "seq", "candidate_index")
    return _round(paths.node_records(nodes.join(way, way.columns), _frame(spark, d)))


@_query(f"""{_PLANNED}{_FRAME}, nd AS (SELECT fn.*, ax, ay, az FROM fn JOIN fb ON fn.branch_id = fb.branch_id AND fn.lateral_side = fb.lateral_side AND fn.angle_index = fb.way[fn.layer] JOIN (SELECT DISTINCT branch_id, seq, ax, ay, az FROM fz) z ON z.branch_id = fn.branch_id AND z.seq = fn.seq),
sg AS (SELECT *, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2 + (cz - lag(cz) OVER w) ** 2) AS seg, abs(degrees(angle - lag(angle) OVER w)) AS t, degrees(acos(greatest(-1, least(1, ax * lag(ax) OVER w + ay * lag(ay) OVER w + az * lag(az) OVER w)))) AS turned FROM nd WINDOW w AS (PARTITION BY branch_id, lateral_side ORDER BY seq)),
mt AS (SELECT branch_id, lateral_side, max(seg) AS max_segment, max(least(t, 360 - t)) AS max_turn, avg(least(t, 360 - t)) AS mean_turn, max(turned) AS max_axis_step, avg(turned) AS mean_axis_step FROM sg GROUP BY ALL)
SELECT mi.branch_id, mi.lateral_side, CASE WHEN mi.lateral_side > 0 THEN '+q' ELSE '-q' END AS side_name, CASE WHEN missing = 0 THEN 'ok' ELSE 'no_path' END AS status, points, missing, CASE WHEN missing = 0 THEN round(cost, 6) END AS length_norm, CASE WHEN missing = 0 THEN round(cost * size, 6) END AS length_source,
  {", ".join(f"CASE WHEN missing = 0 THEN round({c}, 4) END AS {c}" for c in ("max_segment", "max_turn", "mean_turn", "max_axis_step", "mean_axis_step"))}, CAST(CASE WHEN missing = 0 THEN 1 ELSE 0 END AS BIGINT) AS ways
FROM mi LEFT JOIN fb ON fb.branch_id = mi.branch_id AND fb.lateral_side = mi.lateral_side LEFT JOIN mt ON mt.branch_id = mi.branch_id AND mt.lateral_side = mi.lateral_side, bx""")
def side_records(spark, d):
    """Every branch and side as a report. No two ways of these poses are equally short."""
    out = paths.side_records(views.points(spark, d), _nodes(spark, d), _frame(spark, d))
    fine = {c: rounded(F.col(c), 4).alias(c) for c in ("max_segment", "max_turn", "mean_turn", "max_axis_step", "mean_axis_step")}
    return out.select(*[fine.get(c, rounded(F.col(c)).alias(c) if t == "double" else F.col(c)) for c, t in out.dtypes])


@_query(f"""
, gn AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, label AS branch_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 3 AS seq, {", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE) * 5) / 5 AS {a}" for i, a in enumerate("xyz"))} FROM embeddings),
gw AS (SELECT branch_id, seq, vec_id, x, y, z, CAST(0 AS DOUBLE) AS cost, CAST(1 AS BIGINT) AS ways FROM gn WHERE seq = 0
  UNION ALL SELECT branch_id, seq, vec_id, x, y, z, least_cost, CAST(least(2, list_sum(list_transform(list_filter(each, lambda e: e.c <= least_cost + 1e-9 * greatest(1, least_cost)), lambda e: e.w))) AS BIGINT)
  FROM (SELECT *, list_min(list_transform(each, lambda e: e.c)) AS least_cost FROM (SELECT n.branch_id, n.seq, n.vec_id, n.x, n.y, n.z, list({{'c': p.cost + sqrt((n.x - p.x) ** 2 + (n.y - p.y) ** 2 + (n.z - p.z) ** 2), 'w': p.ways}}) AS each
    FROM gw p JOIN gn n ON n.branch_id = p.branch_id AND n.seq = p.seq + 1 GROUP BY ALL))),
ge AS (SELECT gw.branch_id, list({{'c': cost, 'w': ways}}) AS each FROM gw JOIN (SELECT branch_id, max(seq) AS top FROM gn GROUP BY ALL) t ON gw.branch_id = t.branch_id AND gw.seq = top GROUP BY ALL)
SELECT CAST(branch_id AS INTEGER) AS branch_id, 1 AS lateral_side, round(list_min(list_transform(each, lambda e: e.c)), 6) AS cost,
  CAST(least(2, list_sum(list_transform(list_filter(each, lambda e: e.c <= list_min(list_transform(each, lambda f: f.c)) + 1e-9 * greatest(1, e.c)), lambda e: e.w))) AS BIGINT) AS ways FROM ge""")
def co_optimal_ways(spark, d):
    """Is the shortest way through points on a coarse grid, three a layer, the only one?"""
    p = views.points(spark, d)
    grid = {a: F.round(F.col(a) * 5) / 5 for a in "xyz"}
    nodes = p.withColumns(grid).select("branch_id", F.lit(1).alias("lateral_side"), F.floor((F.col("seq") - 1) / 3).alias("seq"), F.col("point_index").alias("candidate_index"), "x", "y", "z")
    return _round(paths.co_optimal(nodes))
