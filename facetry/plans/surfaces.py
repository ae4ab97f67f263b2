"""Registered queries of surface normals, over a roof made of the embeddings: a height field of 16 columns with a ridge in
the middle, every third face of which is wound the wrong way. The SQL clusters by recursion over lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import rounded
from ..operators import normals
from . import views
from .checks import _dot, _sql_segment
from .queries import _query, _round, _xyz

CONFIG = normals.Config(radius=0.2, sigma_scale=0.06)
_C = {k: f"{v!r}e0" if isinstance(v, float) else str(v) for k, v in vars(CONFIG).items() if k != "max_condition"}


def roof_vertices(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    ridge = 0.03 * F.abs(i % 16 - 7.5) + 0.004 * F.element_at("embedding", 1).cast("double")
    return views.embeddings(spark, d).select(i.alias("vertex_id"), (0.05 * (i % 16)).alias("x"), (0.05 * F.floor(i / 16)).alias("y"), ridge.alias("z"))


def roof_faces(spark: SparkSession, d: str) -> DataFrame:
    e = views.embeddings(spark, d)
    i, n = F.col("vec_id"), e.agg(F.count("*")).scalar()
    cells = e.where((i % 16 < 15) & (i + 17 < n))
    sides = F.array(F.struct((2 * i).alias("face_id"), i.alias("v0"), (i + 1).alias("p"), (i + 16).alias("q")), F.struct((2 * i + 1).alias("face_id"), (i + 1).alias("v0"), (i + 17).alias("p"), (i + 16).alias("q")))
    turned = F.col("face_id") % 3 == 0
    made = cells.select(F.explode(sides).alias("f")).select("f.*")
    return made.select("face_id", "v0", F.when(turned, F.col("q")).otherwise(F.col("p")).alias("v1"), F.when(turned, F.col("p")).otherwise(F.col("q")).alias("v2"))


def roof_points(spark: SparkSession, d: str) -> DataFrame:
    v = roof_vertices(spark, d)
    return v.select(F.col("vertex_id").alias("point_index"), (F.col("x") + 0.01).alias("x"), (F.col("y") + 0.02).alias("y"), (F.col("z") + 0.001).alias("z"))


def _mesh(spark: SparkSession, d: str) -> DataFrame:
    return normals._written(normals.prepared(roof_faces(spark, d), roof_vertices(spark, d))[0])


_ROOF = f"""
, gv AS MATERIALIZED (SELECT vec_id AS vertex_id, 0.05e0 * (vec_id % 16) AS x, 0.05e0 * (vec_id // 16) AS y, 0.03e0 * abs(vec_id % 16 - 7.5e0) + 0.004e0 * CAST(embedding[1] AS DOUBLE) AS z FROM embeddings),
gf0 AS (SELECT 2 * vec_id + k AS face_id, vec_id + k AS v0, CASE k WHEN 0 THEN vec_id + 1 ELSE vec_id + 17 END AS p, vec_id + 16 AS q FROM embeddings, (VALUES (0), (1)) v(k), (SELECT count(*) AS n FROM embeddings) WHERE vec_id % 16 < 15 AND vec_id + 17 < n),
gf AS MATERIALIZED (SELECT face_id, v0, CASE WHEN face_id % 3 = 0 THEN q ELSE p END AS v1, CASE WHEN face_id % 3 = 0 THEN p ELSE q END AS v2 FROM gf0),
gt AS (SELECT gf.*, {", ".join(f"{t}.{a} AS {k}{a}" for t, k in zip(("p0", "p1", "p2"), "abc") for a in "xyz")} FROM gf JOIN gv p0 ON p0.vertex_id = v0 JOIN gv p1 ON p1.vertex_id = v1 JOIN gv p2 ON p2.vertex_id = v2),
us AS (SELECT least(p, q) AS lo, greatest(p, q) AS hi, count(*) AS uses, min(face_id) AS a, max(face_id) AS b, count(*) FILTER (p < q) AS ups
  FROM (SELECT face_id, v0 AS p, v1 AS q FROM gf UNION ALL SELECT face_id, v1, v2 FROM gf UNION ALL SELECT face_id, v2, v0 FROM gf) GROUP BY ALL),
cv AS (SELECT 2 * a + i AS p, 2 * b + (i + CASE WHEN ups <> 1 THEN 1 ELSE 0 END) % 2 AS q FROM us, (VALUES (0), (1)) v(i) WHERE uses = 2 AND a < b),
un AS (SELECT p, q FROM cv UNION SELECT q, p FROM cv),
rc AS (SELECT 2 * face_id + i AS node, 2 * face_id + i AS reached FROM gf, (VALUES (0), (1)) v(i) UNION SELECT rc.node, un.q FROM rc JOIN un ON rc.reached = un.p),
lb AS (SELECT node, min(reached) AS c FROM rc GROUP BY node),
wd AS MATERIALIZED (SELECT e.node // 2 AS face_id, least(e.c, o.c) // 2 AS component, e.c <> o.c AND e.c % 2 = 1 AS flip, e.c <> o.c AS orientable FROM lb e JOIN lb o ON o.node = e.node + 1 WHERE e.node % 2 = 0)"""
_PREPARED = f"""{_ROOF}
, vo AS (SELECT sum(CASE WHEN flip THEN -1 ELSE 1 END * (ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx))) / 6 AS v FROM gt JOIN wd USING (face_id)),
m0 AS (SELECT gt.*, flip, CASE WHEN flip <> (v < 0) THEN -1 ELSE 1 END AS s, (by - ay) * (cz - az) - (bz - az) * (cy - ay) AS kx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ky, (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) AS kz FROM gt JOIN wd USING (face_id), vo),
mp AS MATERIALIZED (SELECT * EXCLUDE (kx, ky, kz, s), {_xyz("s * k% / sqrt(kx * kx + ky * ky + kz * kz) AS n%")}, sqrt(kx * kx + ky * ky + kz * kz) / 2 AS area FROM m0)"""
_MEMBERS = f"""{_PREPARED}
, gq AS MATERIALIZED (SELECT vertex_id AS point_index, x + 0.01e0 AS x, y + 0.02e0 AS y, z + 0.001e0 AS z FROM gv),
md AS (SELECT *, {_xyz('(a% + b% + c%) / 3 AS q%')} FROM mp),
kn AS (SELECT * FROM (SELECT g.point_index, {_xyz('g.%')}, md.*, row_number() OVER (PARTITION BY g.point_index ORDER BY sqrt({_xyz('(g.% - q%) ** 2', ' + ')}), face_id) AS n FROM gq g, md) WHERE n <= {CONFIG.faces}),
n1 AS (SELECT *, {_xyz('(% - a%) * n%', ' + ')} AS f FROM kn),
n2 AS (SELECT *, {_xyz('% - f * n% AS h%')} FROM n1),
""" + ",\n".join(f"n{i} AS (SELECT *, nx * (({q}y - {p}y) * (hz - {p}z) - ({q}z - {p}z) * (hy - {p}y)) + ny * (({q}z - {p}z) * (hx - {p}x) - ({q}x - {p}x) * (hz - {p}z)) + nz * (({q}x - {p}x) * (hy - {p}y) - ({q}y - {p}y) * (hx - {p}x)) AS k{i} FROM n{i - 1})" for i, (p, q) in enumerate(("ab", "bc", "ca"), 3)) + f""",
ex AS (SELECT point_index, face_id, nx, ny, nz, area, CASE WHEN (k3 >= 0 AND k4 >= 0 AND k5 >= 0) OR (k3 <= 0 AND k4 <= 0 AND k5 <= 0) THEN abs(f) ELSE sqrt(least({_sql_segment('a', 'b')}, {_sql_segment('b', 'c')}, {_sql_segment('c', 'a')})) END AS distance FROM n5),
rk AS (SELECT *, row_number() OVER (PARTITION BY point_index ORDER BY round(distance, 9), face_id) AS rank, count(*) FILTER (distance <= {_C['radius']}) OVER (PARTITION BY point_index) AS inside FROM ex),
mb AS MATERIALIZED (SELECT point_index, rank, face_id, distance, nx, ny, nz, area FROM rk WHERE CASE WHEN inside >= {_C['min_faces']} THEN distance <= {_C['radius']} ELSE rank <= {_C['min_faces']} END)"""

_COS = repr(math.cos(math.radians(CONFIG.cluster_degrees))) + "e0"


def _angle(p: str, q: str) -> str:
    return f"degrees(acos(greatest(-1, least(1, {_dot(p, q)}))))"


def _merged(c: str, o: str, ranks: str) -> str:
    """A cluster with another's sum added."""
    s = {a: f"({c}.{a} + {o}.{a})" for a in "xyz"}
    size = "sqrt(" + " + ".join(f"{v} * {v}" for v in s.values()) + ")"
    return "{" + ", ".join([*(f"'{a}': {v}" for a, v in s.items()), *(f"'u{a}': CASE WHEN {size} > 1e-12 THEN {v} / {size} ELSE 0e0 END" for a, v in s.items()), f"'rs': {ranks}"]) + "}"


def _clusters(source: str, out: str, least: int, key: str = "point_index") -> str:
    """CTEs that end in out: the members of source with their cluster, as `normals.clustered` gives them."""
    same = " AND ".join(f"m.{k.strip()} = c.{k.strip()}" for k in key.split(","))
    pair = "list_filter(flatten(list_transform(range(1, len(cs) + 1), lambda a: list_transform(range(a + 1, len(cs) + 1), lambda b: CASE WHEN cs[a].ux * cs[b].ux + cs[a].uy * cs[b].uy + cs[a].uz * cs[b].uz >= {0} THEN {{'a': a, 'b': b}} END))), lambda p: p IS NOT NULL)[1]".format(_COS)
    return f"""
, {out}_l AS (SELECT {key}, list({{'x': nx, 'y': ny, 'z': nz, 'r': rank}} ORDER BY rank) AS ns FROM {source} GROUP BY ALL),
{out}_r AS (SELECT {key}, ns, 0 AS i, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, z DOUBLE, ux DOUBLE, uy DOUBLE, uz DOUBLE, rs BIGINT[])[]) AS cs, false AS done FROM {out}_l
  UNION ALL SELECT {key}, ns, i + 1, CASE WHEN i < len(ns) THEN CASE WHEN best IS NULL THEN list_append(cs, {{'x': n.x, 'y': n.y, 'z': n.z, 'ux': n.x, 'uy': n.y, 'uz': n.z, 'rs': [n.r]}})
      ELSE list_transform(cs, lambda c, k: CASE WHEN k = best THEN {_merged("c", "n", "list_append(c.rs, n.r)")} ELSE c END) END
    WHEN pair IS NULL THEN cs ELSE list_filter(list_transform(cs, lambda c, k: CASE WHEN k = pair.a THEN {_merged("c", "cs[pair.b]", "list_concat(c.rs, cs[pair.b].rs)")} ELSE c END), lambda c, k: k <> pair.b) END, i >= len(ns) AND pair IS NULL
  FROM (SELECT *, CASE WHEN list_max(dots) >= {_COS} THEN list_position(dots, list_max(dots)) END AS best
    FROM (SELECT *, ns[i + 1] AS n, list_transform(cs, lambda c: c.ux * ns[i + 1].x + c.uy * ns[i + 1].y + c.uz * ns[i + 1].z) AS dots, CASE WHEN i >= len(ns) THEN {pair} END AS pair FROM {out}_r WHERE NOT done))),
{out}_c AS (SELECT {key}, unnest(cs) AS c, generate_subscripts(cs, 1) AS label FROM {out}_r WHERE done),
{out}_m AS (SELECT m.*, label, c.c.ux AS cx, c.c.uy AS cy, c.c.uz AS cz, count(*) OVER (PARTITION BY {", ".join(f"m.{k.strip()}" for k in key.split(","))}, label) AS support FROM {source} m JOIN {out}_c c ON {same} AND list_contains(c.c.rs, m.rank)),
{out} AS MATERIALIZED (SELECT * EXCLUDE (most), support >= {least} OR (most < {least} AND place = 1) AS kept FROM (SELECT *, sum(area) OVER w AS cluster_area, median(distance) OVER w AS cluster_distance, max({_angle('n', 'c')}) OVER w AS spread_deg,
  dense_rank() OVER (PARTITION BY {key} ORDER BY support DESC, label) AS place, max(support) OVER (PARTITION BY {key}) AS most FROM {out}_m WINDOW w AS (PARTITION BY {key}, label)))"""


_ONE = "{" + ", ".join(f"'{c}': {c}" for c in ("place", "support", "cluster_area", "cluster_distance", "spread_deg", "cx", "cy", "cz", "kept")) + "}"


def _patches(source: str, out: str, key: str = "point_index") -> str:
    """CTEs that end in out: patch stats of clustered members, with the primary (p_*) and secondary (s_*) cluster."""
    fields = ("place", "support", "spread_deg", "cx", "cy", "cz")
    return f"""
, {out}_s AS (SELECT {key}, count(*) AS faces, max(distance) AS patch_radius, any_value({_ONE}) FILTER (place = 2 AND kept AND support >= 2) AS secondary, any_value({_ONE}) FILTER (place = 1) AS first, arg_min({_ONE}, rank) AS nearest,
  {_xyz("sum(area / greatest(distance, 1e-6) * n%) AS m%")} FROM {source} GROUP BY ALL),
{out}_v AS (SELECT DISTINCT {key}, unnest([v0, v1, v2]) AS vertex_id FROM {source} JOIN gf USING (face_id)),
{out}_q AS (SELECT {key}, quantile_cont(sqrt({_xyz("(gv.% - gq.%) ** 2", " + ")}), 0.9) AS patch_scale FROM {out}_v JOIN gv USING (vertex_id) JOIN gq USING (point_index) GROUP BY ALL),
{out}_p AS (SELECT *, CASE WHEN nearest.kept THEN nearest ELSE first END AS prim FROM {out}_s JOIN {out}_q USING ({key})),
{out}_f AS (SELECT {key}, faces, patch_radius, patch_scale, {", ".join(f"prim.{f} AS p_{f}, secondary.{f} AS s_{f}" for f in fields)}, {_xyz("m% / sqrt(mx * mx + my * my + mz * mz) AS m%")} FROM {out}_p),
{out} AS MATERIALIZED (SELECT *, {_angle('p_c', 's_c')} AS angle12, CASE WHEN s_support IS NOT NULL THEN least(p_support, s_support) / greatest(p_support, s_support) END AS support_ratio,
  CASE WHEN s_support IS NOT NULL THEN least(p_support, s_support) END AS min_support FROM {out}_f)"""


@_query(f"{_ROOF} SELECT * FROM wd")
def winding_repair(spark, d):
    """Which faces must flip so that neighbours pass their shared edge in opposite directions."""
    return normals.winding(roof_faces(spark, d))


@_query(f"{_PREPARED} SELECT face_id, {_xyz('round(n%, 6) + 0.0 AS n%')}, round(area, 6) AS area, flip AS flipped FROM mp")
def mesh_prepared(spark, d):
    return _round(_mesh(spark, d).select("face_id", "nx", "ny", "nz", "area", "flipped"))


@_query(f"""{_PREPARED} SELECT (SELECT count(DISTINCT component) FROM wd) AS components, (SELECT count(*) FROM wd WHERE flip) AS flipped_faces, (SELECT count(DISTINCT component) FROM wd WHERE NOT orientable) AS conflicts,
  (SELECT count(*) FROM us WHERE uses > 2) AS crowded_edges, v < 0 AS turned, round(abs(v), 6) AS volume FROM vo""")
def mesh_report(spark, d):
    return _round(normals.prepared(roof_faces(spark, d), roof_vertices(spark, d))[1])


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    points, mesh = roof_points(spark, d), _mesh(spark, d)
    return points, mesh, normals._written(normals.neighbourhoods(points, mesh, CONFIG))


_CLUSTERED = _MEMBERS + _clusters("mb", "cl", CONFIG.min_support)


@_query(f"{_CLUSTERED} SELECT point_index, face_id, place, support, kept, round(spread_deg, 4) AS spread_deg, round(cluster_area, 6) AS cluster_area, round(cluster_distance, 6) AS cluster_distance FROM cl")
def normal_clusters(spark, d):
    """Each point's faces with their cluster of directions."""
    _, _, members = _near(spark, d)
    tagged = normals.clustered(members, CONFIG.cluster_degrees, CONFIG.min_support)
    spread = rounded(F.col("spread_deg"), 4).alias("spread_deg")
    return tagged.select("point_index", "face_id", F.col("place").cast("long").alias("place"), "support", "kept", spread, rounded(F.col("cluster_area")).alias("cluster_area"), rounded(F.col("cluster_distance")).alias("cluster_distance"))


_STATS = "point_index, faces, p_support, coalesce(s_support, 0) AS s_support, round(angle12, 4) AS angle12, round(support_ratio, 6) AS support_ratio, round(patch_scale, 6) AS patch_scale, round(patch_radius, 6) AS patch_radius"


def _shown(stats: DataFrame) -> list[Column]:
    sizes = [rounded(F.col(c)).alias(c) for c in ("support_ratio", "patch_scale", "patch_radius")]
    return [F.col("point_index"), F.col("faces"), F.col("primary.support").alias("p_support"), F.coalesce("secondary.support", F.lit(0)).alias("s_support"), rounded(F.col("angle12"), 4).alias("angle12"), *sizes]


_PATCHED = _CLUSTERED + _patches("cl", "ps")


@_query(f"{_PATCHED} SELECT {_STATS}, {_xyz('round(m%, 6) + 0.0 AS m%')} FROM ps")
def normal_patches(spark, d):
    """The neighbourhood of every point: its two largest surfaces, mean direction and size."""
    points, mesh, members = _near(spark, d)
    stats = normals.patch_stats(normals._written(normals.clustered(members, CONFIG.cluster_degrees, CONFIG.min_support)), points, mesh)
    return stats.select(*_shown(stats), *[rounded(F.col(f"m{a}")).alias(f"m{a}") for a in "xyz"])


_KEY = "point_index, scale"
_SHAPED = (
    _PATCHED
    + f"""
, hd AS (SELECT point_index, count(*) AS held FROM mb GROUP BY ALL),
ns0 AS MATERIALIZED (SELECT mb.*, s.scale FROM mb JOIN hd USING (point_index), (VALUES (12, 0), (24, 12), (48, 24), (96, 48)) s(scale, before) WHERE rank <= scale AND held > before AND least(scale, held) >= 4)"""
    + _clusters("ns0", "ca", 2, _KEY)
    + _patches("ca", "pa", _KEY)
    + f"""
, tr AS (SELECT ca.*, count(*) FILTER (turn <= {_C['trim_degrees']}) OVER (PARTITION BY {_KEY}) AS stay, turn FROM (SELECT ca.*, {_angle('n', 'p_c')} AS turn FROM ca JOIN (SELECT {_KEY}, p_cx, p_cy, p_cz FROM pa) USING ({_KEY})) ca),
tm AS MATERIALIZED (SELECT {_KEY}, rank, face_id, distance, nx, ny, nz, area FROM tr WHERE turn <= {_C['trim_degrees']} OR stay < {max(4, CONFIG.min_support)})"""
    + _clusters("tm", "cb", 2, _KEY)
    + _patches("cb", "pb", _KEY)
    + f"""
, sc AS (SELECT *, p_support * exp(-pow(p_spread_deg / 20, 2)) * CASE WHEN angle12 > 10 THEN 0.5e0 ELSE 1e0 END * (1 - 0.5e0 * least(p_spread_deg / 90, 1)) AS score FROM pb WHERE p_support >= {_C['min_faces']}),
bs AS MATERIALIZED (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY point_index ORDER BY score DESC, scale) AS n FROM sc) WHERE n = 1),
lf AS MATERIALIZED (SELECT * FROM mb WHERE point_index NOT IN (SELECT point_index FROM bs))"""
    + _clusters("lf", "cc", 1)
    + f"""
, bg AS (SELECT *, max(CASE WHEN place = 1 THEN support END) OVER (PARTITION BY point_index) >= {_C['min_faces']} AS big FROM cc),
rs AS MATERIALIZED (SELECT point_index, rank, face_id, distance, nx, ny, nz, area FROM bg WHERE NOT big OR place = 1)"""
    + _clusters("rs", "cd2", 1)
    + _patches("cd2", "pd")
    + """
, sh AS (SELECT * EXCLUDE (score), true AS valid FROM bs UNION ALL BY NAME SELECT pd.*, NULL AS scale, big AS valid FROM pd JOIN (SELECT DISTINCT point_index, big FROM bg) USING (point_index))"""
)


@_query(f"{_SHAPED} SELECT {_STATS}, coalesce(scale, 0) AS scale, valid, {_xyz('round(p_c%, 6) + 0.0 AS c%')} FROM sh")
def shape_patch(spark, d):
    """Each point's best patch of 12, 24, 48 or 96 faces, cut down to its main surface."""
    points, mesh, members = _near(spark, d)
    _, stats = normals.shape_patches(members, points, mesh, CONFIG)
    return stats.select(*_shown(stats), F.coalesce("scale", F.lit(0)).alias("scale"), "valid", *[rounded(F.col(f"primary.c{a}")).alias(f"c{a}") for a in "xyz"])


def _guided(n: int, before: str) -> str:
    weight = f"area * exp(-pow(distance / {_C["sigma_scale"]}, 2)) * exp(-pow({_angle("n", "g")} / {_C["sigma_degrees"]}, 2)) / greatest(distance, 1e-6)"
    return f"""
, gw{n} AS (SELECT point_index, {_xyz("sum(w * n%) AS s%")} FROM (SELECT mb.*, {weight} AS w FROM mb JOIN {before} USING (point_index)) GROUP BY ALL),
gu{n} AS (SELECT point_index, {_xyz("s% / sqrt(sx * sx + sy * sy + sz * sz) AS g%")} FROM gw{n})"""


_BILATERAL = _PATCHED + f", gu0 AS (SELECT point_index, {_xyz('p_c% AS g%')} FROM ps)" + _guided(1, "gu0") + _guided(2, "gu1")


@_query(f"{_BILATERAL} SELECT point_index, {_xyz('round(g%, 6) + 0.0 AS g%')} FROM gu2")
def bilateral_normals(spark, d):
    _, _, members = _near(spark, d)
    tagged = normals.clustered(members, CONFIG.cluster_degrees, CONFIG.min_support)
    guides = normals.primary_clusters(tagged).select("point_index", *[F.col(f"primary.c{a}").alias(f"g{a}") for a in "xyz"])
    return _round(normals.bilateral(members, guides, CONFIG))


@_query(None)
def jet_fits(spark, d):
    """Quadric fits on the shape patches; tested against a plain least-squares solver."""
    points, mesh, members = _near(spark, d)
    tagged, stats = (normals._written(x) for x in normals.shape_patches(members, points, mesh, CONFIG))
    sound = stats.where("valid")
    return _round(normals.jet_fits(tagged.join(sound.select("point_index"), "point_index"), sound, points, mesh, CONFIG))


def _chosen(method: str, patches: str, other: str, fallback: str) -> str:
    """The final choice and its reasons where no fit takes part: a crease's bisector, else `other` (a direction's prefix)."""
    crease = f"coalesce(angle12 >= {_C['crease_degrees']} AND support_ratio >= {_C['side_ratio']} AND min_support >= {_C['side_faces']}, false)"
    big, apart = f"f_support >= {_C['side_faces']}", f"coalesce(f_angle >= {_C['crease_degrees']}, false)"
    rules = {
        "invalid_patch": "NOT valid", "primary_support_too_small": f"p_support < {_C['side_faces']}", "degenerate_patch_scale": "patch_scale <= 1e-9", "no_two_sided_support": f"{big} AND NOT {apart}",
        "support_imbalance": f"{big} AND f_ratio < {_C['side_ratio']}", "small_feature_cluster": f"NOT ({big}) AND {apart}", "secondary_surface_ignored": f"{big} AND {apart} AND source <> 'two_side_bisector'",
        "high_primary_spread": f"source IN ('shape_patch_mean', 'primary_cluster_mean') AND p_spread_deg > {_C['trim_degrees']}",
    }
    return f"""
, fs AS (SELECT point_index, s_support AS f_support, angle12 AS f_angle, support_ratio AS f_ratio FROM ps),
ch AS (SELECT p.*, f_support, f_angle, f_ratio, {crease} AS crease, CASE WHEN {crease} THEN 'two_side_bisector' ELSE '{fallback}' END AS source, {_xyz(f"CASE WHEN {crease} THEN p_c% + s_c% ELSE {other}% END AS e%")} FROM {patches} p JOIN fs USING (point_index)
  {"JOIN gu2 USING (point_index)" if other == "g" else ""}),
cr AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items())}], lambda r: r IS NOT NULL) AS reasons FROM ch)
SELECT point_index, {_xyz('round(e% / sqrt(ex * ex + ey * ey + ez * ez), 6) + 0.0 AS n%')}, source, CASE WHEN len(reasons) = 0 THEN 'high' ELSE 'low' END AS confidence, array_to_string(reasons, ',') AS reasons FROM cr"""


def _estimated(spark: SparkSession, d: str, method: str) -> DataFrame:
    out = normals.estimate(roof_points(spark, d), _mesh(spark, d), method, CONFIG)
    return _round(out.select("point_index", "nx", "ny", "nz", "source", "confidence", F.array_join("reasons", ",").alias("reasons")))


@_query(_SHAPED + _chosen("zhong2021", "sh", "p_c", "shape_patch_mean"))
def normals_zhong2021(spark, d):
    return _estimated(spark, d, "zhong2021")


@_query(_BILATERAL + ", pv AS (SELECT *, true AS valid FROM ps)" + _chosen("zhang2015", "pv", "g", "guided_bilateral"))
def normals_zhang2015(spark, d):
    return _estimated(spark, d, "zhang2015")


@_query(None)
def normals_p1(spark, d):
    return _estimated(spark, d, "p1")


@_query(None)
def normals_all(spark, d):
    return _estimated(spark, d, "all")
