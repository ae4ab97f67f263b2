import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from facetry.operators import curves, meshes, paths, poses, spatial
from facetry.plans import audits, checks, flat, lines, routes, summaries, surfaces  # noqa: F401  register their queries
from facetry.plans.queries import ORACLES, QUERIES
from facetry.sources import text

DATA = "/root/testdata/sf0.001"
#: All but some that repeat the work of others.
QUICK = [q for q in ORACLES if q not in ("radius_choice", "reason_counts", "rejecting_conditions", "depth_thresholds", "disk_pairs", "mesh_prepared", "normal_patches", "normals_zhang2015", "radius_scan", "path_metrics", "method_matrix", "method_angles", "branch_thresholds", "axis_improvements")]


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    assert _rows(QUERIES[name](spark, DATA).toPandas()) == _rows(con.sql(ORACLES[name]).df())


def _points(spark, rows):
    return spark.createDataFrame(rows, "point_index long, branch_id int, seq long, x double, y double, z double")


def test_tangent_of_a_single_point(spark):
    (row,) = curves.tangents(_points(spark, [(0, 0, 1, 1.0, 2.0, 3.0)])).collect()
    assert (row.tx, row.ty, row.tz) == (1.0, 0.0, 0.0)


def test_components_of_a_path_and_isolated_vertices(spark):
    v = spark.range(40).select(F.col("id").alias("vertex_id"))
    e = spark.range(29).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.vertex_id: r.component for r in curves.components(v, e).collect()}
    assert got == {i: 0 if i < 30 else i for i in range(40)}


def test_runs_keep_two_runs_of_one_value(spark):
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate([7, 4, 4, 7, 7, 9, 4])], "g string, i long, v int")
    got = sorted((r.v, r.start, r.end) for r in curves.runs(rows, "g", "i", "v").collect())
    assert got == [(4, 1, 3), (4, 6, 7), (7, 0, 1), (7, 3, 5), (9, 5, 6)]


def test_closed_pyramid(spark):
    """A tent over n corners on a circle: the floor's fan and the roof's fan, with the volume of a pyramid."""
    n = 7
    ring = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n), 0.0) for i in range(n)]
    corners = [*ring, (0.0, 0.0, 0.0), (0.0, 0.0, 1.5)]
    faces = [(i, (i + 1) % n, n + 1) for i in range(n)] + [((i + 1) % n, i, n) for i in range(n)]
    f = spark.createDataFrame([(i, *x) for i, x in enumerate(faces)], "face_id long, v0 long, v1 long, v2 long")
    v = spark.createDataFrame([(i, *x) for i, x in enumerate(corners)], "vertex_id long, x double, y double, z double")
    floor = n * math.sin(2 * math.pi / n) / 2
    assert meshes.closed(f).first().closed
    assert abs(meshes.signed_volume(meshes.gathered(f, v)).first().volume - floor * 1.5 / 3) < 1e-9
    assert not meshes.closed(f.where("face_id > 0")).first().closed
    assert not meshes.closed(f.where("false")).first().closed


def test_degenerate_triangle_has_no_normal(spark):
    cols = ", ".join(f"{k}{a} double" for k in "abc" for a in "xyz")
    t = spark.createDataFrame([(0, *[1.0] * 9)], f"face_id long, {cols}")
    row = meshes.metrics(t).first()
    assert row.nx is None and not row.valid


def test_nearest_of_fewer_rows_than_k(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "k long, x double, y double, z double")
    right = spark.createDataFrame([(7, 5.0, 0.0, 0.0), (8, 9.0, 0.0, 0.0)], "r long, qx double, qy double, qz double")
    assert [r.r for r in spatial.nearest(left, right, "k", ["r"], 3).orderBy("rank").collect()] == [7, 8]


def test_ring_of_one_state(spark):
    rows = spark.createDataFrame([(p, i, p == 1) for p in (0, 1) for i in range(4)], "point_index long, angle_index int, feasible boolean")
    assert sorted((r.point_index, r.start, r.end) for r in poses.ring_runs(rows, 4).collect()) == [(0, 0, 4), (1, 0, 4)]


def test_layered_path_against_all_ways(spark):
    from itertools import product
    from math import dist

    layers = [[(0.0, 0.1 * i * s, 0.3 * s * i * i) for i in range(3)] for s in (1, 2, 3, 4)]
    rows = [(0, 1, s, i, *p) for s, layer in enumerate(layers) for i, p in enumerate(layer)]
    got = paths.layered(spark.createDataFrame(rows, "branch_id int, lateral_side int, seq long, candidate_index long, x double, y double, z double")).first()
    best = min((sum(dist(a[w], b[v]) for a, b, w, v in zip(layers, layers[1:], way, way[1:])), way) for way in product(range(3), repeat=4))
    assert abs(got.cost - best[0]) < 1e-12 and tuple(got.way) == best[1]


def test_side_signs_start_anew_at_a_zero_product(spark):
    q = [(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (0.0, -1.0)]
    rows = spark.createDataFrame([(i, 0, i, x, y, 0.0) for i, (x, y) in enumerate(q)], "point_index long, branch_id int, seq long, qx double, qy double, qz double")
    assert [r.sign for r in paths.side_signs(rows).orderBy("seq").collect()] == [1, -1, 1, -1, -1]


def test_obj_fan_and_negative_index(spark):
    lines = ["# c", "v 0 0 0", "v 1 0 0", "v 1 1 0", "f -3 -2 -1", "v 0 1 0", "f 1/1 2/2 3/3 4/4"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, value string")
    assert sorted((r.v0, r.v1, r.v2) for r in text.obj_faces(df).collect()) == [(0, 1, 2), (0, 1, 2), (0, 2, 3)]
    bad = df.where("line_no < 4").unionByName(spark.createDataFrame([("f", 9, "f 1 2 9")], df.schema))
    with pytest.raises(Exception, match="out of range"):
        text.obj_faces(bad).collect()


def test_ply_body(spark):
    lines = ["ply", "format ascii 1.0", "element vertex 2", "element edge 1", "end_header", "0 1 2 9 9 9", "3 4 5 9 9 9", "0 1"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, value string")
    assert sorted((r.vertex_id, r.x, r.y, r.z) for r in text.ply_points(df).collect()) == [(0, 0.0, 1.0, 2.0), (1, 3.0, 4.0, 5.0)]


def test_candidates_reject_bad_parameters(spark):
    for bad in ({"radius": 0.0}, {"radius": 1.0, "depth": 1.0}, {"radius": 1.0, "angles": 3}):
        with pytest.raises(ValueError):
            poses.candidates(spark.range(1), **({"angles": 8} | bad))


def test_nearest_keeps_rows_without_place(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 1.0, 1.0)], "id long, x double, y double, z double")
    right = spark.createDataFrame([(5, 0.3, 0.0, 0.0), (6, 9.0, 0.0, 0.0), (7, 0.0, None, 0.0)], "point_id long, qx double, qy double, qz double")
    got = {(r.id, r.point_id, r["rank"]) for r in spatial.nearest(left, right, "id", ["point_id"], 2).collect()}
    assert got == {(1, 5, 1), (1, 6, 2), (2, None, None)}


def test_written_lines_keep_their_order(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"v {i}") for i in range(50)], "line_no long, value string").repartition(5)
    text.write_lines(lines, f"{tmp_path}/out")
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert [x for p in parts for x in p.read_text().splitlines()] == [f"v {i}" for i in range(50)]
