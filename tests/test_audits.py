"""Picks and reports on small tables."""

import numpy as np
import pytest

from facetry.operators import audits, meshes, paths, poses


def test_ranks_and_demo_points(spark):
    rows = spark.createDataFrame([(i * 3, s) for i, s in enumerate([0.0, 1.0, 0.4, 0.6, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0])], "point_index long, share double")
    got = {r.point_index: r["rank"] for r in audits.ranked(rows.repartition(4), "point_index").collect()}
    assert got == {i * 3: i for i in range(10)}
    pick = lambda k: sorted(r.point_index for r in audits.demo_points(rows, k).collect())
    # even places 0, 3, 6 and 9 hold no partly feasible point but the one at 9: of 0.4 and 0.6 the lower comes, the last goes
    assert pick(4) == [0, 6, 9, 18] and pick(1) == [6] and pick(0) == pick(10) == [i * 3 for i in range(10)]


def test_inspection_points(spark):
    tags = [(i, "a") for i in (3, 5, 7)] + [(3, "b"), (4, "b")] + [(i, "z") for i in range(10, 20)] + [(3, "a")]
    df = spark.createDataFrame(tags, "point_index long, tag string")
    got = {r.point_index: r.tags for r in audits.inspection_points(df, ("a", "b", "c"), 5).collect()}
    assert got[3] == ["a", "b"] and got[4] == ["b"] and len(got) == 5 and set(got) - {3, 4} == {5, 13, 19}
    assert {r.point_index for r in audits.inspection_points(df, ("a", "b"), 1).collect()} == {3}
    assert len(audits.inspection_points(df, (), 100).collect()) == 14
    with pytest.raises(ValueError):
        audits.inspection_points(df, (), 0)


def test_representatives(spark):
    rows = [(0, 0, 0, 0, True, 0.1, 0.0), (0, 0, 0, 1, True, 0.3, 1.0), (0, 0, 0, 2, True, 0.3, 2.0), (0, 0, 0, 3, False, -0.1, 3.0), (0, 0, 0, 4, False, -0.1, 3.0)]
    rows += [(0, 1, 1, k, True, 0.0, float(k)) for k in range(3)] + [(1, 5, 9, k, False, -1.0, float(k)) for k in range(3)]
    df = spark.createDataFrame([(b, s, p, k, ok, c, x, 0.0, 0.0) for b, s, p, k, ok, c, x in rows], "branch_id int, seq long, point_index long, candidate_index long, feasible boolean, clearance double, x double, y double, z double")
    other = spark.createDataFrame([(0, 0), (1, 7), (9, 1)], "point_index long, candidate_index long")
    plain = {r.point_index: (r.feasible, r.collision) for r in audits.representative_poses(df).collect()}
    named = {r.point_index: (r.feasible, r.collision) for r in audits.representative_poses(df, other).collect()}
    assert plain == {0: (1, 3), 1: (0, None), 9: (None, 0)} and named == {0: (0, 3), 1: (0, None), 9: (None, 0)}
    got = {r.branch_id: (r.point_index, r.feasible, r.collision) for r in audits.branch_representatives(df).collect()}
    assert got == {0: (0, 0, 3), 1: (9, None, 0)}


def test_batch_and_thresholds(spark):
    done = spark.createDataFrame([("a", 3)], "case_id string, poses long")
    none = spark.createDataFrame([], "case_id string, error string")
    assert {(r.case_id, r.status, r.error) for r in audits.batch(done, none).collect()} == {("a", "completed", None), (None, "completed", "1 completed, 0 failed")}
    rows = spark.createDataFrame([("k", float(x)) for x in range(1, 6)] + [("k", None)], "key string, v double")
    one = audits.threshold_summary(rows, "key", {"small_low": ("v", 2.5), "large": ("v", 4.0)}, ["v"]).first()
    assert (one.points, one.v_mean, one.v_p50, one.small_low, one.large) == (6, 3.0, 3.0, 2, 1)


def test_records_in_both_frames(spark):
    frame = meshes.bbox_frame(spark.createDataFrame([(0.0, 0.0, 0.0), (4.0, 2.0, 2.0)], "x double, y double, z double"))
    cols = ", ".join(f"{k}{a} double" for k in ("", "a", "q", "e") for a in "xyz")
    node = spark.createDataFrame([(0, 1, 2, 7, 3, float(np.pi), 0.25, -0.25, 0.5, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.6, 0.8, 0.0)], f"branch_id int, lateral_side int, seq long, point_index long, candidate_index long, angle double, {cols}")
    r = paths.node_records(node, frame).first()
    assert (r.source_x, r.source_y, r.source_z) == (3.0, 0.0, 3.0) and abs(r.angle_deg - 180) < 1e-9 and abs(r.lateral_projection - 0.8) < 1e-12
    steps = paths.axis_steps(node.unionByName(node.selectExpr("branch_id", "lateral_side", "seq + 1 AS seq", "point_index", "candidate_index", "angle", "x", "y", "z", "az AS ax", "ay", "ax AS az", "qx", "qy", "qz", "ex", "ey", "ez")), ["branch_id"]).first()
    assert abs(steps.max_axis_step - 90) < 1e-9


def test_radius_override_and_explanation(spark):
    scan = spark.createDataFrame([(0.1, 1.0, 0.9), (0.2, 0.95, 0.6), (0.4, 0.2, 0.1)], "radius double, coverage double, ratio double")
    assert poses.radius_choice(scan, 0.9, 0.5).first().radius == 0.2 and poses.radius_choice(scan, 0.9, 0.5, 0.4).first().radius == 0.4
    with pytest.raises(Exception, match="was not scanned"):
        poses.radius_choice(scan, 0.9, 0.5, 0.3).collect()
    judged = spark.createDataFrame([(p, k < n) for p, n in ((1, 0), (2, 3), (3, 1), (4, 4)) for k in range(4)], "point_index long, feasible boolean")
    assert poses.explanation_point(judged).first().point_index == 2
    assert poses.explanation_point(judged.where("point_index IN (1, 4)"), partial=True).first().point_index is None
