"""Hits stream out of blocks of poses, and what is asked of them by pose or in all is reduced there."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import wheel
from facetry.operators import blocks, collision
from facetry.plans import checks, summaries

from .test_pose_blocks import R, W, _rows, cut, tables  # noqa: F401  fixtures

DATA = "/root/testdata/sf0.001"


def _digits(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _fixed(df):
    """Are blocks dealt out to a fixed number of parts, which adaptive execution does not put together by their few bytes?"""
    return "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.usefixtures("cut")
def test_cylinder_hits_agree_with_their_pairs(tables):  # noqa: F811
    poses, faces = tables
    pairs = collision.cylinder_contacts(collision.cylinder_pairs(poses.drop("rho"), faces, R, W), R, W).where("hit")
    got = collision.cylinder_hits(poses, faces, R, W)
    assert _rows(_digits(got)) == _rows(_digits(pairs.select(*got.columns))) and got.count() > 50


def test_cylinder_contact_is_dealt_out_by_blocks(spark):
    assert _fixed(checks.cylinder_contact(spark, DATA))


def test_a_block_need_not_hold_all_triangles(spark, tables):  # noqa: F811
    """Batches of a few rows give the same hits."""
    poses, faces = tables
    want = _rows(collision.cylinder_hits(poses, faces, R, W, 6))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert _rows(collision.cylinder_hits(poses, faces, R, W, 6)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.usefixtures("cut")
def test_disk_hits_agree_with_their_pairs(tables):  # noqa: F811
    poses, faces = tables
    pairs = collision.disk_contacts(collision.disk_pairs(poses, faces, R)).where("hit")
    got = collision.disk_hits(poses, faces)
    assert _rows(got) == _rows(pairs.select(*got.columns)) and got.count() > 20


def test_disk_pairs_is_dealt_out_by_blocks(spark):
    assert _fixed(checks.disk_pairs(spark, DATA))


@pytest.mark.usefixtures("cut")
def test_failed_counts_agree_with_the_hits(tables):  # noqa: F811
    poses, faces = tables
    met = collision.cylinder_contacts(collision.cylinder_pairs(poses.drop("rho"), faces, R, W), R, W)
    want = collision.failed_conditions(met, 0.02, 0.2, 60.0).select(F.explode("failed").alias("failed")).groupBy("failed").agg(F.count("*").alias("n"))
    assert _rows(collision.failed_counts(poses, faces, R, W, 0.02, 0.2, 60.0)) == _rows(want) and want.count() == 4


def test_settled_poses_weigh_only_what_may_pass(spark, monkeypatch):
    """A pose that is rejected and as deep as can be does not look at faces along its axis again; the verdict is the same."""
    rng = np.random.default_rng(8)
    poses = spark.createDataFrame([(0, 0, R, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, -W / 2)], "point_index long, candidate_index long, rho double, " + ", ".join(f"{k}{a} double" for k in ("", "a", "p") for a in "xyz"))
    upright = [[(x, -0.05, -0.1), (x, 0.05, 0.1), (x, 0.05, -0.1)] for x in rng.uniform(-0.02, 0.02, 1500)]
    flat = [[(x, 0.0, -W / 2), (x + 0.02, 0.0, -W / 2), (x, 0.02, -W / 2)] for x in (0.1, -0.1)]
    faces = spark.createDataFrame([(i, *map(float, np.ravel(t))) for i, t in enumerate([*upright, *flat])], "face_id long, " + ", ".join(f"{k}{a} double" for k in "abc" for a in "xyz"))
    want = collision.cylinder_contacts(collision.cylinder_pairs(poses.drop("rho"), faces, R, W), R, W).where("hit")
    passing = (F.col("penetration") <= 1e-6) & (F.col("alignment") >= 0.5) & F.coalesce("near_cap", F.lit(True))
    row = collision.check_cylinders(poses, faces, R, W, False, contact_patch=True, max_penetration=1e-6, normal_degrees=60.0).first()
    assert (row.contact_faces, row.faces) == (want.where(passing).count(), 1502) and row.contact_faces == 2
    assert row.penetration == pytest.approx(want.agg(F.max("penetration")).first()[0]) and row.reason == want.where("face_id = 0").first().kind
    tools, seen = wheel.Tools, []
    held = tools(*(np.zeros((1, 3)), np.array([[0.0, 0.0, 1.0]]), np.zeros((1, 3))), np.array([np.array(t) for t in upright[:2]]))
    monkeypatch.setattr(collision, "reduced", lambda *a, **k: seen.append(a[6]) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        collision.check_cylinders(poses, faces, R, W, False, contact_patch=True, max_penetration=1e-6, normal_degrees=60.0)
    see, _, columns = seen[0]({"side": np.array([R])}, {"face_id": np.array([0, 1])}, held)
    weighed = []
    monkeypatch.setattr(collision, "Cuts", lambda c, *a: weighed.append(c.shape[2]) or wheel.Cuts(c, *a))
    for j in (0, 1):
        see(np.array([0]), np.array([j]))
    assert weighed == [1, 0] and columns()["penetration"][0] == pytest.approx(W)


@pytest.mark.usefixtures("cut")
def test_boxes_are_counted_without_a_row_a_pair(tables):  # noqa: F811
    poses, faces = tables
    want = collision.cylinder_pairs(poses.drop("rho"), faces, R, W).groupBy(*collision.KEYS).agg(F.count("*").alias("faces"))
    assert _rows(collision.pose_boxes(poses, faces, R, W)) == _rows(want) and want.count() > 50


def test_cylinder_pairs_is_dealt_out_by_blocks(spark):
    assert _fixed(checks.cylinder_pairs(spark, DATA))


@pytest.mark.usefixtures("cut")
def test_penetrations_agree_with_the_hits(tables):  # noqa: F811
    poses, faces = tables
    met = collision.cylinder_contacts(collision.cylinder_pairs(poses.drop("rho"), faces, R, W), R, W)
    want = met.groupBy(*collision.KEYS).agg(F.max("penetration").alias("penetration"))
    assert _rows(_digits(collision.pose_penetrations(poses, faces, R, W))) == _rows(_digits(want))


def test_depth_summary_settles_poses(spark, monkeypatch):
    """It asks for the depth alone, of poses that are settled by the deepest reach."""
    asked = []
    monkeypatch.setattr(collision, "pose_penetrations", lambda *a, **k: asked.append(a) or checks._lean(spark, DATA).withColumn("penetration", F.lit(0.1)))
    assert summaries.depth_summary(spark, DATA).count() and asked


@pytest.mark.parametrize("count", [True, False])
def test_settled_poses_meet_the_rest_of_their_boxes_only_to_count_them(monkeypatch, count):
    monkeypatch.setattr(blocks, "FIRST", 2)
    monkeypatch.setattr(blocks, "LATER", 3)
    zero, one = np.zeros((1, 3)), np.ones((1, 3))
    corners = np.random.default_rng(1).uniform(-0.5, 0.5, (10, 3, 3))
    p = {"center": zero, "axis": np.array([[0.0, 0.0, 1.0]]), "target": zero, "lo": -one, "hi": one, "side": np.ones(1)}
    counts, settled = np.zeros(1, np.int64), np.zeros(1, bool)
    for i, _ in blocks._pairs(p, blocks._faced(corners, np.arange(10)), 1.0, counts, settled, count):
        settled[i] = True
    assert counts[0] == (10 if count else 2)
