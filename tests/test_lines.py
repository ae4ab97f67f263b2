"""Path order, continuity, co-optimal ways, arc boundaries, spare axes, frames and sampled cylinders against plain loops."""

import math
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import continuity, curves, meshes, paths, poses, refine
from facetry.operators.spatial import nearest, overlapping

FRAME = "point_index long, x double, y double, z double, " + ", ".join(f"{k}{a} double" for k in "tqa" for a in "xyz")


def _order(spark, n, edges):
    v = spark.createDataFrame([(i,) for i in range(n)], "vertex_id long")
    e = spark.createDataFrame(edges, "a long, b long")
    out = defaultdict(list)
    for r in sorted(curves.ordered(v, e).collect(), key=lambda r: r.seq):
        assert r.seq == len(out[r.component])
        out[r.component].append(r.vertex_id)
    return dict(out)


def test_path_order(spark):
    # an open path, a closed one, a single vertex, a pair; a repeated edge and a loop count for nothing
    edges = [(7, 2), (2, 9), (9, 0), (0, 9), (1, 4), (4, 8), (8, 3), (3, 1), (5, 10), (6, 6)]
    assert _order(spark, 11, edges) == {0: [0, 9, 2, 7], 1: [1, 3, 8, 4], 5: [5, 10], 6: [6]}
    with pytest.raises(ValueError, match="vertex 2 has more than two neighbours"):
        _order(spark, 5, [(2, 0), (2, 1), (2, 3)])
    long = list(np.random.default_rng(2).permutation(300))
    want = long if long[0] < long[-1] else long[::-1]
    assert _order(spark, 300, [(int(a), int(b)) for a, b in zip(long, long[1:])]) == {0: [int(x) for x in want]}


def test_split_and_resample(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 3.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 5.0, 0.0), (4, 0.0, 6.0, 0.0)], "vertex_id long, x double, y double, z double")
    e = spark.createDataFrame([(0, 2), (2, 1), (3, 4)], "a long, b long")
    got = sorted((r.branch_id, r.seq, r.x, r.y, round(r.arc_length, 9)) for r in curves.split_and_resample(v, e).collect())
    assert got == [(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 1.0), (0, 2, 3.0, 0.0, 3.0), (3, 0, 0.0, 5.0, 0.0), (3, 1, 0.0, 6.0, 1.0)]
    more = curves.split_and_resample(v, e, 8).groupBy("branch_id").agg(F.count("*").alias("n"), F.max("arc_length").alias("s")).collect()
    assert {(r.branch_id, r.n, round(r.s, 9)) for r in more} == {(0, 6, 3.0), (3, 2, 1.0)}


def _plain_repair(n, t, p, degrees=30, agreement=20, passes=3):
    n, fixed = n.copy(), np.zeros(len(n), bool)
    turn = lambda a, b: math.degrees(math.acos(max(-1, min(1, float(a @ b)))))
    for _ in range(passes):
        for i in range(len(n)):
            around = [n[j] for j in (i - 1, i + 1) if 0 <= j < len(n)]
            if not around or max(turn(n[i], x) for x in around) <= degrees or (len(around) == 2 and turn(*around) > agreement):
                continue
            m = sum(around) / len(around)
            m = m - (m @ t[i]) * t[i]
            if np.linalg.norm(m) > 1e-12:
                m = m / np.linalg.norm(m)
                if m @ p[i] + 1e-6 >= n[i] @ p[i]:
                    n[i], fixed[i] = m, True
    return n, fixed


@pytest.mark.parametrize("block", [2, 64])
def test_continuity(spark, block):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for branch, size in enumerate((1, 2, 5, 70)):
        n = np.array([0, 0, 1.0]) + 0.15 * rng.normal(size=(size, 3))
        n[rng.random(size) < 0.25] += 2 * rng.normal(size=3)
        if size > 10:  # a run of wrong normals, which is mended from block to block
            n[20:31] = [1.0, 0.2, 0.1]
        n, p = (x / np.linalg.norm(x, axis=1)[:, None] for x in (n, np.array([0, 0, 1.0]) + 0.05 * rng.normal(size=(size, 3))))
        t = np.array([[1.0, 0, 0]] * size)
        t = t - (t * n).sum(1)[:, None] * n
        t /= np.linalg.norm(t, axis=1)[:, None]
        want[branch] = _plain_repair(n, t, p)
        rows += [(branch, i + 3, *map(float, (*n[i], *t[i], *p[i]))) for i in range(size)]
    df = spark.createDataFrame(rows, "branch_id int, seq long, " + ", ".join(f"{k}{a} double" for k in "ntp" for a in "xyz"))
    got = continuity.repaired(df.repartition(3), block=block).collect()
    assert len(got) == len(rows) and any(r.repaired for r in got)
    for r in got:
        n, fixed = want[r.branch_id]
        assert np.allclose([r.nx, r.ny, r.nz], n[r.seq - 3], atol=1e-12) and r.repaired == fixed[r.seq - 3]


NODES = "branch_id int, lateral_side int, seq long, candidate_index long, x double, y double, z double"


@pytest.mark.parametrize("block", [2, 64])
def test_co_optimal(spark, monkeypatch, block):
    monkeypatch.setattr(paths, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for branch in range(6):
        layers = [rng.integers(0, 3, size=(3, 3)).astype(float) if branch % 2 else rng.normal(size=(3, 3)) for _ in range(5)]
        lengths = [sum(math.dist(a[i], b[j]) for a, b, i, j in zip(layers, layers[1:], way, way[1:])) for way in product(range(3), repeat=5)]
        want[branch] = min(lengths), min(2, sum(x <= min(lengths) + 1e-9 * max(1, min(lengths)) for x in lengths))
        rows += [(branch, 1, s, i, *map(float, p)) for s, layer in enumerate(layers) for i, p in enumerate(layer)]
    got = {r.branch_id: (r.cost, r.ways) for r in paths.co_optimal(spark.createDataFrame(rows, NODES)).collect()}
    assert {w for _, w in want.values()} == {1, 2}
    assert all(abs(got[b][0] - c) < 1e-9 and got[b][1] == w for b, (c, w) in want.items())


def _triangles(spark, tris):
    cols = ", ".join(f"{k}{a} double" for k in "abc" for a in "xyz")
    return spark.createDataFrame([(i, *[float(x) for p in t for x in p]) for i, t in enumerate(tris)], f"face_id long, {cols}")


def test_boundaries(spark):
    """Widths halve each round; the turns are those of 4,096 angles."""
    framed = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), (1, 5.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], FRAME)
    posts = np.array([(1.0, 0.7), (-0.4, 1.1)])  # a pose fails within 0.45 of a post
    near = lambda x, y: F.least(*[F.hypot(F.col(x) - px, F.col(y) - py) for px, py in posts.tolist()])
    judge = lambda made: made.withColumn("feasible", near("x", "y") >= 0.45)
    states = judge(poses.candidates(framed, 1.0, 24)).select("point_index", F.col("candidate_index").alias("angle_index"), "feasible")
    for rounds in (0, 5, 9):
        got = refine.boundaries(framed, states, 24, 1.0, judge, rounds).collect()
        assert {r.point_index for r in got} == {0} and all(abs(r.width - 2 * math.pi / 24 / 2**rounds) < 1e-9 for r in got)
    ring = [min(math.hypot(math.cos(a) - x, math.sin(a) - y) for x, y in posts) >= 0.45 for a in np.arange(4096) * 2 * math.pi / 4096]
    turns = [(i + 0.5) * 2 * math.pi / 4096 for i in range(4096) if ring[i] != ring[(i + 1) % 4096]]
    assert len(turns) == len(got) and all(min(abs(r.left - t) for t in turns) < 2 * math.pi / 2048 for r in got)


def test_other_axes(spark):
    """Only points without a pose get an axis, the first of the best; equal axes count once."""
    curve = spark.createDataFrame([(i, float(i), 0.0, 0.0, 1.0, 0.0, 0.0) for i in range(3)], "point_index long, x double, y double, z double, tx double, ty double, tz double")
    judged = spark.createDataFrame([(0, True), (0, False), (1, False), (2, False)], "point_index long, feasible boolean")
    lists = [(0.0, 0.0, 2.0), (0.0, 0.01, 1.0), (0.0, 1.0, 0.0), (0.0, 0.0, 0.0), (0.0, 1.0, 1.0)]
    axes = spark.createDataFrame([(p, i, *a) for p in range(3) for i, a in enumerate(lists)], "point_index long, axis_index int, ax double, ay double, az double")
    kept = refine.distinct_axes(axes.where("point_index = 1")).collect()
    assert sorted(r.axis_index for r in kept) == [0, 2, 4]
    judge = lambda made: made.withColumn("feasible", (F.col("point_index") == 1) & (F.col("z") > 0.1) & (F.col("ay") > 0.5))
    got = refine.other_axes(curve, judged, axes, 12, 0.5, judge).collect()
    # around y the ring stands up to z = 0.5; the slanted axis gives less, z none
    assert [(r.point_index, r.axis_index) for r in got] == [(1, 2)] and got[0].feasible == 5


def test_frames_with_spares(spark):
    curve = spark.createDataFrame([(0, 0, 0, 1.0, 0.0, 0.2), (1, 0, 1, 0.0, 0.0, 1.0), (2, 0, 2, 0.0, 1.0, 0.0), (3, 1, 0, 0.0, 0.0, -1.0), (4, 1, 1, 0.0, 1.0, 1.0), (5, 2, 0, 0.0, 0.0, 1.0)], "point_index long, branch_id int, seq long, tx double, ty double, tz double")
    n = spark.createDataFrame([(i, 0.0, 0.0, 3.0) for i in range(6)], "point_index long, nx double, ny double, nz double")
    rows = {r.point_index: r for r in poses.frames_with_spares(curve.withColumns({a: F.lit(0.0) for a in "xyz"}), n).collect()}
    assert [tuple(round(v, 9) for v in (rows[i].tx, rows[i].ty, rows[i].tz)) for i in range(5)] == [(1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 1, 0), (0, 1, 0)]
    assert all(abs(r.tx * r.ax + r.ty * r.ay + r.tz * r.az) < 1e-12 and r.az == 1 and abs(r.tx**2 + r.ty**2 + r.tz**2 - 1) < 1e-12 for r in rows.values())
    with pytest.raises(Exception, match="no length"):
        poses.frames_with_spares(curve.withColumns({a: F.lit(0.0) for a in "xyz"}), n.withColumn("nz", F.lit(0.0))).collect()


def test_sampled_cylinder_regions(spark):
    """A sample at each side of a cylinder of radius 1 and width 0.4 at the origin, one case a pose."""
    spots = {"wheel_outer_collision": (0.95, 0.0, 0.0), "wheel_side_collision": (0.2, 0.0, 0.19), "wheel_corner_collision": (1.0004, 0.0, 0.2004), "safe": (3.0, 0.0, 0.0)}
    names = list(spots)
    made = [(i, 0, 1.0, *(10.0 * i, 0.0, 0.0), 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0) for i in range(len(names) + 1)]
    df = spark.createDataFrame(made, "point_index long, candidate_index long, rho double, x double, y double, z double, " + ", ".join(f"{k}{a} double" for k in "eta" for a in "xyz"))
    samples = [(i, 10.0 * i + p[0], p[1], p[2], -1.0, 0.0, 0.0) for i, p in enumerate(spots.values())]
    samples.append((9, 10.0 * len(names) + 1.2, 0.0, 0.0, 1.0, 0.0, 0.0))  # its outside is away from the centre
    s = spark.createDataFrame(samples, "sample_id long, x double, y double, z double, nx double, ny double, nz double")
    got = {r.point_index: r for r in poses.sampled_cylinders(df, s, 0.4, 0.001, 1).collect()}
    assert [got[i].reason for i in range(len(names))] == names
    assert got[len(names)].reason == "workpiece_interior_collision" and abs(got[0].clearance + 0.05) < 1e-12 and abs(got[3].clearance - 2) < 1e-12
    with pytest.raises(ValueError):
        poses.sampled_cylinders(df, s, 0.0)


def test_nearest_beside_a_far_row_and_crowds(spark):
    """A crowd in one place, a far row and a plain cloud: the k nearest are those of a full table of distances."""
    rng = np.random.default_rng(7)
    cloud = np.concatenate([rng.normal(size=(2500, 3)), np.tile([[0.3, 0.3, 0.3]], (2500, 1))])
    left = np.concatenate([rng.normal(size=(40, 3)), [[900.0, -40.0, 5.0], [0.3, 0.3, 0.3]]])
    lf = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(left)], "id long, x double, y double, z double")
    rf = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cloud)], "r long, qx double, qy double, qz double")
    got = defaultdict(list)
    for r in sorted(nearest(lf, rf, "id", ["r"], 5).collect(), key=lambda r: r["rank"]):
        got[r.id].append(r.r)
    for i, p in enumerate(left):
        d = np.sqrt(((cloud - p) ** 2).sum(1))
        assert got[i] == np.lexsort((np.arange(len(d)), d))[:5].tolist()


def test_overlapping_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(9)
    def boxes(n):
        size = 10.0 ** rng.uniform(-4, 1, size=(n, 1)) * rng.uniform(0.2, 1, size=(n, 3))
        size[:3] = 0.0
        low = rng.uniform(-5, 5, size=(n, 3))
        return low, low + size
    (a, b), (c, d) = boxes(80), boxes(90)
    c[:3] = d[:3] = a[:3]  # points on points
    names = lambda p: ", ".join(f"{p}{e}{x} double" for e in ("lo", "hi") for x in "xyz")
    q = spark.createDataFrame([(i, *map(float, (*lo, *hi))) for i, (lo, hi) in enumerate(zip(a, b))], f"i long, {names('')}")
    o = spark.createDataFrame([(i, *map(float, (*lo, *hi))) for i, (lo, hi) in enumerate(zip(c, d))], f"j long, {names('q')}")
    got = sorted((r.i, r.j) for r in overlapping(q, o).collect())
    assert got == sorted((i, j) for i in range(80) for j in range(90) if (a[i] <= d[j]).all() and (c[j] <= b[i]).all())
    assert overlapping(q, o.where("false")).count() == 0


def test_bbox_frame(spark):
    one = spark.createDataFrame([(0.0, 0.0, 0.0), (4.0, 1.0, 0.0)], "x double, y double, z double")
    two = spark.createDataFrame([(2.0, 9.0, 1.0)], one.schema)
    frame = meshes.bbox_frame(one, two)
    assert tuple(frame.first()) == (9.0, 2.0, 4.5, 0.5)
    back = meshes.in_frame(meshes.in_frame(one, frame), frame, back=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, one.collect()))
    assert tuple(meshes.bbox_frame(one, mode="none").first()) == (1.0, 0.0, 0.0, 0.0)
