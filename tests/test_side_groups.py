"""The lead of a side and the most opposite offsets are found inside a group, not by joins of all its pairs."""

import numpy as np

from facetry.operators import bisectors


def test_leading_face_is_that_of_all_pairs(spark):
    rng, rows = np.random.default_rng(3), []
    for point in range(6):
        for rank in range(1, 20):
            n = rng.normal(size=3) * [1, 1, 0.2 + point]
            n = n / np.sqrt((n * n).sum())
            rows.append((point, rank % 2, rank, float(rng.random()), *map(float, n), 0.0, 0.0, float(rank)))
    split = spark.createDataFrame(rows, "point_index long, side int, rank long, distance double, nx double, ny double, nz double, mx double, my double, mz double")
    config = bisectors.Sides(degrees=40.0)
    out = bisectors.coherent_sides(split, config, None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of rows with their lead; the pairs were one more
    cosine, want = np.cos(np.radians(40.0)), {}
    for key in {r[:2] for r in rows}:
        group = [r for r in rows if r[:2] == key]
        scored = []
        for r in group:
            near = [o[3] for o in group if abs(r[4] * o[4] + r[5] * o[5] + r[6] * o[6]) >= cosine]
            scored.append((-len(near), float(np.median(near)), r[2]))
        want[key] = -min(scored)[0]
    assert {(r.point_index, r.side): r.support for r in out.collect()} == want


def test_opposite_and_leading():
    u = np.array([[1.0, 0, 0], [0, 1, 0], [-1, 0, 0], [0, -1, 0]])
    assert bisectors._opposite(u).tolist() == [1, 0, 0, -1, 0, 0]
    rows = np.array([[1.0, 0, 0, 5], [0, 1, 0, 1], [1, 0, 0, 2], [0, 1, 0, 1]])
    assert bisectors._leading(rows, 0.9).tolist() == [2, 0, 1, 0]
    assert np.isnan(bisectors._leading(np.zeros((1, 4)), 0.9)).all()
