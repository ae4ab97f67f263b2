"""Cells of the neighbour search are as deep as the rows' places need, and left rows go down in many tasks."""

import math

from pyspark.sql import functions as F

from facetry.operators import spatial


def test_cells_of_a_strip_hold_few_rows(spark, monkeypatch):
    """4,000 rows in a strip of 8 by 500 places: by their number alone they had 16 cells of 250 rows."""
    places = [(i, 0.05 * (i % 8), 0.05 * (i // 8), 0.001 * (i * 7919 % 13)) for i in range(4000)]
    right = spark.createDataFrame(places, "r long, qx double, qy double, qz double")
    left = spark.createDataFrame([(i, x + 0.01, y + 0.02, z) for i, x, y, z in places if i % 50 == 0], "k long, x double, y double, z double")
    held, cells = [], spatial._cells

    def counted(placed):
        out = cells(placed)
        held.append(out.agg(F.max("n")).first()[0])
        return out

    monkeypatch.setattr(spatial, "_cells", counted)
    got = {}
    for r in sorted(spatial.nearest(left, right, "k", ["r"], 3).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.k, []).append(r.r)
    assert max(held) <= 32
    for k, x, y, z in ((r.k, r.x, r.y, r.z) for r in left.collect()):
        assert got[k] == [i for _, i in sorted((math.dist((x, y, z), p), i) for i, *p in places)[:3]]


def test_left_rows_go_down_in_more_than_one_task(spark):
    """By bytes alone the rows of a small table are put together in one task, whatever their work."""
    right = spark.range(2000).select(F.col("id").alias("r"), *[F.rand(i).alias(f"q{a}") for i, a in enumerate("xyz")])
    left = spark.range(3000).select(F.col("id").alias("k"), *[F.rand(i + 5).alias(a) for i, a in enumerate("xyz")])
    plan = spatial.nearest(left, right, "k", ["r"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "REPARTITION_BY_NUM" in plan


def test_depths():
    assert spatial._depths(640, [2**i for i in range(1, 31)], 10) == [3, 6]
    assert spatial._depths(4096, [8**i for i in range(1, 31)], 8) == [1, 2, 3]
    assert spatial._depths(1_000_000, [1] * 30, 8)[-1] == 1
    assert spatial._depths(0, [0] * 30, 8)[-1] == 1
