"""Rounds of components do not grow with the length of a path."""

import random

import pytest
from pyspark.sql import functions as F

from facetry.operators import curves


def _counted(monkeypatch):
    made = []
    monkeypatch.setattr(curves, "_written", lambda df, write=curves._written: made.append(1) or write(df))
    return made


@pytest.mark.parametrize("order", ["rising", "zigzag"])
def test_a_long_path_takes_few_writes(spark, monkeypatch, order):
    n = 400
    places = list(range(n)) if order == "rising" else [i // 2 if i % 2 == 0 else n - 1 - i // 2 for i in range(n)]
    made = _counted(monkeypatch)
    edges = spark.createDataFrame(list(zip(places, places[1:], strict=False)), "a long, b long")
    got = curves.components(spark.range(n + 1).select(F.col("id").alias("vertex_id")), edges).collect()
    assert {r.vertex_id: r.component for r in got} == {i: 0 if i < n else n for i in range(n + 1)}
    assert len(made) <= 16  # eight labels a round took 100 and more


def test_components_of_random_edges(spark):
    """Loops, repeats and edges to vertices that are not given link nothing."""
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(3, 3), (7, 99), (99, 8)]
    up = list(range(60))

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in pairs:
        if a < 60 and b < 60:
            low, high = sorted((find(a), find(b)))
            up[high] = low
    got = curves.components(spark.range(60).select(F.col("id").alias("vertex_id")), spark.createDataFrame(pairs * 2, "a long, b long")).collect()
    assert {r.vertex_id: r.component for r in got} == {i: find(i) for i in range(60)}
