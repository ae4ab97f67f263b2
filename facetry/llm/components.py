"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(edges: DataFrame, hub: str, leaf: str, keep_hub: bool) -> DataFrame:
    """Each hub's leaves are tied to the least node around it."""
    at = edges.select(F.col(hub).alias("h"), F.col(leaf).alias("x"))
    least = at.groupBy("h").agg(F.least(F.min("x"), F.col("h")).alias("m"))
    tied = at.join(least, "h").where("x > m" if keep_hub else "x > h").select(F.col("x").alias("u"), F.col("m").alias("v"))
    if keep_hub:
        tied = tied.unionByName(least.where("h > m").select(F.col("h").alias("u"), F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: long columns u, v. Returns node, root for every node with an edge; root is the least node reachable.

    Both stars keep the components and only lower the far ends, so the rounds end at one star per component; each
    round is written to the shared folder."""
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    before = now.select(mark.alias("m")).first()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "u", "v", keep_hub=False)
        now = staged(_star(large, "u", "v", keep_hub=True))
        after = now.select(mark.alias("m")).first()
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
