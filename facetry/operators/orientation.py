"""Sides and signs: directions between two clouds, votes along a branch, robust mean directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import angle, dot, named, norm, scale, sub, unit, vec
from .spatial import nearest


def cloud_directions(curve: DataFrame, outer: DataFrame, inner: DataFrame, k: int = 32) -> DataFrame:
    """point_index, direction d and confidence: from the component-wise median of a point's k nearest inner points
    to that of its k nearest outer ones, laid into the plane across the tangent. The clouds have point_id, qx, qy, qz."""
    middle = []
    for cloud, name in ((outer, "o"), (inner, "i")):
        near = nearest(curve.select("point_index", "x", "y", "z"), cloud, "point_index", ["point_id"], k)
        middle.append(near.groupBy("point_index").agg(*[F.median(f"q{a}").alias(f"{name}{a}") for a in "xyz"]))
    rows = curve.select("point_index", "tx", "ty", "tz").join(middle[0], "point_index").join(middle[1], "point_index")
    raw = sub(vec("o"), vec("i"))
    rows = rows.select("point_index", *named(sub(raw, scale(vec("t"), dot(raw, vec("t")))), "r"))
    return rows.select("point_index", *[F.coalesce(c, F.lit(0.0)).alias(f"d{a}") for c, a in zip(unit(vec("r")), "xyz", strict=True)], norm(vec("r")).alias("confidence"))


def branch_votes(scored: DataFrame, threshold: float = 0.08) -> DataFrame:
    """branch_id, score, sign: the median of a branch's scores of at least the threshold in size, or of all where
    none is; a negative median turns the branch."""
    strong = F.median(F.when(F.abs("score") >= threshold, F.col("score")))
    votes = scored.groupBy("branch_id").agg(F.coalesce(strong, F.median("score")).alias("score"))
    return votes.withColumn("sign", F.when(F.col("score") >= 0, 1).otherwise(-1))


def voted_axes(axes: DataFrame, votes: DataFrame) -> DataFrame:
    """axes (branch_id, n* and more) turned by their branch's vote; branches without a vote stay as they are."""
    both = axes.join(votes.select("branch_id", "sign"), "branch_id", "left")
    sign = F.coalesce("sign", F.lit(1))
    return both.select(*[c for c in axes.columns if c not in ("nx", "ny", "nz")], *named(scale(vec("n"), sign), "n"))


def robust_directions(members: DataFrame, means: DataFrame, key: str, factor: float = 2.5, least: float = 5.0) -> DataFrame:
    """key, n, widest: the mean direction of members (key, n*) with biweights that fall to zero at `factor` median
    angles (at least `least` degrees) from the group's mean (key, m*), and the widest angle. Partial aggregates only."""
    rows = members.join(means, key).withColumn("off", angle(vec("n"), vec("m")))
    cut = rows.groupBy(key).agg(F.greatest(F.median("off") * factor, F.lit(least)).alias("cut"), F.max("off").alias("widest"))
    part = F.col("off") / F.col("cut")
    rows = rows.join(cut, key).withColumn("weight", F.when(part < 1, (1 - part * part) * (1 - part * part)).otherwise(0.0))
    sums = rows.groupBy(key).agg(
        F.sum("weight").alias("all"), F.first("widest").alias("widest"),
        *[F.sum(F.col("weight") * F.col(f"n{a}")).alias(f"w{a}") for a in "xyz"], *[F.sum(f"n{a}").alias(f"p{a}") for a in "xyz"],
    )
    held = sums.select(key, "widest", *[F.when(F.col("all") > 1e-18, F.col(f"w{a}")).otherwise(F.col(f"p{a}")).alias(f"s{a}") for a in "xyz"])
    return held.select(key, *named(unit(vec("s")), "n"), "widest")
