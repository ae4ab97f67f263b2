"""Summaries of verdicts, and picks of rows: shares, reasons by prefix, buckets, samples, nearest faces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shapes import on_triangle
from ..functions.vec import vec
from .meshes import metrics
from .spatial import nearest


def angle_bucket(angle: Column, angles: int) -> Column:
    """Which of evenly spaced angles (radians) is nearest, halves to the even one, as a number from 0."""
    return F.pmod(F.rint(angle / (2 * math.pi) * angles).cast("long"), F.lit(angles))


def shares(judged: DataFrame) -> DataFrame:
    """One row: poses, the share that is feasible, points, and the share of points with a feasible pose."""
    points = judged.groupBy("point_index").agg(F.count("*").alias("n"), F.count_if("feasible").alias("ok"))
    return points.agg(
        F.sum("n").alias("poses"), (F.sum("ok") / F.sum("n")).alias("feasible_share"), F.count("*").alias("points"), F.avg((F.col("ok") > 0).cast("double")).alias("point_share")
    )


def reasons_like(judged: DataFrame, prefixes: list[str]) -> DataFrame:
    """How many poses have a reason that begins with each prefix; one row per prefix."""
    row = judged.agg(*[F.count_if(F.col("reason").startswith(p)).alias(f"n{i}") for i, p in enumerate(prefixes)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"n{i}").alias("n")) for i, p in enumerate(prefixes)])))


def depth_summary(checked: DataFrame) -> DataFrame:
    """Least, median and greatest penetration of the poses that touch something, by point and, as
    point -1, over all."""
    deep = checked.where("penetration > 0")
    rows = deep.rollup("point_index").agg(F.count("*").alias("n"), F.min("penetration").alias("least"), F.median("penetration").alias("middle"), F.max("penetration").alias("most"))
    return rows.withColumn("point_index", F.coalesce("point_index", F.lit(-1).cast("long")))


def cases(judged: DataFrame, case: str) -> DataFrame:
    """One row per case: poses, feasible ones, points, points without a feasible pose, and whether every point has one."""
    points = judged.groupBy(case, "point_index").agg(F.count("*").alias("n"), F.count_if("feasible").alias("ok"))
    return points.groupBy(case).agg(F.sum("n").alias("poses"), F.sum("ok").alias("feasible"), F.count("*").alias("points"), F.count_if(F.col("ok") == 0).alias("without"), F.bool_and(F.col("ok") > 0).alias("complete"))


def preferred_side(status: DataFrame) -> DataFrame:
    """Each branch's side to show: +1 where its way is ok, else -1 where that is, else none with a note."""
    sides = status.groupBy("branch_id").agg(F.max(F.when(F.col("status") == "ok", F.col("lateral_side"))).alias("lateral_side"))
    return sides.withColumn("note", F.when(F.col("lateral_side").isNull(), "no side has a way").otherwise("ok"))


def sampled(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group, chosen by the md5 of seed and key, so that every run and every cluster chooses alike."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).where(F.col("place") <= n).drop("place")


def evenly(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """At most n rows of each group at even places of their order, first and last included."""
    w = Window.partitionBy(group)
    placed = rows.withColumn("place", F.row_number().over(w.orderBy(order)) - 1).withColumn("many", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("many") - 1) / max(1, n - 1)).cast("int"))
    return placed.where((F.col("many") <= n) | F.array_contains(wanted, F.col("place"))).drop("place", "many")


def nearest_faces(points: DataFrame, triangles: DataFrame, k: int, radius: float, least: int) -> DataFrame:
    """point_index, face_id, distance, rank: of the k faces with the nearest centroids those within the radius by exact
    distance, or the `least` nearest where fewer are. Distances that agree to nine digits are ties, by face_id."""
    middle = metrics(triangles).select("face_id", *[F.col(f"m{a}").alias(f"q{a}") for a in "xyz"])
    found = nearest(points.select("point_index", "x", "y", "z"), middle, "point_index", ["face_id"], k).select("point_index", "x", "y", "z", "face_id")
    exact = found.join(triangles, "face_id").withColumn("distance", on_triangle(vec(), vec("a"), vec("b"), vec("c"))["distance"])
    exact = exact.select("point_index", "face_id", "distance")
    w = Window.partitionBy("point_index")
    ranked = exact.withColumn("rank", F.row_number().over(w.orderBy(F.round("distance", 9), "face_id"))).withColumn("within", F.count_if(F.col("distance") <= radius).over(w))
    return ranked.where(F.when(F.col("within") >= least, F.col("distance") <= radius).otherwise(F.col("rank") <= least)).drop("within")
