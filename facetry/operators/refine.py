"""Second looks: boundaries of feasible arcs halved again and again, other axes for points without a feasible pose, and the
comparison of two checks. `judge` is a check: it takes poses and returns them with feasible."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import add, cross, dot, named, scale, sub, unit, vec
from .curves import _written
from .poses import at_angles

Judge = Callable[[DataFrame], DataFrame]
TURN = 2 * math.pi


def boundaries(framed: DataFrame, states: DataFrame, angles: int, radius: float, judge: Judge, iterations: int = 12) -> DataFrame:
    """point_index, candidate_index (the arc's first angle), left, right (radians, within one turn), width, left_feasible:
    where a point's ring turns from feasible to not or back, halved `iterations` times. states has point_index,
    angle_index (0 to angles - 1) and feasible. Arcs whose ends agree are not looked into. Each round judges one pose of
    each boundary."""
    if angles < 2 or iterations < 0:
        raise ValueError("angles >= 2 and iterations >= 0 are needed")
    step = TURN / angles
    after = states.select("point_index", F.pmod(F.col("angle_index") - 1 + angles, F.lit(angles)).cast("long").alias("candidate_index"), F.col("feasible").alias("next"))
    ends = states.select("point_index", F.col("angle_index").cast("long").alias("candidate_index"), F.col("feasible").alias("left_feasible")).join(after, ["point_index", "candidate_index"])
    ends = ends.where("left_feasible <> next").drop("next")
    now = _written(ends.withColumn("left", F.col("candidate_index") * step).withColumn("right", (F.col("candidate_index") + 1) * step))
    for _ in range(iterations):
        middle = (F.col("left") + F.col("right")) / 2
        tried = now.select("point_index", "candidate_index", F.pmod(middle, F.lit(TURN)).alias("angle"))
        found = judge(at_angles(framed, tried, radius)).select("point_index", "candidate_index", F.col("feasible").alias("state"))
        both = now.join(found, ["point_index", "candidate_index"])
        same = F.col("state") == F.col("left_feasible")
        now = _written(both.select("point_index", "candidate_index", "left_feasible", F.when(same, middle).otherwise(F.col("left")).alias("left"), F.when(same, F.col("right")).otherwise(middle).alias("right")))
    turn = lambda c: F.pmod(F.col(c), F.lit(TURN)).alias(c)
    return now.select("point_index", "candidate_index", turn("left"), turn("right"), (F.col("right") - F.col("left")).alias("width"), "left_feasible")


def distinct_axes(axes: DataFrame, degrees: float = 1.0) -> DataFrame:
    """point_index, axis_index, unit axis a*: axes (point_index, axis_index, a*) in order, without those of no length and
    those within `degrees` of one kept before."""
    cosine = math.cos(math.radians(degrees))
    rows = axes.select("point_index", "axis_index", *named(unit(vec("a")), "a")).where("ax IS NOT NULL")
    listed = rows.groupBy("point_index").agg(F.array_sort(F.collect_list(F.struct("axis_index", "ax", "ay", "az"))).alias("axes"))
    near = lambda x, y: x["ax"] * y["ax"] + x["ay"] * y["ay"] + x["az"] * y["az"] >= cosine
    kept = F.aggregate("axes", F.slice("axes", 1, 0), lambda seen, x: F.when(F.exists(seen, lambda y: near(x, y)), seen).otherwise(F.concat(seen, F.array(x))))
    return listed.select("point_index", F.inline(kept))


def rings(curve: DataFrame, axes: DataFrame, angles: int, radius: float) -> DataFrame:
    """Poses around every axis of every point: axes has point_index, axis_index and unit a*; candidate_index counts on over
    the axes. Where a tangent is along the axis, a fixed direction stands for it."""
    tries = axes.join(curve.select("point_index", "x", "y", "z", "tx", "ty", "tz"), "point_index")
    flat = unit(sub(vec("t"), scale(vec("a"), dot(vec("t"), vec("a")))))
    spare = unit(cross(vec("a"), tuple(F.when(F.abs("ax") < 0.9, x).otherwise(y) for x, y in zip((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), strict=True))))
    tries = tries.withColumns({f"f{a}": F.coalesce(c, s) for a, c, s in zip("xyz", flat, spare, strict=True)})
    tries = tries.withColumns({f"q{a}": c for a, c in zip("xyz", cross(vec("a"), vec("f")), strict=True)})
    framed = tries.select("point_index", "axis_index", "x", "y", "z", *named(vec("f"), "t"), "qx", "qy", "qz", "ax", "ay", "az")
    poses = framed.select("*", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("angle_index")).withColumn("angle", F.col("angle_index") * (TURN / angles))
    e = add(scale(vec("t"), F.cos("angle")), scale(vec("q"), F.sin("angle")))
    return poses.select("point_index", "axis_index", (F.col("axis_index") * angles + F.col("angle_index")).cast("long").alias("candidate_index"), F.lit(radius).alias("rho"), *[F.col(a).alias(f"p{a}") for a in "xyz"], *named(add(vec(), scale(e, radius))), *named(e, "e"), "tx", "ty", "tz", "qx", "qy", "qz", "ax", "ay", "az")


def other_axes(curve: DataFrame, judged: DataFrame, axes: DataFrame, angles: int, radius: float, judge: Judge) -> DataFrame:
    """point_index, axis_index, axis a*, feasible (poses): for points all of whose judged poses fail, the first of their
    other axes with the most feasible poses; points that no axis helps, and points with a feasible pose, have no row.
    curve has point_index, x, y, z, t*; only points in need are judged again."""
    need = _written(judged.groupBy("point_index").agg(F.bool_or("feasible").alias("any")).where("NOT any").select("point_index"))
    made = rings(curve, distinct_axes(axes.join(need, "point_index")), angles, radius)
    counts = judge(made).groupBy("point_index", "axis_index", "ax", "ay", "az").agg(F.count_if("feasible").alias("feasible")).where("feasible > 0")
    place = F.row_number().over(Window.partitionBy("point_index").orderBy(F.desc("feasible"), "axis_index"))
    return counts.withColumn("_place", place).where("_place = 1").select("point_index", "axis_index", "ax", "ay", "az", "feasible")


def compared(exact: DataFrame, baseline: DataFrame) -> DataFrame:
    """exact, baseline (feasible by either), n and reason of the exact check: how often two checks of the same poses agree."""
    keys = ["point_index", "candidate_index"]
    both = exact.select(*keys, F.col("feasible").alias("exact"), "reason").join(baseline.select(*keys, F.col("feasible").alias("baseline")), keys)
    return both.groupBy("exact", "baseline", "reason").agg(F.count("*").alias("n"))
