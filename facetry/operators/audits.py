"""Picks of poses and points for inspection, and reports over methods, axes, frames and cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import angle, dot, unit, vec
from .curves import _written
from .refine import Judge, rings


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """rows with `rank`, from 0 by order over the whole table: one range-partitioned sort and the tasks' counts."""
    placed = _written(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_task", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = placed.groupBy("_task").agg(F.count("*").alias("n")).select("_task", before.alias("_before"))  # a row a task
    own = F.row_number().over(Window.partitionBy("_task").orderBy(order)) - 1
    return placed.withColumn("_own", own).join(F.broadcast(tasks), "_task").withColumn("rank", (F.col("_before") + F.col("_own")).cast("long")).drop("_task", "_own", "_before")


def _even(n: Column, limit: Column | int) -> Column:
    """Even places among n: 0, the last one, and those between, cut to whole numbers."""
    last = F.lit(limit) - 1 if isinstance(limit, int) else limit - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.when(last > 0, F.floor(i * (n - 1) / last)).otherwise(F.lit(0)).cast("long"))


def representative_poses(judged: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """point_index, feasible (the candidate with the most clearance, of equals the lowest; or the one that `overrides`
    names, if it is feasible) and collision (the first candidate that fails)."""
    best = F.max_by(F.when(F.col("feasible"), F.col("candidate_index")), F.when(F.col("feasible"), F.struct("clearance", -F.col("candidate_index"))))
    out = judged.groupBy("point_index").agg(best.alias("feasible"), F.min(F.when(~F.col("feasible"), F.col("candidate_index"))).alias("collision"))
    if overrides is None:
        return out
    named = judged.where("feasible").join(overrides.select("point_index", "candidate_index"), ["point_index", "candidate_index"]).select("point_index", F.col("candidate_index").alias("named"))
    return out.join(named, "point_index", "left").select("point_index", F.coalesce("named", "feasible").alias("feasible"), "collision")


def branch_representatives(judged: DataFrame) -> DataFrame:
    """branch_id, point_index, feasible, collision: of each branch the point that has poses of both kinds and is nearest to
    the branch's middle (without such a point the one nearest to it), its first feasible pose and the failing pose
    farthest from that (or its first). judged has branch_id, seq (without gaps), point_index, candidate_index, x, y, z."""
    shares = judged.groupBy("branch_id", "seq", "point_index").agg((F.bool_or("feasible") & ~F.bool_and("feasible")).alias("mixed"))
    whole = Window.partitionBy("branch_id")
    middle = F.min("seq").over(whole) + F.floor(F.count("*").over(whole) / 2)
    place = F.row_number().over(whole.orderBy(F.desc("mixed"), "off", "seq"))
    picks = shares.withColumn("off", F.abs(F.col("seq") - middle)).withColumn("_place", place).where("_place = 1").select("branch_id", "point_index")
    poses = judged.join(picks, ["branch_id", "point_index"])
    first = poses.where("feasible").groupBy("branch_id").agg(F.min_by(F.struct("candidate_index", "x", "y", "z"), "candidate_index").alias("f"))
    both = poses.where("NOT feasible").join(first, "branch_id", "left")
    far = F.coalesce(F.sqrt(sum(((F.col(a) - F.col(f"f.{a}")) * (F.col(a) - F.col(f"f.{a}")) for a in "xyz"), F.lit(0.0))), F.lit(0.0))
    hits = both.groupBy("branch_id").agg(F.max_by("candidate_index", F.struct(F.round(far, 12), -F.col("candidate_index"))).alias("collision"))
    out = picks.join(first.select("branch_id", F.col("f.candidate_index").alias("feasible")), "branch_id", "left")
    return out.join(hits, "branch_id", "left").select("branch_id", "point_index", "feasible", "collision")


def demo_points(shares: DataFrame, limit: int) -> DataFrame:
    """point_index: at most `limit` points (point_index, share of feasible poses), at even places and with the partly
    feasible one whose share is nearest to a half; for it the last of the others makes room. All, where they are fewer."""
    rows = _written(ranked(shares.select("point_index", "share"), "point_index"))
    n = rows.agg(F.count("*")).first()[0]
    if limit <= 0 or n <= limit:
        return rows.select("point_index")
    picks = rows.where(F.array_contains(_even(F.lit(n), limit), F.col("rank"))).select("point_index").collect()  # at most `limit`
    chosen = {r.point_index for r in picks}
    best = rows.where("share > 0 AND share < 1").agg(F.min_by("point_index", F.struct(F.abs(F.col("share") - 0.5), "point_index"))).first()[0]
    if best is not None and best not in chosen:
        if len(chosen) == limit:
            chosen.remove(max(chosen))
        chosen.add(best)
    return rows.where(F.col("point_index").isin(sorted(chosen))).select("point_index")


def inspection_points(tags: DataFrame, priority: Sequence[str], most: int) -> DataFrame:
    """point_index and its tags (sorted): first, for each tag in order of priority, the lowest point with it that is not
    taken yet, then others at even places, `most` in all. tags has point_index and tag."""
    if most < 1:
        raise ValueError("most >= 1 is needed")
    lowest = F.row_number().over(Window.partitionBy("tag").orderBy("point_index"))
    each = tags.select("point_index", "tag").distinct()
    heads = each.where(F.col("tag").isin(list(priority))).withColumn("n", lowest).where(F.col("n") <= len(priority)).collect()  # a few for each tag
    taken: list[int] = []
    for tag in priority:
        free = sorted(r.point_index for r in heads if r.tag == tag and r.point_index not in taken)
        taken += free[:1]
    points = each.groupBy("point_index").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    rest = _written(ranked(points.where(~F.col("point_index").isin(taken)), "point_index"))
    n = rest.agg(F.count("*")).first()[0]
    more = min(most - len(taken), n)
    first = points.where(F.col("point_index").isin(taken[:most]))
    return first if more <= 0 else first.unionByName(rest.where(F.array_contains(_even(F.lit(n), more), F.col("rank"))).drop("rank"))


def method_summary(rows: DataFrame, angles: int, branches: Sequence[int] = ()) -> DataFrame:
    """One row a method: points, feasible_total, feasible_ratio, zero_points, low_confidence, the mean of feasible poses on
    each of the named branches, and source_counts (JSON). rows: method, point_index, branch_id, feasible, confidence, source."""
    sources = rows.groupBy("method", "source").agg(F.count("*").alias("n")).groupBy("method").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n"))))).alias("source_counts"))
    means = [F.avg(F.when(F.col("branch_id") == b, F.col("feasible"))).alias(f"branch{b}_mean") for b in branches]
    sums = rows.groupBy("method").agg(F.count("*").alias("points"), F.sum("feasible").alias("feasible_total"), (F.sum("feasible") / (F.count("*") * angles)).alias("feasible_ratio"), F.count_if(F.col("feasible") == 0).alias("zero_points"), F.count_if(F.col("confidence") == "low").alias("low_confidence"), *means)
    return sums.join(sources, "method")


def method_matrix(rows: DataFrame, column: str, values: Sequence) -> DataFrame:
    """One row a method, one column a value: the feasible poses there."""
    return rows.groupBy("method").pivot(column, list(values)).agg(F.sum("feasible"))


def against_baseline(rows: DataFrame, baseline: str) -> DataFrame:
    """method, point_index, degrees: how far each method's normal n* is from the baseline's at the same point."""
    base = rows.where(F.col("method") == baseline).select("point_index", *[F.col(f"n{a}").alias(f"b{a}") for a in "xyz"])
    return rows.join(base, "point_index").select("method", "point_index", angle(vec("n"), vec("b")).alias("degrees"))


def frame_audit(rows: DataFrame) -> DataFrame:
    """One row: the largest |t . a|, the largest and median angle of the axis a* to the raw normal n* and to the patch's p*, and
    how many points are more than 2, 5 and 10 degrees from their patch."""
    off = rows.select(F.abs(dot(vec("t"), vec("a"))).alias("dot"), angle(unit(vec("n")), unit(vec("a"))).alias("turned"), angle(unit(vec("p")), unit(vec("a"))).alias("patch"))
    return off.agg(
        F.max("dot").alias("max_tangent_dot_axis"), F.max("turned").alias("max_rotation"), F.median("turned").alias("median_rotation"), F.max("patch").alias("max_patch"), F.median("patch").alias("median_patch"),
        *[F.count_if(F.col("patch") > d).alias(f"beyond_{d}") for d in (2, 5, 10)],
    )


def alignment_report(errors: DataFrame, tolerance: float) -> DataFrame:
    """errors (case_name, frame, error) with status (pass, where the frame is source_obj and the error within the tolerance,
    else fail), and how many pass and fail."""
    good = (F.col("frame") == "source_obj") & (F.col("error") <= tolerance)
    rows = errors.withColumn("status", F.when(F.coalesce(good, F.lit(False)), "pass").otherwise("fail"))
    counts = rows.agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"))
    return rows.join(F.broadcast(counts))  # one row


def axis_counts(curve: DataFrame, axes: DataFrame, angles: int, radius: float, judge: Judge) -> DataFrame:
    """point_index, axis_index, feasible: how many of a ring's poses each axis of a point gives, with zeros."""
    return judge(rings(curve, axes, angles, radius)).groupBy("point_index", "axis_index").agg(F.count_if("feasible").alias("feasible"))


def improvements(counts: DataFrame, before: int, after: int, top: int = 30) -> DataFrame:
    """The `top` points that gain most from one axis to another (of equal gains the lowest point): point_index, before,
    after, gain. A report of fixed length."""
    of = lambda k, name: F.max(F.when(F.col("axis_index") == k, F.col("feasible"))).alias(name)
    both = counts.groupBy("point_index").agg(of(before, "before"), of(after, "after")).where("before IS NOT NULL AND after IS NOT NULL")
    return both.withColumn("gain", F.col("after") - F.col("before")).orderBy(F.desc("gain"), "point_index").limit(top)


def threshold_summary(rows: DataFrame, key: str, limits: dict[str, tuple[str, float]], columns: Sequence[str]) -> DataFrame:
    """One row a key: points, for each of the columns mean, p50 and p95 over its values, and for each named limit (column,
    value) how many values are beyond it (below it, where the name ends in _low)."""
    stats = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("p50", lambda c: F.percentile(c, F.lit(0.5))), ("p95", lambda c: F.percentile(c, F.lit(0.95))))]
    beyond = [F.count_if(F.col(c) < x if name.endswith("_low") else F.col(c) > x).alias(name) for name, (c, x) in limits.items()]
    return rows.groupBy(key).agg(F.count("*").alias("points"), *stats, *beyond)


def batch(completed: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of a batch: completed cases with their columns and status completed, failed ones (case_id, error) with status
    failed; the batch's own row has no case and the counts as a note."""
    rows = completed.withColumn("status", F.lit("completed")).unionByName(failed.withColumn("status", F.lit("failed")), allowMissingColumns=True)
    counts = rows.agg(F.count_if(F.col("status") == "completed").alias("c"), F.count_if(F.col("status") == "failed").alias("f"))
    whole = counts.select(F.when(F.col("f") > 0, "completed_with_failures").otherwise("completed").alias("status"), F.concat_ws(" ", "c", F.lit("completed,"), "f", F.lit("failed")).alias("error"))
    return rows.unionByName(whole, allowMissingColumns=True)
