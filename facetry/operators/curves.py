"""Ordered points: tangents, arc length, resampling, runs, gaps, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.vec import add, distance, named, scale, sub, unit, vec


def _branch() -> WindowSpec:
    return Window.partitionBy("branch_id").orderBy("seq")


def tangents(points: DataFrame) -> DataFrame:
    """Central differences inside a branch, one-sided at its ends; (1, 0, 0) where there is no direction."""
    near = {a: (F.coalesce(F.lag(a).over(_branch()), F.col(a)), F.coalesce(F.lead(a).over(_branch()), F.col(a))) for a in "xyz"}
    t = unit(tuple(after - before for before, after in near.values()))
    t = tuple(F.coalesce(c, F.lit(x)) for c, x in zip(t, (1.0, 0.0, 0.0), strict=True))
    return points.select("*", *named(t, "t"))


def arc_lengths(points: DataFrame) -> DataFrame:
    """Running length along each branch, from 0."""
    step = F.coalesce(distance(vec(), tuple(F.lag(a).over(_branch()) for a in "xyz")), F.lit(0.0))
    return points.withColumn("step", step).select("*", F.sum("step").over(_branch().rowsBetween(Window.unboundedPreceding, 0)).alias("arc_length")).drop("step")


def allocation(points: DataFrame, total: int) -> DataFrame:
    """Points for each branch in proportion to its length, half-even and at least two; the last takes the rest."""
    lengths = arc_lengths(points).groupBy("branch_id").agg(F.max("arc_length").alias("length"))
    # one row for each branch from here on
    whole = Window.partitionBy()
    share = F.greatest(F.lit(2), F.bround(F.lit(float(total)) * F.col("length") / F.sum("length").over(whole)).cast("long"))
    out = lengths.select("branch_id", "length", share.alias("share"), (F.max("branch_id").over(whole) == F.col("branch_id")).alias("last"))
    others = F.sum(F.when(~F.col("last"), F.col("share")).otherwise(0)).over(whole)
    return out.select("branch_id", "length", F.when(F.col("last"), F.greatest(F.lit(2), total - others)).otherwise(F.col("share")).cast("long").alias("points"))


def resample(points: DataFrame, total: int) -> DataFrame:
    """Evenly spaced points along each branch, linear between the given ones. A segment emits the targets that it
    holds, so no range join is needed."""
    curve = arc_lengths(points)
    ends = curve.select("*", *[F.lead(c).over(_branch()).alias(f"next_{c}") for c in ("arc_length", "x", "y", "z")]).where("next_arc_length IS NOT NULL")
    step = F.col("length") / (F.col("points") - 1)
    plan = ends.join(F.broadcast(allocation(points, total)), "branch_id")
    first, last = F.ceil(F.col("arc_length") / step - 1e-9), F.ceil(F.col("next_arc_length") / step - 1e-9) - 1
    last = F.when(F.col("next_arc_length") >= F.col("length"), F.col("points") - 1).otherwise(last)
    held = plan.withColumn("first", F.greatest(first, F.lit(0)).cast("long")).withColumn("last", last.cast("long")).where("last >= first")
    made = held.select("*", F.explode(F.sequence("first", "last")).alias("target")).withColumn("s", F.col("target") * step)
    width = F.col("next_arc_length") - F.col("arc_length")
    part = F.when(width > 0, (F.col("s") - F.col("arc_length")) / width).otherwise(0.0)
    return made.select("branch_id", "target", *named(add(vec(), scale(sub(vec("next_"), vec()), part))))


def runs(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Stretches of one value in order: run number, value, start, end (exclusive), by gaps and islands."""
    w = Window.partitionBy(group).orderBy(order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    run = F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("change", change).withColumn("run", run).groupBy(group, "run", value).agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"))


def gaps(points: DataFrame, factor: float = 8.0, least: float = 1e-8) -> DataFrame:
    """Within a branch a new part begins where a step is longer than `factor` medians of the positive steps."""
    step = distance(vec(), tuple(F.lag(a).over(_branch()) for a in "xyz"))
    rows = points.withColumn("step", step)
    limit = F.greatest(F.lit(factor) * F.median(F.when(F.col("step") > 0, F.col("step"))).over(Window.partitionBy("branch_id")), F.lit(least))
    new = rows.withColumn("new", F.when(F.col("step") > limit, 1).otherwise(0))
    return new.select("point_index", "branch_id", "seq", F.sum("new").over(_branch().rowsBetween(Window.unboundedPreceding, 0)).alias("part"))


def _written(df: DataFrame) -> DataFrame:
    """df written to the session's shared folder, which cuts its lineage. Only a local session may leave it unset."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="facetry-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/facetry/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertex_id, component: the least vertex reachable. In a round every label hooks to the least label around it. Hooks
    only fall, so they are trees, and are followed to their roots by doubling; edges go on between roots. Within two rounds
    every label that has an edge hooks or is hooked to, so labels halve; a path of n vertices takes log n / 3 writes."""
    there = lambda c: vertices.select(F.col("vertex_id").alias(c))
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = _written(links.join(there("a"), "a", "left_semi").join(there("b"), "b", "left_semi").select("a", "b"))
    now = vertices.select("vertex_id", F.col("vertex_id").alias("component"))
    while links.limit(1).count():
        around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = _written(around.groupBy(F.col("a").alias("component")).agg(F.least(F.min("b"), "a").alias("to")))
        falling = True
        while falling:
            after = hooks.withColumn("was", F.col("to"))
            for _ in range(3):
                onward = after.select(F.col("component").alias("to"), F.col("to").alias("then"))
                after = after.join(onward, "to").select("component", "was", F.col("then").alias("to"))
            after = _written(after)
            falling = after.where("to < was").limit(1).count() > 0
            hooks = after.select("component", "to")
        side = lambda c: hooks.select(F.col("component").alias(c), F.col("to").alias(f"{c}_to"))
        drawn = links.join(side("a"), "a").join(side("b"), "b").where("a_to <> b_to")
        links = _written(drawn.select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).distinct())
        now = _written(now.join(hooks, "component", "left").select("vertex_id", F.coalesce("to", "component").alias("component")))
    return now


def ordered(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertex_id, component, seq: the vertices of each component along its path, from the lesser end, or from the least
    vertex towards its lesser neighbour where the path is closed. Repeated edges and loops count once and not at all;
    vertices without edges are paths of one; a vertex of more than two neighbours is an error.

    The steps along all paths, in both directions, are a list that is ranked by pointer doubling: log n joins."""
    both = edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
    arcs = _written(both.distinct())
    around = _written(arcs.groupBy("u").agg(F.count("*").alias("degree"), F.min("v").alias("low"), F.sum("v").alias("sum")))
    fork = around.where("degree > 2").agg(F.min("u")).first()[0]
    if fork is not None:
        raise ValueError(f"vertex {fork} has more than two neighbours; a path may not branch")
    parts = components(vertices, edges).join(around.select(F.col("u").alias("vertex_id"), "degree", "low"), "vertex_id", "left")
    end = F.when(F.col("degree") == 1, F.col("vertex_id"))
    parts = parts.withColumn("start", F.coalesce(F.min(end).over(Window.partitionBy("component")), F.col("component")))
    parts = _written(parts)
    heads = parts.where("vertex_id = start")
    # a step follows the one that arrives where it leaves, but for those that leave an end or the start of a closed path
    cut = heads.where("degree = 2").select(F.col("vertex_id").alias("u"), F.lit(True).alias("cut"))
    steps = arcs.join(around, "u").join(cut, "u", "left").withColumn("before", F.when((F.col("degree") == 2) & F.col("cut").isNull(), F.col("sum") - F.col("v")))
    now = _written(steps.select("u", "v", F.coalesce("before", "u").alias("ju"), F.when(F.col("before").isNotNull(), F.col("u")).otherwise(F.col("v")).alias("jv"), F.when(F.col("before").isNotNull(), 1).otherwise(0).cast("long").alias("far")))
    while True:
        after = now
        for _ in range(3):
            jump = after.select(F.col("u").alias("ju"), F.col("v").alias("jv"), F.col("ju").alias("ku"), F.col("jv").alias("kv"), F.col("far").alias("more"))
            after = after.join(jump, ["ju", "jv"]).select("u", "v", F.col("ku").alias("ju"), F.col("kv").alias("jv"), (F.col("far") + F.col("more")).alias("far"))
        after = _written(after)
        moved = after.agg(F.sum("far")).first()[0] != now.agg(F.sum("far")).first()[0]
        now = after
        if not moved:
            break
    first = heads.where("low IS NOT NULL").select("component", F.col("start").alias("ju"), F.col("low").alias("jv"))
    along = now.join(first, ["ju", "jv"]).where("v <> ju").select(F.col("v").alias("vertex_id"), "component", (F.col("far") + 1).alias("seq"))
    return heads.select("vertex_id", "component", F.lit(0).cast("long").alias("seq")).unionByName(along)


def split_and_resample(vertices: DataFrame, edges: DataFrame, total: int = 0) -> DataFrame:
    """The branches of a line drawing as curves: branch_id (the component's least vertex), seq, x, y, z, tangent t* and
    arc_length. total > 0 spreads so many points over the branches by length, else every vertex is kept."""
    placed = ordered(vertices, edges).join(vertices, "vertex_id").select(F.col("component").alias("branch_id"), "seq", "x", "y", "z")
    if total > 0:
        placed = resample(_written(placed), total).withColumnRenamed("target", "seq")
    return arc_lengths(tangents(placed))
