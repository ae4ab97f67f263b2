"""Repair of normals along branches: a recurrence in place, worked off by blocks that hand their last normal on.

A point whose normal jumps from a neighbour's is set to the projected mean of its neighbours, if these agree and the mean
fits the point's patch no worse; points are visited in order and see what was set before them. In one pass a block depends
on the block before it by one normal alone. So all blocks run at once, taking for it what stood there before the pass, and
only those run again whose guess was wrong, until none was; a change seldom reaches the next block's end."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import cross, dot, named, scale, sub, unit, vec
from .curves import _written

BLOCK = 1024


def corrected_tangents(rows: DataFrame) -> DataFrame:
    """rows with t* laid into the plane across the normal n*; an axis where the tangent is parallel to it."""
    plain = unit(vec("t"))
    start = tuple(F.coalesce(c, F.lit(x)) for c, x in zip(plain, (1.0, 0.0, 0.0), strict=True))
    laid = lambda v: unit(sub(v, scale(vec("n"), dot(v, vec("n")))))
    axis = laid((F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    across = unit(cross(vec("n"), (F.lit(0.0), F.lit(1.0), F.lit(0.0))))
    made = tuple(F.coalesce(a, b, c) for a, b, c in zip(laid(start), axis, across, strict=True))
    return rows.withColumns({f"t{a}": c for a, c in zip("xyz", made, strict=True)})


def _run(n: np.ndarray, t: np.ndarray, p: np.ndarray, left: np.ndarray | None, right: np.ndarray | None, jump: float, agree: float) -> tuple[np.ndarray, np.ndarray]:
    """One pass over a block between the normals left and right (None at a branch's ends): new normals, and the angles of
    the repaired points."""
    n, angles = n.copy(), np.full(len(n), np.nan)
    turn = lambda a, b: math.acos(max(-1.0, min(1.0, float(a @ b))))
    for i in range(len(n)):
        around = [x for x in (n[i - 1] if i else left, n[i + 1] if i + 1 < len(n) else right) if x is not None]
        if not around:
            continue
        most = max(turn(n[i], x) for x in around)
        if most <= jump or (len(around) == 2 and turn(*around) > agree):
            continue
        mean = sum(around) / len(around)
        mean = mean - (mean @ t[i]) * t[i]
        size = math.sqrt(mean @ mean)
        if size <= 1e-12 or mean @ p[i] / size + 1e-6 < n[i] @ p[i]:
            continue
        n[i], angles[i] = mean / size, most
    return n, angles


def repaired(rows: DataFrame, degrees: float = 30.0, agreement: float = 20.0, passes: int = 3, block: int = BLOCK) -> DataFrame:
    """branch_id, seq, n* (repaired), repaired and angle (degrees of the jump, of the last repair). rows have branch_id,
    seq (whole numbers), the unit normals n*, tangents t* and patch normals p*. A branch of one point stays."""
    jump, agree = math.radians(degrees), math.radians(agreement)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("branch_id", F.floor(F.col("seq") / block)).orderBy("seq")))
    held = F.sort_array(F.collect_list(F.struct("seq", *[F.array(*[F.col(f"{k}{a}").cast("double") for a in "xyz"]).alias(k) for k in "ntp"])))
    blocks = placed.groupBy("branch_id", F.floor(F.col("seq") / block).alias("block")).agg(held.alias("h"))
    state = _written(blocks.select("branch_id", "block", F.col("h.seq").alias("seq"), *[F.flatten(F.col(f"h.{k}")).alias(k) for k in "ntp"], F.transform("h", lambda _: F.lit(None).cast("double")).alias("angle")))
    form = state.schema
    order = Window.partitionBy("branch_id").orderBy("block")
    last, first = F.slice("n", -3, 3), F.slice("n", 1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, seen = [], []
            for n, t, p, angle, left, right in zip(*(b.column(c).to_pylist() for c in ("n", "t", "p", "angle", "left", "right")), strict=True):
                sides = [None if x is None else np.array(x) for x in (left, right)]
                new, turned = _run(*(np.array(x).reshape(-1, 3) for x in (n, t, p)), *sides, jump, agree)
                out.append(new.ravel().tolist())
                seen.append([a if math.isnan(x) else math.degrees(x) for a, x in zip(angle, turned.tolist(), strict=True)])
            new = {"n": pa.array(out, pa.list_(pa.float64())), "angle": pa.array(seen, pa.list_(pa.float64()))}
            names = [*form.names, "left"]
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names)

    for _ in range(passes):
        before = state.withColumn("right", F.lead(first).over(order))
        tried = before.withColumn("left", F.lag(last).over(order))
        done = _written(tried.mapInArrow(run, tried.drop("right").schema))
        while True:
            found = done.withColumn("real", F.lag(last).over(order))
            wrong = _written(found.where(~F.col("real").eqNullSafe(F.col("left"))).select("branch_id", "block", F.col("real").alias("left")))
            if not wrong.limit(1).count():
                break
            again = before.join(wrong, ["branch_id", "block"]).select(*tried.columns)
            rest = done.join(wrong.select("branch_id", "block"), ["branch_id", "block"], "left_anti")
            done = _written(rest.unionByName(again.mapInArrow(run, tried.drop("right").schema)))
        state = done.drop("left")
    flat = state.select("branch_id", F.posexplode("seq").alias("i", "seq"), "n", "angle")
    value = [F.element_at("n", F.col("i") * 3 + k).alias(f"n{a}") for k, a in enumerate("xyz", 1)]
    angle = F.element_at("angle", F.col("i") + 1)
    return flat.select("branch_id", "seq", *value, angle.isNotNull().alias("repaired"), angle.alias("angle"))
