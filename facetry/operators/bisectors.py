"""Two-side bisectors: normals at a line between two surfaces, from the faces on either side of it.

Everything happens inside a point's nearest faces, at most k of them: the pair of faces that lie most opposite across
the tangent, and the best supported direction of a side, are found in each group by numpy, over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import add, dot, named, norm, scale, sub, unit, vec
from .curves import _written
from .meshes import metrics
from .reports import nearest_faces
from .spatial import nearest


@dataclass(frozen=True)
class Sides:
    """k faces a point, at most `take` of them on a side, of one direction up to `degrees`."""

    faces: int = 96
    take: int = 8
    degrees: float = 25.0
    least_offset: float = 1e-5
    least_distance: float = 1e-5

    def __post_init__(self) -> None:
        if self.faces < 1 or self.take < 1 or not 0 < self.degrees < 90 or self.least_offset <= 0 or self.least_distance <= 0:
            raise ValueError("faces and take >= 1, degrees between 0 and 90, least_offset and least_distance > 0 are needed")


def faces_around(curve: DataFrame, triangles: DataFrame, config: Sides, flash: DataFrame | None = None) -> DataFrame:
    """point_index, rank, face_id, distance, n* (turned towards the nearest flash point, if there are any) and o*, the
    offset of the face's centroid across the tangent. curve has point_index, x, y, z, t*; flash has point_id, qx, qy, qz."""
    valid = metrics(triangles).where("valid")
    near = nearest_faces(curve, triangles.join(valid.select("face_id"), "face_id", "left_semi"), config.faces, 0.0, config.faces)
    rows = near.join(valid.select("face_id", "nx", "ny", "nz", "mx", "my", "mz"), "face_id").join(curve.select("point_index", "x", "y", "z", "tx", "ty", "tz"), "point_index")
    raw = sub(vec("m"), vec())
    rows = rows.withColumns({f"o{a}": c for a, c in zip("xyz", sub(raw, scale(vec("t"), dot(raw, vec("t")))), strict=True)})
    if flash is not None:
        to = nearest(curve.select("point_index", "x", "y", "z"), flash, "point_index", ["point_id"])
        to = to.select("point_index", *[F.coalesce(c, F.lit(0.0)).alias(f"f{a}") for c, a in zip(unit(sub(vec("q"), vec())), "xyz", strict=True)])
        rows = rows.join(to, "point_index")
        turn = F.when(dot(vec("n"), vec("f")) < 0, -1.0).otherwise(1.0)
        rows = rows.withColumns({f"n{a}": c for a, c in zip("xyz", scale(vec("n"), turn), strict=True)})
    return rows.select("point_index", F.col("rank").cast("long").alias("rank"), "face_id", "distance", *[f"{k}{a}" for k in "nom" for a in "xyz"])


def _opposite(u: np.ndarray) -> np.ndarray:
    """The two rows (of unit vectors, in order of rank) with the least product, of equals the first."""
    dots = u[:, None, 0] * u[:, 0] + u[:, None, 1] * u[:, 1] + u[:, None, 2] * u[:, 2]
    p, q = divmod(int(dots.argmin()), len(u))
    return np.concatenate([u[p], u[q]])


def _leading(rows: np.ndarray, cosine: float) -> np.ndarray:
    """Of normals and distances in order of rank the normal that most others agree with, up to the sign, and their number;
    of equals the one of the lesser median distance, then the first."""
    n = rows[:, :3]
    agree = np.abs(n[:, None, 0] * n[:, 0] + n[:, None, 1] * n[:, 1] + n[:, None, 2] * n[:, 2]) >= cosine
    support = agree.sum(axis=1)
    most = int(support.max())
    seeds, order = np.flatnonzero(support == most), rows[:, 3].argsort(kind="stable")
    if most:  # a normal of no length agrees with none, not even itself
        near = rows[order, 3][np.nonzero(agree[seeds][:, order])[1].reshape(-1, most)]
        best = seeds[((near[:, (most - 1) // 2] + near[:, most // 2]) / 2).argmin()]
        return np.array([most, *n[best]])
    return np.full(4, np.nan)


def _of_group(rows: DataFrame, key: list[str], columns: list[str], of: Callable[[np.ndarray], np.ndarray], names: list[str]) -> DataFrame:
    """key and names: what `of` makes of the columns of each group, in order of rank; nothing where that is not a number.
    A group has at most k faces. As a join, its pairs were k * k rows that the aggregates then sorted."""
    listed = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("m")
            parts = m.flatten()
            table = np.stack([parts.field(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            ends = np.cumsum([0, *(len(x) for x in m)])
            made = np.array([of(table[i:j]) for i, j in zip(ends, ends[1:], strict=False)]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in key], *[pa.array(x) for x in made.T]], [*key, *names])

    schema = listed.select(*key).schema
    for name in names:
        schema = schema.add(name, "double")
    return listed.mapInArrow(run, schema).where(~F.isnan(names[0]))


def split_sides(around: DataFrame, config: Sides) -> DataFrame:
    """around with side (0 or 1) and by (how it was split); a face may be on both sides where directions split them.

    The two offsets that are most opposite give an axis, and faces fall to either side of it. Where fewer than four faces
    lie off the line, or a side has less than two, the nearest face and the nearest one of another direction each gather
    the faces of theirs; without a second direction a point has no sides."""
    off = around.withColumns({f"u{a}": c for a, c in zip("xyz", unit(vec("o")), strict=True)}).where(norm(vec("o")) > config.least_offset)
    pairs = _of_group(off, ["point_index"], ["ux", "uy", "uz"], _opposite, [f"{k}{a}" for k in "pq" for a in "xyz"])
    axes = pairs.select("point_index", *named(unit(sub(vec("p"), vec("q"))), "s")).where("sx IS NOT NULL")
    placed = off.join(axes, "point_index").withColumn("side", F.when(dot(vec("u"), vec("s")) >= 0, 0).otherwise(1))
    whole = Window.partitionBy("point_index")
    placed = placed.withColumn("n0", F.sum(1 - F.col("side")).over(whole)).withColumn("n1", F.sum("side").over(whole))
    placed = placed.where("n0 >= 2 AND n1 >= 2 AND n0 + n1 >= 4").select(*around.columns, "side", F.lit("projected_offset").alias("by"))
    placed = _written(placed)
    rest = around.join(placed.select("point_index").distinct(), "point_index", "left_anti")
    cosine = math.cos(math.radians(config.degrees))
    seed = rest.groupBy("point_index").agg(F.min_by(F.struct(*[f"n{a}" for a in "xyz"]), "rank").alias("a"))
    rest = rest.join(seed, "point_index").withColumn("_a", F.abs(dot(vec("n"), vec("a.n"))))
    other = rest.where(F.col("_a") < cosine).groupBy("point_index").agg(F.min_by(F.struct(*[f"n{a}" for a in "xyz"]), "rank").alias("b"))
    rest = rest.join(other, "point_index").withColumn("_b", F.abs(dot(vec("n"), vec("b.n"))))
    both = F.array_compact(F.array(F.when(F.col("_a") >= cosine, 0), F.when(F.col("_b") >= cosine, 1)))
    return placed.unionByName(rest.select(*around.columns, F.explode(both).alias("side"), F.lit("nearest_distinct_normal_clusters").alias("by")))


def coherent_sides(split: DataFrame, config: Sides, center: tuple[float, float, float] | None) -> DataFrame:
    """point_index, side, n*, support, taken: each side's direction. The face that most others agree with (up to the
    sign; of equals the one whose faces are nearer) leads, and its nearest faces are averaged by nearness. Where a mesh
    centre is given, directions point away from it; else they are taken as they are turned."""
    cosine, key = math.cos(math.radians(config.degrees)), ["point_index", "side"]
    best = _of_group(split, key, ["nx", "ny", "nz", "distance"], partial(_leading, cosine=cosine), ["support", "sx", "sy", "sz"])
    best = best.withColumn("support", F.col("support").cast("long"))
    pool = split.join(best, key).where(F.abs(dot(vec("s"), vec("n"))) >= cosine)
    pool = pool.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("rank"))).where(F.col("place") <= config.take)
    if center is not None:
        sign = F.when(dot(vec("s"), vec("n")) < 0, -1.0).otherwise(1.0)
        pool = pool.withColumns({f"n{a}": c for a, c in zip("xyz", scale(vec("n"), sign), strict=True)})
    floor = F.greatest(F.lit(config.least_distance), F.median("distance").over(Window.partitionBy(*key)))
    pool = pool.withColumn("w", 1 / (F.col("distance") + floor))
    sums = pool.groupBy(*key).agg(F.first("support").alias("support"), F.count("*").alias("taken"), *[F.sum(F.col("w") * F.col(f"n{a}")).alias(f"d{a}") for a in "xyz"], *[F.avg(f"m{a}").alias(f"c{a}") for a in "xyz"])
    rows = sums.select(*key, "support", "taken", *named(unit(vec("d")), "d"), "cx", "cy", "cz").where("dx IS NOT NULL")
    turn = F.lit(1.0) if center is None else F.when(dot(vec("d"), sub(vec("c"), tuple(map(F.lit, center)))) < 0, -1.0).otherwise(1.0)
    return rows.select(*key, *named(scale(vec("d"), turn), "n"), "support", "taken")


def two_side_bisectors(curve: DataFrame, triangles: DataFrame, config: Sides = Sides(), flash: DataFrame | None = None, center: tuple[float, float, float] | None = None) -> DataFrame:
    """point_index, n*, sides (how many gave a direction), by, support0, support1: the inner bisector of the two sides'
    directions, the first one where they cancel, the nearest face's normal where a side is missing. Without flash points
    the mesh's centre (the mean of its vertices) is needed to tell outside from inside."""
    if (flash is None) == (center is None):
        raise ValueError("either flash points or the mesh's centre is needed")
    around = _written(faces_around(curve, triangles, config, flash))
    split = _written(split_sides(around, config))
    found = coherent_sides(split, config, center)
    each = [F.max_by(F.struct("nx", "ny", "nz", "support"), F.when(F.col("side") == k, 1)).alias(f"d{k}") for k in (0, 1)]
    sides = found.groupBy("point_index").agg(*each).join(split.groupBy("point_index").agg(F.first("by").alias("by")), "point_index", "left")
    first = around.groupBy("point_index").agg(F.min_by(F.struct("nx", "ny", "nz"), "rank").alias("near"))
    rows = first.join(sides, "point_index", "left")
    both = F.col("d0").isNotNull() & F.col("d1").isNotNull()
    middle = unit(add(vec("d0.n"), vec("d1.n")))
    made = [F.when(both, F.coalesce(m, F.col(f"d0.n{a}"))).otherwise(F.col(f"near.n{a}")).alias(f"n{a}") for m, a in zip(middle, "xyz", strict=True)]
    return rows.select("point_index", *made, F.when(both, 2).otherwise(1).alias("sides"), "by", F.when(both, F.col("d0.support")).alias("support0"), F.when(both, F.col("d1.support")).alias("support1"))


def flash_signed(rows: DataFrame, points: DataFrame, flash: DataFrame) -> DataFrame:
    """rows (point_index, n*, t*) with n* laid across the tangent and turned towards the nearest flash point; the normal
    itself where it is along the tangent. flash has point_id, qx, qy, qz."""
    to = nearest(points.select("point_index", "x", "y", "z"), flash, "point_index", ["point_id"]).select("point_index", *named(sub(vec("q"), vec()), "f"))
    both = rows.join(to, "point_index")
    laid = unit(sub(vec("n"), scale(vec("t"), dot(vec("n"), vec("t")))))
    both = both.withColumns({f"l{a}": F.coalesce(c, F.col(f"n{a}")) for a, c in zip("xyz", laid, strict=True)})
    turn = F.when(dot(vec("l"), vec("f")) < 0, -1.0).otherwise(1.0)
    return both.select(*[c for c in rows.columns if c not in ("nx", "ny", "nz")], *named(scale(vec("l"), turn), "n"))
