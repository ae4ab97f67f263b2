"""Patch normals: the mean direction of the faces next to a point, and the choice among all ways to estimate normals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import angle, dot, scale, unit, vec
from . import bisectors, continuity, normals
from .curves import _written
from .meshes import closed, metrics, signed_volume
from .reports import nearest_faces


@dataclass(frozen=True)
class Patch:
    """The nearest `faces`; those up to `factor` times the nearest distance are taken, `least` of them if there are so many
    within `radius`."""

    faces: int = 32
    factor: float = 3.0
    floor: float = 1e-5
    least: int = 10
    radius: float = 0.01

    def __post_init__(self) -> None:
        if self.faces < 1 or self.least < 1 or self.factor <= 1 or self.floor <= 0 or self.radius <= 0:
            raise ValueError("faces and least >= 1, factor > 1, floor and radius > 0 are needed")


def adaptive(near: DataFrame, config: Patch) -> DataFrame:
    """near (point_index, rank, distance and more) cut down to each point's patch, with low_support: fewer than `least`
    faces, or one beyond the radius. The nearest face always stays."""
    whole = Window.partitionBy("point_index")
    nearest = F.min("distance").over(whole)
    cutoff = F.least(F.greatest(nearest * config.factor, F.lit(config.floor)), F.lit(config.radius))
    rows = near.withColumn("_near", F.col("distance") <= cutoff).withColumn("_within", F.col("distance") <= config.radius)
    rows = rows.withColumn("_n", F.count_if("_near").over(whole)).withColumn("_m", F.count_if("_within").over(whole))
    filled = F.when(F.col("_m") >= config.least, F.col("rank") <= config.least).otherwise(F.col("_within"))
    kept = rows.where(F.when(F.col("_n") >= config.least, F.col("_near")).otherwise(filled) | (F.col("rank") == 1))
    low = (F.count("*").over(whole) < config.least) | (F.max("distance").over(whole) > config.radius + 1e-12)
    return kept.withColumn("low_support", low).drop("_near", "_within", "_n", "_m")


def patch_normals(points: DataFrame, triangles: DataFrame, config: Patch = Patch(), outward: float = 1.0) -> DataFrame:
    """point_index, n*, coherence (the widest angle of a face from the mean, in degrees), sign_consistency (|mean sign| of
    the faces), faces, nearest_distance, patch_radius, low_support. Faces are turned to the area-weighted majority
    (`outward` -1 turns that, for a closed mesh wound inwards) and averaged by area over distance."""
    face = metrics(triangles).where("valid").select("face_id", "nx", "ny", "nz", "area")
    solid = triangles.join(face.select("face_id"), "face_id", "left_semi")
    near = nearest_faces(points, solid, max(config.faces, config.least), 0.0, max(config.faces, config.least))
    rows = _written(adaptive(near, config).join(face, "face_id"))
    sums = rows.groupBy("point_index").agg(*[F.sum(F.col("area") * F.col(f"n{a}")).alias(f"s{a}") for a in "xyz"], F.min_by(F.struct("nx", "ny", "nz"), "rank").alias("first"))
    seeds = sums.select("point_index", *[(F.coalesce(c, F.col(f"first.n{a}")) * outward).alias(f"s{a}") for c, a in zip(unit(vec("s")), "xyz", strict=True)])
    sign = F.when(dot(vec("n"), vec("s")) >= 0, 1.0).otherwise(-1.0)
    turned = rows.join(seeds, "point_index").withColumn("sign", sign)
    turned = turned.withColumns({f"n{a}": c for a, c in zip("xyz", scale(vec("n"), F.col("sign")), strict=True)})
    weight = F.col("area") / F.greatest("distance", F.lit(config.floor))
    means = turned.groupBy("point_index").agg(
        *[F.sum(weight * F.col(f"n{a}")).alias(f"m{a}") for a in "xyz"], *[F.first(f"s{a}").alias(f"s{a}") for a in "xyz"], F.abs(F.avg("sign")).alias("sign_consistency"),
        F.count("*").alias("faces"), F.min("distance").alias("nearest_distance"), F.max("distance").alias("patch_radius"), F.bool_or("low_support").alias("low_support"),
    )
    means = means.withColumns({f"m{a}": F.coalesce(c, F.col(f"s{a}")) for c, a in zip(unit(vec("m")), "xyz", strict=True)})
    widest = turned.select("point_index", "nx", "ny", "nz").join(means.select("point_index", "mx", "my", "mz"), "point_index").groupBy("point_index").agg(F.max(angle(vec("n"), vec("m"))).alias("coherence"))
    return means.join(widest, "point_index").select("point_index", *[F.col(f"m{a}").alias(f"n{a}") for a in "xyz"], "coherence", "sign_consistency", "faces", "nearest_distance", "patch_radius", "low_support")


def surface_normals(curve: DataFrame, faces: DataFrame, vertices: DataFrame, method: str = "p1", *, flash: DataFrame | None = None, config: normals.Config = normals.Config(), patch: Patch = Patch(), sides: bisectors.Sides = bisectors.Sides()) -> DataFrame:
    """point_index and n* by one of the methods: those of `normals.METHODS`; two_face_angle_bisector (with flash points laid
    across the tangent and turned to them); surface_patch_continuity (patch normals, jumps along branches mended). curve
    has point_index, branch_id, seq, x, y, z, t*."""
    points = curve.select("point_index", "x", "y", "z")
    if method in normals.METHODS:
        return normals.estimate(points, normals.prepared(faces, vertices, config.repair)[0], method, config).select("point_index", "nx", "ny", "nz")
    triangles = normals.gathered(faces, vertices)
    if method == "two_face_angle_bisector":
        if flash is None:
            center = tuple(vertices.agg(*[F.avg(a) for a in "xyz"]).first())
            return bisectors.two_side_bisectors(curve, triangles, sides, center=center).select("point_index", "nx", "ny", "nz")
        found = bisectors.two_side_bisectors(curve, triangles, sides, flash=flash).select("point_index", "nx", "ny", "nz")
        signed = bisectors.flash_signed(found.join(curve.select("point_index", "tx", "ty", "tz"), "point_index"), points, flash)
        return signed.select("point_index", "nx", "ny", "nz")
    if method == "surface_patch_continuity":
        inward = closed(faces).first().closed and (signed_volume(triangles).first().volume or 0.0) < 0
        found = _written(patch_normals(points, triangles, patch, -1.0 if inward else 1.0))
        rows = curve.select("point_index", "branch_id", "seq", "tx", "ty", "tz").join(found.select("point_index", "nx", "ny", "nz", *[F.col(f"n{a}").alias(f"p{a}") for a in "xyz"]), "point_index")
        mended = continuity.repaired(continuity.corrected_tangents(rows))
        return curve.select("point_index", "branch_id", "seq").join(mended, ["branch_id", "seq"]).select("point_index", "nx", "ny", "nz")
    raise ValueError(f"unknown method {method}")
