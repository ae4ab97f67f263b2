"""Triangle meshes: normalisation, metrics, surface samples, vertex normals, closedness, volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import add, cross, dot, named, norm, scale, sub, unit, vec


def bbox_normalize(points: DataFrame) -> DataFrame:
    """Centred on the bounding box and divided by its largest extent."""
    box = points.agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    size = F.greatest(*[F.col(f"hi{a}") - F.col(f"lo{a}") for a in "xyz"])
    box = box.select(F.struct(*[((F.col(f"lo{a}") + F.col(f"hi{a}")) / 2).alias(a) for a in "xyz"], size.alias("size")).alias("box")).scalar()
    framed = points.withColumn("box", box)
    return framed.select(*[c for c in points.columns if c not in "xyz"], *[((F.col(a) - F.col(f"box.{a}")) / F.col("box.size")).alias(a) for a in "xyz"])


def bbox_frame(*tables: DataFrame, mode: str = "max_extent") -> DataFrame:
    """One row: scale and centre c* that normalise all the tables (x, y, z) together: coordinates are (v - c) / scale, and
    back v * scale + c. Mode none leaves them as they are; without any point, or extent, the scale is 1."""
    if mode not in ("max_extent", "none"):
        raise ValueError("mode must be max_extent or none")
    both = tables[0].select("x", "y", "z")
    for t in tables[1:]:
        both = both.unionByName(t.select("x", "y", "z"))
    if mode == "none":
        both = both.where("false")
    box = both.agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    size = F.greatest(*[F.col(f"hi{a}") - F.col(f"lo{a}") for a in "xyz"])
    middle = [F.coalesce((F.col(f"lo{a}") + F.col(f"hi{a}")) / 2, F.lit(0.0)).alias(f"c{a}") for a in "xyz"]
    return box.select(F.coalesce(F.when(size > 0, size), F.lit(1.0)).alias("scale"), *middle)


def in_frame(points: DataFrame, frame: DataFrame, back: bool = False) -> DataFrame:
    """points normalised by a frame, or taken back to their source."""
    rows = points.withColumn("_f", frame.select(F.struct("scale", "cx", "cy", "cz").alias("f")).scalar())
    made = [F.col(a) * F.col("_f.scale") + F.col(f"_f.c{a}") if back else (F.col(a) - F.col(f"_f.c{a}")) / F.col("_f.scale") for a in "xyz"]
    return rows.withColumns({a: c for a, c in zip("xyz", made, strict=True)}).drop("_f")


def metrics(triangles: DataFrame) -> DataFrame:
    """Unit normal (null if degenerate), area, centroid, validity."""
    n = cross(sub(vec("b"), vec("a")), sub(vec("c"), vec("a")))
    mid = tuple((F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}")) / 3 for x in "xyz")
    return triangles.select("*", *named(unit(n), "n"), (norm(n) / 2).alias("area"), *named(mid, "m"), (norm(n) > 1e-12).alias("valid"))


def surface_samples(triangles: DataFrame) -> DataFrame:
    """Corners, centroid and edge midpoints of every face, each with the face's normal."""
    corner = {k: vec(k) for k in "abc"}
    kinds = [("corner_" + k, v) for k, v in corner.items()] + [("centroid", vec("m"))]
    kinds += [(f"edge_{p}{q}", scale(add(corner[p], corner[q]), 0.5)) for p, q in ("ab", "bc", "ca")]
    made = F.array(*[F.struct(F.lit(k).alias("kind"), *named(v)) for k, v in kinds])
    return metrics(triangles).select("face_id", *[f"n{a}" for a in "xyz"], F.explode(made).alias("s")).select("face_id", "s.*", *[f"n{a}" for a in "xyz"])


def gathered(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles from vertex numbers: three equi joins."""
    out = faces
    for i, k in enumerate("abc"):
        side = vertices.select(F.col("vertex_id").alias(f"v{i}"), *[F.col(a).alias(f"{k}{a}") for a in "xyz"])
        out = out.join(side, f"v{i}")
    return out


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """The normalised sum of the unit normals of a vertex's faces; null where it vanishes."""
    corner = metrics(gathered(faces, vertices)).where("valid").select(F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), "nx", "ny", "nz")
    sums = corner.groupBy("vertex_id").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    return sums.select("vertex_id", *named(unit(vec("n")), "n"))


def edge_uses(faces: DataFrame) -> DataFrame:
    """How many faces use each undirected edge."""
    sides = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    return faces.select(F.explode(sides).alias("e")).groupBy("e.a", "e.b").agg(F.count("*").alias("uses"))


def closed(faces: DataFrame) -> DataFrame:
    """One row: is every edge used exactly twice, and how many are not."""
    return edge_uses(faces).agg(F.coalesce(F.bool_and(F.col("uses") == 2), F.lit(False)).alias("closed"), F.count_if(F.col("uses") != 2).alias("open_edges"))


def signed_volume(triangles: DataFrame) -> DataFrame:
    return triangles.agg((F.sum(dot(vec("a"), cross(vec("b"), vec("c")))) / 6).alias("volume"))


def boxes(triangles: DataFrame, *more: Column) -> DataFrame:
    """Bounding box of every face, and more columns of it."""
    return triangles.select("face_id", *more, *[f(f"a{a}", f"b{a}", f"c{a}").alias(f"{n}{a}") for n, f in (("lo", F.least), ("hi", F.greatest)) for a in "xyz"])
