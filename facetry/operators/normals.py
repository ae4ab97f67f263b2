"""Surface normals at points from the faces around them.

A mesh is prepared once (`prepared`): windings are made to agree along shared edges and to enclose a positive volume. Each
point has its nearest faces, at most k of them, and every step below is a join, window or aggregate over these bounded
neighbourhoods: clusters of directions, patches of several sizes, bilateral means, quadric fits. Python is left with two
small folds inside a neighbourhood: the greedy clustering, whose result depends on the order of its faces, and the hull.

Faces have face_id, v0, v1, v2, the corners a*, b*, c*, the unit normal n* and area; members are a point's faces with
their exact distance and rank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.vec import add, angle, cross, distance, dot, named, norm, scale, sub, unit, vec
from .curves import _written, components
from .meshes import gathered, metrics
from .orientation import robust_directions
from .reports import nearest_faces

KEY = ["point_index"]
SCALES = (12, 24, 48, 96)


@dataclass(frozen=True)
class Config:
    """What the estimators take; angles in degrees, lengths in the mesh's unit."""

    faces: int = 96
    radius: float = 0.02
    min_faces: int = 10
    cluster_degrees: float = 15.0
    min_support: int = 4
    crease_degrees: float = 10.0
    side_ratio: float = 0.35
    side_faces: int = 6
    trim_degrees: float = 25.0
    residual_ratio: float = 0.02
    max_condition: float = 1e6
    min_hull_ratio: float = 0.1
    sigma_scale: float = 0.01
    sigma_degrees: float = 15.0
    repair: bool = True


def shared_edges(faces: DataFrame) -> DataFrame:
    """a, b (faces, a < b) and turned (they pass a shared edge in one direction, so that one of them must flip), for
    each edge of exactly two uses; edges of more uses carry nothing on."""
    sides = F.array(*[F.struct(F.least(p, q).alias("low"), F.greatest(p, q).alias("high"), (F.col(p) < F.col(q)).alias("up")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    uses = faces.select("face_id", F.explode(sides).alias("e")).groupBy("e.low", "e.high").agg(
        F.count("*").alias("uses"), F.min("face_id").alias("a"), F.max("face_id").alias("b"), F.count_if("e.up").alias("ups"))
    return uses.where("uses = 2 AND a < b").select("a", "b", (F.col("ups") != 1).alias("turned"))


def winding(faces: DataFrame) -> DataFrame:
    """face_id, component (its least face), flip, orientable. Faces are doubled, one copy as it is and one flipped; a
    shared edge joins the copies that agree. Components of this cover tell all: the copies of a face fall apart where the
    faces can be made to agree, and a face flips if its flipped copy hangs with the least face as it is. A component
    that no choice of flips makes agree is not orientable and keeps its windings."""
    edges = shared_edges(faces)
    copies = faces.select(F.explode(F.array(F.col("face_id") * 2, F.col("face_id") * 2 + 1)).alias("vertex_id"))
    turned = F.col("turned").cast("int")
    both = edges.select(F.explode(F.array(*[F.struct((F.col("a") * 2 + i).alias("a"), (F.col("b") * 2 + F.when(turned == 1, 1 - i).otherwise(i)).alias("b")) for i in (0, 1)])).alias("e")).select("e.*")
    found = components(copies, both)
    two = found.groupBy(F.shiftright("vertex_id", 1).alias("face_id")).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "vertex_id").alias("own"))
    orientable = F.col("low") != F.col("high")
    return two.select("face_id", F.shiftright("low", 1).alias("component"), (orientable & (F.col("own") % 2 == 1)).alias("flip"), orientable.alias("orientable"))


def _volume(triangles: DataFrame) -> Column:
    return F.coalesce(F.sum(dot(vec("a"), cross(vec("b"), vec("c")))) / 6, F.lit(0.0))


def prepared(faces: DataFrame, vertices: DataFrame, repair: bool = True) -> tuple[DataFrame, DataFrame]:
    """The valid faces with corners, unit normal n*, area and flipped; and one row: components, flipped_faces,
    conflicts (components that cannot agree), crowded_edges (of more than two uses), turned (all normals were), volume."""
    solid = metrics(gathered(faces, vertices)).where("valid").drop("valid", "mx", "my", "mz")
    solid = _written(solid.select("face_id", "v0", "v1", "v2", *[f"{k}{a}" for k in "abc" for a in "xyz"], "nx", "ny", "nz", "area"))
    if repair:
        ways = _written(winding(solid))
        solid = _written(solid.join(ways.select("face_id", "flip"), "face_id"))
    else:
        ways, solid = None, solid.withColumn("flip", F.lit(False))
    turned_volume = F.when(F.col("flip"), -1).otherwise(1) * dot(vec("a"), cross(vec("b"), vec("c")))
    volume = solid.agg(F.coalesce(F.sum(turned_volume) / 6, F.lit(0.0)).alias("v")).first()[0]
    turned = repair and volume < 0
    sign = F.when(F.col("flip") != F.lit(turned), -1.0).otherwise(1.0)
    out = solid.select(*[c for c in solid.columns if c not in ("nx", "ny", "nz", "flip")], *named(scale(vec("n"), sign), "n"), F.col("flip").alias("flipped"))
    sides = F.array(*[F.struct(F.least(p, q).alias("low"), F.greatest(p, q).alias("high")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    crowded = solid.select(F.explode(sides).alias("e")).groupBy("e").count().agg(F.count_if(F.col("count") > 2).alias("crowded_edges"))
    if ways is None:
        sums = crowded.select(F.lit(0).cast("long").alias("components"), F.lit(0).cast("long").alias("flipped_faces"), F.lit(0).cast("long").alias("conflicts"), F.lit(0).cast("long").alias("crowded_edges"))
    else:
        parts = ways.groupBy("component").agg(F.count_if("flip").alias("flips"), F.bool_and("orientable").alias("orientable"))
        counts = parts.agg(F.count("*").alias("components"), F.coalesce(F.sum("flips"), F.lit(0)).alias("flipped_faces"), F.count_if(~F.col("orientable")).alias("conflicts"))
        sums = counts.join(F.broadcast(crowded))  # one row each
    return out, sums.select("*", F.lit(turned).alias("turned"), F.lit(abs(volume) if repair else volume).alias("volume"))


def neighbourhoods(points: DataFrame, mesh: DataFrame, config: Config) -> DataFrame:
    """The members of every point: point_index, rank, face_id, distance, and the face's normal and area."""
    near = nearest_faces(points, mesh, max(config.faces, config.min_faces), config.radius, config.min_faces)
    return near.select("point_index", F.col("rank").cast("long").alias("rank"), "face_id", "distance").join(mesh.select("face_id", "nx", "ny", "nz", "area"), "face_id")


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt(v @ v)
    return v / n if n > 1e-12 else v * 0


def greedy(normals: np.ndarray, cosine: float) -> list[int]:
    """The cluster of each normal. In order each joins the cluster with the nearest mean within the angle (the first of
    equals) or begins one; then the first two clusters whose means are within the angle merge, until none are."""
    sums: list[np.ndarray] = []
    means: list[np.ndarray] = []
    held: list[list[int]] = []
    for i, n in enumerate(normals):
        dots = np.array(means) @ n if means else np.zeros(0)
        best = int(dots.argmax()) if len(dots) else 0
        if len(dots) and dots[best] >= cosine:
            sums[best] = sums[best] + n
            means[best] = _unit(sums[best])
            held[best].append(i)
        else:
            sums.append(n)
            means.append(n)
            held.append([i])
    while True:
        m = np.array(means)
        close = np.argwhere(np.triu(m @ m.T >= cosine, 1))
        if not len(close):
            break
        a, b = close[0].tolist()
        sums[a] = sums[a] + sums.pop(b)
        means.pop(b)
        means[a] = _unit(sums[a])
        held[a] += held.pop(b)
    label = [0] * len(normals)
    for k, some in enumerate(held):
        for i in some:
            label[i] = k
    return label


def clustered(members: DataFrame, degrees: float, min_support: int, key: list[str] = KEY) -> DataFrame:
    """members with their cluster: place (1 for the largest; of equals the earlier one), support, cluster_area,
    cluster_distance (median), the mean c*, spread_deg (widest angle from it) and kept. Clusters of less than min_support
    faces are not kept, but where all are smaller the first is."""
    cosine = math.cos(math.radians(degrees))
    held = [c for c in members.columns if c not in key]
    each = members.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in held if c != "rank"]))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("m")
            parts = m.flatten()
            n = np.stack([parts.field(f"n{a}").to_numpy(zero_copy_only=False) for a in "xyz"], axis=1)
            ends = np.cumsum([0, *(len(x) for x in m)])
            labels = [greedy(n[i:j], cosine) for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in key], m, pa.array(labels, pa.list_(pa.int32()))], [*key, "m", "label"])

    each = each.mapInArrow(run, StructType([*each.schema, StructField("label", ArrayType(IntegerType()))]))
    rows = each.select(*key, F.explode(F.arrays_zip("m", "label")).alias("x")).select(*key, "x.m.*", "x.label")
    own, whole = Window.partitionBy(*key, "label"), Window.partitionBy(*key)
    mean = unit(tuple(F.sum(f"n{a}").over(own) for a in "xyz"))
    rows = rows.select("*", *[F.coalesce(c, F.lit(0.0)).alias(f"c{a}") for c, a in zip(mean, "xyz", strict=True)], F.count("*").over(own).alias("support"))
    rows = rows.withColumns({
        "cluster_area": F.sum("area").over(own), "cluster_distance": F.median("distance").over(own), "spread_deg": F.max(angle(vec("n"), vec("c"))).over(own),
        "place": F.dense_rank().over(whole.orderBy(F.desc("support"), "label")), "_most": F.max("support").over(whole),
    })
    kept = (F.col("support") >= min_support) | ((F.col("_most") < min_support) & (F.col("place") == 1))
    return rows.withColumn("kept", kept).drop("label", "_most")


_CLUSTER = ("place", "support", "cluster_area", "cluster_distance", "spread_deg", "cx", "cy", "cz")


def primary_clusters(tagged: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key and primary (a struct): the kept cluster that holds the nearest face, else the first."""
    cluster = F.struct(*_CLUSTER)
    nearest = F.min_by(F.when(F.col("kept"), cluster), "rank")
    return tagged.groupBy(*key).agg(F.coalesce(nearest, F.max_by(cluster, F.when(F.col("place") == 1, 1))).alias("primary"))


def patch_stats(tagged: DataFrame, points: DataFrame, mesh: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key, faces, primary and secondary (structs; the second kept cluster, of two faces or more), angle12,
    support_ratio, min_support, mean m* (weights area / distance), patch_scale (nine of ten corners are within),
    patch_radius, low_support."""
    cluster = F.struct(*_CLUSTER)
    weight = F.col("area") / F.greatest("distance", F.lit(1e-6))
    second = (F.col("place") == 2) & F.col("kept") & (F.col("support") >= 2)
    sums = tagged.groupBy(*key).agg(
        F.count("*").alias("faces"), F.max("distance").alias("patch_radius"), F.max_by(cluster, F.when(second, 1)).alias("secondary"),
        F.coalesce(F.min_by(F.when(F.col("kept"), cluster), "rank"), F.max_by(cluster, F.when(F.col("place") == 1, 1))).alias("primary"),
        *[F.sum(weight * F.col(f"n{a}")).alias(f"m{a}") for a in "xyz"],
    )
    corners = F.array(*[F.struct(F.col(f"v{i}").alias("v"), *[F.col(f"{k}{a}").alias(a) for a in "xyz"]) for i, k in enumerate("abc")])
    ends = tagged.select(*key, "face_id").join(mesh.select("face_id", corners.alias("corners")), "face_id").select(*key, F.explode("corners").alias("c")).distinct()
    far = ends.join(points.select("point_index", *[F.col(a).alias(f"p{a}") for a in "xyz"]), "point_index").withColumn("far", distance(vec("c."), vec("p")))
    sizes = far.groupBy(*key).agg(F.percentile("far", F.lit(0.9)).alias("patch_scale"))
    rows = sums.join(sizes, key)
    one, two = F.col("primary.support"), F.col("secondary.support")
    return rows.select(
        *key, "faces", "primary", "secondary", angle(vec("primary.c"), vec("secondary.c")).alias("angle12"),
        F.when(two.isNotNull(), F.least(one, two) / F.greatest(one, two)).alias("support_ratio"), F.when(two.isNotNull(), F.least(one, two)).alias("min_support"),
        *[F.coalesce(c, F.lit(0.0)).alias(f"m{a}") for c, a in zip(unit(vec("m")), "xyz", strict=True)],
        "patch_scale", "patch_radius", ((F.col("patch_scale") <= 1e-12) | (F.col("faces") < 4)).alias("low_support"),
    )


def shape_patches(members: DataFrame, points: DataFrame, mesh: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """The members of each point's best patch (tagged), and the patch's stats with scale, score and valid.

    Of the nearest 12, 24, 48 and 96 faces those are cut off that turn away from the primary cluster; a patch of enough
    support is scored by support, flatness and a second surface, and the best (the smaller of equals) is taken. A point
    without one takes its largest cluster of all members if that has the support, else all members, not valid."""
    sizes = members.groupBy("point_index").agg(F.count("*").alias("held"))
    nested = members.join(sizes, "point_index").select(*members.columns, "held", F.explode(F.array(*map(F.lit, SCALES))).alias("scale"))
    before = F.lit(0) if len(SCALES) == 1 else F.expr(f"CASE scale {' '.join(f'WHEN {b} THEN {a}' for a, b in zip((0, *SCALES), SCALES, strict=False))} END")
    # a scale beyond the members repeats the one before it
    nested = nested.where((F.col("rank") <= F.col("scale")) & (F.col("held") > before) & (F.least("scale", "held") >= 4)).drop("held")
    key = ["point_index", "scale"]
    first = clustered(nested, config.cluster_degrees, 2, key)
    first = first.join(primary_clusters(first, key), key)
    first = first.withColumn("_on", angle(vec("n"), vec("primary.c")) <= config.trim_degrees)
    first = first.withColumn("_left", F.count_if("_on").over(Window.partitionBy(*key)))
    trimmed = _written(first.where(F.col("_on") | (F.col("_left") < max(4, config.min_support))).select(*nested.columns))
    again = _written(clustered(trimmed, config.cluster_degrees, 2, key))
    stats = patch_stats(again, points, mesh, key).where(F.col("primary.support") >= config.min_faces)
    spread = F.col("primary.spread_deg")
    penalty = F.when(F.col("angle12") > 10, 0.5).otherwise(1.0)
    score = F.col("primary.support") * F.exp(-F.pow(spread / 20, 2)) * penalty * (1 - 0.5 * F.least(spread / 90, F.lit(1.0)))
    place = F.row_number().over(Window.partitionBy("point_index").orderBy(F.desc("score"), "scale"))
    best = _written(stats.withColumn("score", score).withColumn("_place", place).where("_place = 1").drop("_place").withColumn("valid", F.lit(True)))
    chosen = again.join(best.select(*key), key)

    left = members.join(best.select("point_index"), "point_index", "left_anti")
    all_of = clustered(left, config.cluster_degrees, 1)
    big = all_of.withColumn("_big", F.max(F.when(F.col("place") == 1, F.col("support"))).over(Window.partitionBy("point_index")) >= config.min_faces)
    held = big.where(~F.col("_big") | (F.col("place") == 1)).select(*members.columns, "_big")
    rest = _written(clustered(held, config.cluster_degrees, 1))
    valid = rest.groupBy("point_index").agg(F.bool_and("_big").alias("valid"))
    others = patch_stats(rest, points, mesh).join(valid, "point_index").withColumns({"scale": F.lit(None).cast("int"), "score": F.lit(None).cast("double")})
    tagged = chosen.drop("scale").unionByName(rest.drop("_big"))
    return tagged, best.unionByName(others)


def bilateral(members: DataFrame, guides: DataFrame, config: Config) -> DataFrame:
    """point_index and the direction g*: twice the mean of the members' normals, weighted by area, by nearness and by
    agreement with the direction before, at first the guide g*."""
    now = guides
    for _ in range(2):
        rows = members.join(now, "point_index")
        near, agree = F.exp(-F.pow(F.col("distance") / max(config.sigma_scale, 1e-9), 2)), F.exp(-F.pow(angle(vec("n"), vec("g")) / max(config.sigma_degrees, 1e-9), 2))
        weight = F.col("area") * near * agree / F.greatest("distance", F.lit(1e-6))
        sums = rows.withColumn("w", weight).groupBy("point_index").agg(F.greatest(F.sum("w"), F.lit(1e-18)).alias("w"), *[F.sum(F.col("w") * F.col(f"n{a}")).alias(f"s{a}") for a in "xyz"])
        mean = unit(tuple(F.col(f"s{a}") / F.col("w") for a in "xyz"))
        now = sums.select("point_index", *[F.coalesce(c, F.lit(0.0)).alias(f"g{a}") for c, a in zip(mean, "xyz", strict=True)])
    return now


#: Moments u^i v^j of the normal equations: those of a product of two design columns have i + j <= 4.
_POWERS = ((2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0))
_MOMENTS = tuple((i, j) for i in range(5) for j in range(5 - i))


def hull(points: np.ndarray) -> tuple[float, bool]:
    """Area of the convex hull, and whether the origin is in it (up to 1e-12); nothing for points on a line."""
    p = points[np.lexsort((points[:, 1], points[:, 0]))]

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    ring = np.array([*half(p), *half(p[::-1])])
    if len(ring) < 3:
        return 0.0, False
    side = np.roll(ring, -1, axis=0) - ring
    turn = ring[:, 0] * side[:, 1] - ring[:, 1] * side[:, 0]  # twice the area of the triangle with the origin
    length = np.sqrt((side * side).sum(axis=1))
    return float(turn.sum() / 2), bool((turn / np.where(length > 0, length, 1.0) >= -1e-12).all())


_FIT = "point_index long, fx double, fy double, fz double, residual double, threshold double, condition double, fit_rank int, hull_ratio double, root_inside boolean, fit_vertices long, fit_valid boolean"


def jet_fits(tagged: DataFrame, stats: DataFrame, points: DataFrame, mesh: DataFrame, config: Config) -> DataFrame:
    """A quadric over the plane of each patch's corners, by weighted least squares: f* (its normal at the point), residual,
    threshold, condition, fit_rank, hull_ratio, root_inside, fit_vertices, fit_valid.

    The plane comes from six sums, the fit from the 22 sums of its normal equations, all added up on the map side; tasks
    solve batches of small systems. The condition is that of the design (root of the equations' eigenvalues), so values
    beyond about 1e8 are not told apart. Fewer than eight corners, or a rank below five (at 1e-8), give no fit."""
    weight = F.col("area") / F.greatest("distance", F.lit(1e-6))
    corners = F.array(*[F.struct(F.col(f"v{i}").alias("v"), *[F.col(f"{k}{a}").alias(a) for a in "xyz"]) for i, k in enumerate("abc")])
    each = tagged.select("point_index", "face_id", weight.alias("w")).join(mesh.select("face_id", corners.alias("corners")), "face_id")
    each = each.select("point_index", "w", F.explode("corners").alias("c")).groupBy("point_index", "c").agg(F.greatest(F.sum("w"), F.lit(1e-12)).alias("w"))
    own = points.select("point_index", *[F.col(a).alias(f"p{a}") for a in "xyz"])
    each = _written(each.join(own, "point_index").select("point_index", "w", *named(sub(vec("c."), vec("p")))))
    products = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = each.groupBy("point_index").agg(
        F.count("*").alias("n"), F.sum("w").alias("whole"), F.percentile(norm(vec()), F.lit(0.9)).alias("size"),
        F.array(*[F.sum(F.col("w") * F.col(p) * F.col(q)) for p, q in products]).alias("second"),
    )
    sums = sums.where("n >= 8").join(stats.select("point_index", *[F.col(f"primary.c{a}").alias(f"r{a}") for a in "xyz"]), "point_index")

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column("second").flatten().to_numpy().reshape(-1, 6)
            e, v = np.linalg.eigh(s[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))
            n, u = v[:, :, 0], v[:, :, 2]
            reference = np.stack([b.column(f"r{a}").to_numpy() for a in "xyz"], axis=1)
            n = n * np.where((n * reference).sum(axis=1) < 0, -1.0, 1.0)[:, None]
            axes = np.concatenate([n, u, np.cross(n, u)], axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("point_index", "n", "whole", "size")], *[pa.array(x) for x in axes.T]], ["point_index", "n", "whole", "size", *_AXES])

    framed = sums.select("point_index", "n", "whole", "size", "second", "rx", "ry", "rz").mapInArrow(planes, "point_index long, n long, whole double, size double, " + ", ".join(f"{c} double" for c in _AXES))
    rows = each.join(framed, "point_index").select("point_index", "n", "size", *_AXES, (F.col("w") / F.col("whole")).alias("w"), dot(vec(), vec("u")).alias("u"), dot(vec(), vec("v")).alias("v"), dot(vec(), vec("n")).alias("h"))
    power = lambda i, j: F.col("w") * F.pow("u", F.lit(float(i))) * F.pow("v", F.lit(float(j)))
    equations = rows.groupBy("point_index", "n", "size", *_AXES).agg(
        F.array(*[F.sum(power(i, j)) for i, j in _MOMENTS]).alias("moments"), F.array(*[F.sum(power(i, j) * F.col("h")) for i, j in _POWERS], F.sum(F.col("w") * F.col("h") * F.col("h"))).alias("right"),
        F.collect_list(F.array("u", "v")).alias("uv"),
    )
    pick = np.array([[_MOMENTS.index((a[0] + b[0], a[1] + b[1])) for b in _POWERS] for a in _POWERS])
    ratio, most, least = config.residual_ratio, config.max_condition, config.min_hull_ratio

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a = b.column("moments").flatten().to_numpy().reshape(-1, len(_MOMENTS))[:, pick]
            right = b.column("right").flatten().to_numpy().reshape(-1, 7)
            size, axes = b.column("size").to_numpy(), np.stack([b.column(c).to_numpy() for c in _AXES], axis=1).reshape(-1, 3, 3)
            values = np.maximum(np.linalg.eigvalsh(a), 0.0)
            rank = (values > 1e-16 * values[:, -1:]).sum(axis=1)
            grade = 1 / np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))  # of equal size before solving
            x = np.linalg.pinv(a * grade[:, :, None] * grade[:, None, :], rcond=1e-15, hermitian=True) @ (right[:, :6] * grade)[:, :, None]
            x = x[:, :, 0] * grade
            residual = np.sqrt(np.maximum(0.0, right[:, 6] - 2 * (x * right[:, :6]).sum(axis=1) + np.einsum("ni,nij,nj->n", x, a, x)))
            condition = np.sqrt(values[:, -1] / np.maximum(values[:, 0], 1e-60))
            normal = axes[:, 0] - x[:, 3:4] * axes[:, 1] - x[:, 4:5] * axes[:, 2]
            normal /= np.sqrt((normal * normal).sum(axis=1))[:, None]
            rings = [hull(np.array(p.as_py())) for p in b.column("uv")]
            area, inside = np.array([r[0] for r in rings]) / np.maximum(size * size, 1e-18), np.array([r[1] for r in rings])
            threshold, fits = np.maximum(ratio * size, 1e-6), rank >= 5
            valid = fits & (residual <= threshold) & (condition <= most) & inside & (area >= least)
            arrays = [pa.array(c, mask=~fits) for c in (*normal.T, residual)] + [pa.array(c) for c in (threshold, condition, rank.astype(np.int32), area, inside)]
            yield pa.RecordBatch.from_arrays([b.column("point_index"), *arrays, b.column("n"), pa.array(valid)], [c.split()[0] for c in _FIT.split(", ")])

    return equations.mapInArrow(solve, _FIT)


_AXES = [f"{k}{a}" for k in "nuv" for a in "xyz"]

#: Which parts a method uses: a quadric fit, shape patches, bilateral means, robust means, creases.
METHODS = {
    "p1": "jet shape crease", "zhong2021": "shape crease", "zhang2015": "guided crease", "cazals2005": "jet", "li2010": "robust crease",
    "zhong+cazals": "jet shape crease", "zhang+cazals": "jet guided crease", "li+zhong": "jet shape robust crease", "all": "jet shape guided robust crease",
}


def confidence(rows: DataFrame, config: Config) -> Column:
    """The reasons against trusting a row's normal: an array of names, empty for high confidence. primary and secondary are
    the patch's, first_* those of the whole neighbourhood."""
    two, angle12 = F.col("first_secondary.support"), F.col("first_angle12")
    big, apart = two >= config.side_faces, F.coalesce(angle12 >= config.crease_degrees, F.lit(False))
    sided = F.col("source").isin("two_side_bisector", "robust_two_side_bisector")
    rules = {
        "invalid_patch": ~F.col("valid"),
        "primary_support_too_small": F.col("primary.support") < config.side_faces,
        "degenerate_patch_scale": F.col("patch_scale") <= 1e-9,
        "no_two_sided_support": big & ~apart,
        "support_imbalance": big & (F.col("first_support_ratio") < config.side_ratio),
        "small_feature_cluster": ~big & apart,
        "secondary_surface_ignored": big & apart & ~sided,
        "high_primary_spread": F.col("source").isin("shape_patch_mean", "primary_cluster_mean") & (F.col("primary.spread_deg") > config.trim_degrees),
        "invalid_jet_fit": (F.col("source") == "jet_fit") & ~F.coalesce("fit_valid", F.lit(False)),
        "degenerate_normal": F.col("degenerate"),
    }
    return F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))


def estimate(points: DataFrame, mesh: DataFrame, method: str = "p1", config: Config = Config()) -> DataFrame:
    """point_index, the unit normal n*, source, confidence (high or low), reasons, angle12, support1, support2,
    support_ratio, patch_faces, patch_valid, patch_scale, patch_radius, fit_valid, residual, condition. points have
    point_index, x, y, z; mesh is `prepared`. A crease's bisector comes first, then a valid fit, the bilateral mean, the
    robust mean and the primary cluster's mean; a normal that vanishes is (0, 0, 1)."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    parts, points = set(METHODS[method].split()), points.select("point_index", "x", "y", "z")
    members = _written(neighbourhoods(points, mesh, config))
    whole = _written(clustered(members, config.cluster_degrees, config.min_support))
    first = _written(patch_stats(whole, points, mesh))
    tagged, stats = whole, first.withColumn("valid", F.lit(True))
    if "shape" in parts:
        tagged, stats = shape_patches(members, points, mesh, config)
        tagged, stats = _written(tagged), _written(stats.drop("scale", "score"))
    guided = None
    if "guided" in parts:
        guided = _written(bilateral(members, primary_clusters(whole).select("point_index", *[F.col(f"primary.c{a}").alias(f"g{a}") for a in "xyz"]), config))
        if "shape" in parts:  # a patch of one surface gives way to the whole neighbourhood
            single = stats.where("secondary IS NULL").select("point_index")
            tagged = _written(tagged.join(single, "point_index", "left_anti").unionByName(whole.join(single, "point_index")))
            stats = _written(stats.join(single, "point_index", "left_anti").unionByName(first.withColumn("valid", F.lit(True)).join(single, "point_index")))
    before = first.select("point_index", F.col("secondary").alias("first_secondary"), F.col("angle12").alias("first_angle12"), F.col("support_ratio").alias("first_support_ratio"))
    rows = stats.join(before, "point_index")
    crease = (F.col("angle12") >= config.crease_degrees) & (F.col("support_ratio") >= config.side_ratio) & (F.col("min_support") >= config.side_faces)
    rows = rows.withColumn("crease", F.coalesce(crease, F.lit(False)) & F.lit("crease" in parts))
    none = F.lit(None).cast("double")
    if "robust" in parts:
        for name, k in (("primary", "o"), ("secondary", "t")):
            of = tagged.join(stats.select("point_index", F.col(f"{name}.place").alias("_at")), "point_index").where("place = _at")
            mean = robust_directions(of.select("point_index", "nx", "ny", "nz"), of.groupBy("point_index").agg(*[F.first(f"c{a}").alias(f"m{a}") for a in "xyz"]), "point_index")
            rows = rows.join(mean.select("point_index", *[F.coalesce(f"n{a}", F.lit(0.0)).alias(f"{k}{a}") for a in "xyz"]), "point_index", "left")
    else:
        rows = rows.withColumns({f"{k}{a}": none for k in "ot" for a in "xyz"})
    if guided is not None:
        rows = rows.join(guided, "point_index", "left")
    else:
        rows = rows.withColumns({f"g{a}": none for a in "xyz"})
    if "jet" in parts:
        sound = stats.where("valid")
        fits = jet_fits(tagged.join(sound.select("point_index"), "point_index"), sound, points, mesh, config)
        rows = rows.join(fits, "point_index", "left")
    else:
        rows = rows.withColumns({"fx": none, "fy": none, "fz": none, "residual": none, "condition": none, "fit_valid": F.lit(None).cast("boolean")})
    two = F.col("crease")
    robust_two = two & F.col("ox").isNotNull() & F.col("tx").isNotNull()
    fit = F.coalesce("fit_valid", F.lit(False))
    one, other = vec("primary.c"), vec("secondary.c")
    ways = [(robust_two, "robust_two_side_bisector", unit(add(vec("o"), vec("t")))), (two, "two_side_bisector", unit(add(one, other))), (fit, "jet_fit", vec("f")), (F.col("gx").isNotNull(), "guided_bilateral", vec("g")), (F.col("ox").isNotNull(), "robust_feature", vec("o"))]
    source, chosen = F.lit("shape_patch_mean" if "shape" in parts else "primary_cluster_mean"), one
    for when, name, v in reversed(ways):
        source, chosen = F.when(when, name).otherwise(source), tuple(F.when(when, a).otherwise(b) for a, b in zip(v, chosen, strict=True))
    rows = rows.withColumns({f"e{a}": c for a, c in zip("xyz", unit(tuple(F.coalesce(c, F.lit(0.0)) for c in chosen)), strict=True)})
    rows = rows.withColumn("source", source).withColumn("degenerate", F.col("ex").isNull())
    rows = rows.withColumn("reasons", confidence(rows, config))
    counted = [F.col("primary.support").alias("support1"), F.col("secondary.support").alias("support2"), "support_ratio", F.col("faces").alias("patch_faces"), F.col("valid").alias("patch_valid")]
    high = F.when(F.size(F.array_remove("reasons", "degenerate_normal")) == 0, "high").otherwise("low").alias("confidence")
    return rows.select("point_index", *[F.coalesce(f"e{a}", F.lit(1.0 if a == "z" else 0.0)).alias(f"n{a}") for a in "xyz"], "source", high, "reasons", "angle12", *counted, "patch_scale", "patch_radius", "fit_valid", "residual", "condition")
