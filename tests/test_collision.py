"""Shapes, contacts and checks against clipping and sampling in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import shapes
from facetry.functions.vec import vec
from facetry.operators import collision

R, W = 0.3, 0.2


def _table(spark, columns, rows):
    return spark.createDataFrame([tuple(float(x) for x in r) for r in rows], ", ".join(f"{c} double" for c in columns))


def _columns(*names):
    return [f"{n}{a}" for n in names for a in "xyz"]


def test_nearest_points(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(60, 15))
    rows[5, 9:12] = rows[5, 6:9]  # a triangle that is a segment
    rows[6, 3:6] = rows[6, 0:3]  # a segment without length
    df = _table(spark, _columns("p", "q", "a", "b", "c"), rows)
    p, q, a, b, c = (vec(n) for n in "pqabc")
    out = df.select(shapes.on_triangle(p, a, b, c).alias("t"), shapes.between_segments(p, q, a, b).alias("s"), shapes.segment_and_triangle(p, q, a, b, c).alias("st")).collect()
    grid = np.array([(i, j) for i in range(41) for j in range(41 - i)]) / 40
    line = np.linspace(0, 1, 201)[:, None]
    for r, got in zip(rows, out, strict=True):
        p, q, a, b, c = r.reshape(5, 3)
        tri = a + grid[:, :1] * (b - a) + grid[:, 1:] * (c - a)
        seg = p + line * (q - p)
        other = a + line * (b - a)
        t = got.t
        at = t.wa * a + t.wb * b + t.wc * c
        assert np.allclose(at, [t.x, t.y, t.z]) and min(t.wa, t.wb, t.wc) >= -1e-12 and abs(t.wa + t.wb + t.wc - 1) < 1e-12
        low = np.linalg.norm(tri - p, axis=1).min()
        assert low - 0.1 <= np.linalg.norm(at - p) <= low + 1e-9 and abs(np.linalg.norm(at - p) - t.distance) < 1e-9
        for s, ones in ((got.s, other), (got.st, tri)):
            d = np.linalg.norm(ones[:, None] - seg[None], axis=2).min()
            assert d - 0.12 <= s.distance <= d + 1e-9
    assert abs(out[6].s.distance - np.linalg.norm(np.array([out[6].s.ox, out[6].s.oy, out[6].s.oz]) - rows[6, :3])) < 1e-9


def test_cylinder_scalars(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(40, 9))
    rows[:, 6:9] /= np.linalg.norm(rows[:, 6:9], axis=1)[:, None]
    rows[0, 0:3] = rows[0, 3:6] + 0.05 * rows[0, 6:9]
    df = _table(spark, _columns("p", "c", "a"), rows)
    low, high = shapes.cylinder_box(vec("c"), vec("a"), F.lit(R), F.lit(W))
    moved = shapes.to_cylinder(vec("p"), vec("c"), vec("a"), F.lit(R), F.lit(W))
    got = df.select(F.array(*low), F.array(*high), F.array(*moved), shapes.depth_in_cylinder(vec("p"), vec("c"), vec("a"), F.lit(R), F.lit(W))).collect()
    for r, (lo, hi, at, depth) in zip(rows, got, strict=True):
        p, c, a = r.reshape(3, 3)
        u = np.cross(a, [1, 0, 0] if abs(a[0]) < 0.9 else [0, 1, 0])
        u /= np.linalg.norm(u)
        turn = np.linspace(0, 2 * np.pi, 2000)[:, None]
        rim = R * (np.cos(turn) * u + np.sin(turn) * np.cross(a, u))
        rim = np.concatenate([c + rim + W / 2 * a, c + rim - W / 2 * a])
        assert np.allclose(rim.min(0), lo, atol=1e-5) and np.allclose(rim.max(0), hi, atol=1e-5)
        z, out = (p - c) @ a, np.linalg.norm((p - c) - ((p - c) @ a) * a)
        assert depth == pytest.approx(max(0.0, min(R - out, W / 2 - abs(z))))
        rel = np.array(at) - c
        assert abs(rel @ a - np.clip(z, -W / 2, W / 2)) < 1e-9 and (out <= 1e-12 or abs(np.linalg.norm(rel - (rel @ a) * a) - R) < 1e-9)
    ring = _table(spark, _columns("e", "t", "q"), [(0, 1, 0, 1, 0, 0, 0, 1, 0), (1, -1e-12, 0, 1, 0, 0, 0, 1, 0), (0, -1, 0, 1, 0, 0, 0, 1, 0)])
    assert [r[0] for r in ring.select(F.round(shapes.ring_angle(vec("e"), vec("t"), vec("q")), 6)).collect()] == [90.0, 0.0, 270.0]


def test_polygons(spark):
    square = [(1.0, 1.0), (3.0, 1.0), (3.0, -1.0), (1.0, -1.0)]
    around = [(u - 2, v) for u, v in square]
    df = spark.createDataFrame([(square,), (around,), (square[:2],)], "corners array<struct<u:double,v:double>>")
    got = df.select(shapes.in_convex_polygon(F.col("corners")).alias("inside"), shapes.nearest_of_polygon(F.col("corners")).alias("n")).collect()
    assert [r.inside for r in got[:2]] == [False, True]
    assert [(r.n.square, r.n.u, r.n.v) for r in got] == [(1.0, 1.0, 0.0), (0.0, 0.0, 0.0), (2.0, 1.0, 1.0)]


def _clipped(tri, half):
    poly = [np.array(p) for p in tri]
    for sign in (1, -1):
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1]):
            one, two = half - sign * p[2], half - sign * q[2]
            if one >= 0:
                out.append(p)
            if (one >= 0) != (two >= 0):
                out.append(p + one / (one - two) * (q - p))
        poly = out
    return poly


def _slow_contact(tri, target, r, w):
    """Of corners and target in the tool's frame: hit, axial, radial, patch."""
    poly = _clipped(tri, w / 2 + 1e-10)
    if not poly:
        return False, 0, 0, 0
    flat = [p[:2] for p in poly]
    sides = list(zip(flat, flat[1:] + flat[:1]))
    crosses = [p[0] * q[1] - p[1] * q[0] for p, q in sides]
    near, patch = 1e9, []
    for (p, q), a, b in zip(sides, poly, poly[1:] + poly[:1]):
        d = q - p
        t = np.clip(-(p @ d) / (d @ d), 0, 1) if d @ d > 1e-24 else 0.0
        near = min(near, np.linalg.norm(p + t * d))
        if np.linalg.norm(p) <= r:
            patch.append(a)
        for root in np.roots([d @ d, 2 * p @ d, p @ p - r * r]) if d @ d > 1e-24 else ():
            if abs(root.imag) < 1e-12 and 0 <= root.real <= 1:
                patch.append(a + root.real * (b - a))
    if len(poly) > 2 and (min(crosses) >= 0 or max(crosses) <= 0):
        near = 0.0
    if near > r:
        return False, 0, 0, 0
    return True, max(0.0, max(p[2] for p in poly) + w / 2), r - near, max((np.linalg.norm(p - target) for p in patch), default=None)


def _poses(spark, centers, axes, targets, rho=R):
    rows = [(i, 0, rho, *map(float, (*c, *a, *t))) for i, (c, a, t) in enumerate(zip(centers, axes, targets, strict=True))]
    return spark.createDataFrame(rows, "point_index long, candidate_index long, rho double, " + ", ".join(f"{c} double" for c in ["x", "y", "z", *_columns("a", "p")]))


def _triangles(spark, tris):
    return spark.createDataFrame([(i, *map(float, np.ravel(t))) for i, t in enumerate(tris)], "face_id long, " + ", ".join(f"{c} double" for c in _columns("a", "b", "c")))


def test_cylinder_contacts_and_disks(spark):
    rng = np.random.default_rng(3)
    tris = rng.uniform(-0.6, 0.6, size=(40, 1, 3)) + rng.normal(scale=0.3, size=(40, 3, 3))
    centers, axes = rng.uniform(-0.3, 0.3, size=(12, 3)), rng.normal(size=(12, 3))
    axes /= np.linalg.norm(axes, axis=1)[:, None]
    targets = centers + 0.1
    poses, mesh = _poses(spark, centers, axes, targets), _triangles(spark, tris)
    got = {(r.point_index, r.face_id): r for r in collision.cylinder_contacts(collision.cylinder_pairs(poses, mesh, R, W), R, W).collect()}
    disks = {(r.point_index, r.face_id): r for r in collision.disk_contacts(collision.disk_pairs(poses, mesh, R)).collect()}
    hits = 0
    for i, (c, a, t) in enumerate(zip(centers, axes, targets, strict=True)):
        u = np.cross(a, [1, 0, 0] if abs(a[0]) < 0.9 else [0, 1, 0])
        u /= np.linalg.norm(u)
        frame = np.stack([u, np.cross(a, u), a])
        for k, tri in enumerate(tris):
            local, target = (tri - c) @ frame.T, frame @ (t - c)
            hit, axial, radial, patch = _slow_contact(local, target, R, W)
            r = got.get((i, k))
            assert bool(r and r.hit) == hit
            if hit:
                hits += 1
                assert (r.axial, r.radial) == pytest.approx((axial, radial), abs=1e-8)
                assert r.penetration == pytest.approx(min(axial, radial), abs=1e-8)
                if patch is not None:
                    assert r.patch == pytest.approx(patch, abs=1e-7)
                assert r.mx**2 + r.my**2 + r.mz**2 == pytest.approx(1.0)
            crossing = [p + p[2] / (p[2] - q[2]) * (q - p) for p, q in zip(local, np.roll(local, -1, axis=0)) if (p[2] > 0) != (q[2] > 0)]
            near = 1e9
            if crossing:
                p, d = crossing[0][:2], crossing[1][:2] - crossing[0][:2]
                near = np.linalg.norm(p + np.clip(-(p @ d) / (d @ d), 0, 1) * d)
            r = disks.get((i, k))
            assert bool(r and r.hit) == (near <= R)
    assert hits > 40


#: corners around a cylinder of radius 1 and width 0.4 at the origin, along z
CASES = [
    ([(-2, -2, 0), (2, -2, 0), (0, 2, 0)], 0.0, True, "triangle_interior_collision"),
    ([(1, -2, -0.1), (1, 2, -0.1), (1, 0, 0.1)], 0.0, True, "cylinder_side_collision"),
    ([(-0.1, -0.2, 0.2), (0.3, -0.2, 0.2), (0, 0.2, 0.2)], 0.0, True, "cylinder_cap_collision"),
    ([(1, 0, 0.2), (1.3, 0, 0.2), (1, 0.3, 0.2)], 0.0, True, "cylinder_edge_collision"),
    ([(0.1, 0, -0.1), (0.3, 0, 0.1), (0, 0.3, 0)], 0.8, False, "inside_inner_contact_void"),
    ([(0.86, -0.05, -0.1), (0.94, 0.05, 0.1), (0.9, 0, 0)], 0.8, True, "triangle_interior_collision"),
    ([(0.6, 0, 0), (1, 0, 0), (0.8, 0.05, 0)], 0.8, True, "cylinder_side_collision"),
    ([(0, 0, 0.5), (1, 0, 0.5), (0, 1, 0.6)], 0.0, False, "separated_by_cylinder_caps"),
    ([(0.9, 0.9, 0), (2, 1, 0), (1, 2, 0.1)], 0.0, False, "separated_by_cylinder_side"),
]


@pytest.mark.parametrize("inner", [0.0, 0.8])
def test_kinds(spark, inner):
    cases = [c for c in CASES if c[1] == inner]
    poses, mesh = _poses(spark, [(0, 0, 0)], [(0, 0, 1)], [(0, 0, 0)]), _triangles(spark, [c[0] for c in cases])
    pairs = collision._corners(poses.crossJoin(mesh.select("face_id")), mesh)
    got = {r.face_id: (r.hit, r.kind) for r in collision.cylinder_contacts(pairs, 1.0, 0.4, inner).collect()}
    assert got == {i: c[2:] for i, c in enumerate(cases)}


def _box(size):
    """Two triangles a side of a cube around the origin."""
    tris = []
    for axis in range(3):
        for sign in (-1, 1):
            corner = []
            for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
                p = [0.0, 0.0, 0.0]
                p[axis], p[(axis + 1) % 3], p[(axis + 2) % 3] = sign * size, u * size, v * size
                corner.append(p)
            tris += [(corner[0], corner[1], corner[2]), (corner[0], corner[2], corner[3])]
    return tris


def test_checkers(spark):
    mesh = _triangles(spark, _box(2.0))
    # inside, far outside, along a face, lying on a face with the near cap
    centers, axes = [(0.1, 0.2, 0.05), (9, 9, 9), (2, 0.1, 0.3), (0.2, 0.1, 2.1)], [(0, 0, 1)] * 4
    targets = [(0, 0, 0), (9, 9, 9), (2, 0, 0), (0.2, 0.1, 2.0)]
    poses = _poses(spark, centers, axes, targets)
    closed = {r.point_index: r for r in collision.check_cylinders(poses, mesh, R, W, True).collect()}
    assert [closed[i].feasible for i in range(4)] == [False, True, False, False]
    assert [closed[i].reason for i in range(3)] == ["workpiece_contains_wheel", "safe", "cylinder_cap_collision"]
    opened = {r.point_index: r for r in collision.check_cylinders(poses, mesh, R, W, False, target_contact=True, max_penetration=1e-6).collect()}
    assert [opened[i].reason for i in (0, 1)] == ["safe_surface_only_non_closed_mesh"] * 2 and not opened[2].feasible
    patch = {r.point_index: r for r in collision.check_cylinders(poses, mesh, R, W, True, contact_patch=True, max_penetration=1e-6).collect()}
    assert patch[3].feasible and patch[3].reason == "contact_patch_only" and patch[3].contact_faces >= 1
    disks = {r.point_index: r for r in collision.check_disks(poses, mesh, R, True).collect()}
    assert [disks[i].reason for i in range(4)] == ["disk_center_inside_closed_workpiece", "safe", "triangle_disk_segment_plane_intersection", "safe"]
    flat = _poses(spark, [(0.2, 0.1, 2.0)], [(0, 0, 1)], [(0.2, 0.1, 2.0)])
    assert collision.check_disks(flat, mesh, R, True).first().reason == "triangle_disk_coplanar_triangle"
    # the target lies in one triangle of the face; the disk meets the other at the diagonal, 0.07 away, which rejects
    assert collision.check_disks(flat, mesh, R, True, target_contact=True).first().reason == "triangle_disk_coplanar_triangle"
    diagonal = _poses(spark, [(0.1, 0.1, 2.0)], [(0, 0, 1)], [(0.1, 0.1, 2.0)])
    assert collision.check_disks(diagonal, mesh, R, True, target_contact=True).first().reason == "target_contact_only"
    with pytest.raises(ValueError):
        collision.check_cylinders(poses, mesh, R, 0.0, True)


def test_containment_of_many_points(spark):
    rng = np.random.default_rng(4)
    points = rng.uniform(-3, 3, size=(200, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")
    got = {r.id: r.inside for r in collision.containment(df, _triangles(spark, _box(2.0)), ["id"]).collect()}
    assert got == {i: bool((np.abs(p) < 2).all()) for i, p in enumerate(points)}
