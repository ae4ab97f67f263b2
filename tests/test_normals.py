"""Surface normals on planes, edges, cylinders and wound meshes; folds and fits against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import bisectors, normals, patches

CONFIG = normals.Config(radius=0.25)


def _mesh(spark, vertices, faces):
    f = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(faces)], "face_id long, v0 long, v1 long, v2 long")
    v = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(vertices)], "vertex_id long, x double, y double, z double")
    return f, v


def _grid(n, place):
    """Two triangles a cell of an n x n grid."""
    vertices = [place(i / n, j / n) for j in range(n + 1) for i in range(n + 1)]
    at = lambda i, j: j * (n + 1) + i
    return vertices, [t for j in range(n) for i in range(n) for t in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1)))]


def _points(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "point_index long, x double, y double, z double")


def _turn(a, b):
    return math.degrees(math.acos(max(-1, min(1, float(np.dot(a, b))))))


@pytest.mark.parametrize("method", ["p1", "li+zhong", "zhang+cazals"])
def test_plane(spark, method):
    vertices, faces = _grid(8, lambda x, y: (x, y, 0.0))
    mesh, _ = normals.prepared(*_mesh(spark, vertices, faces))
    got = normals.estimate(_points(spark, [(0.4, 0.4, 0.0), (0.55, 0.5, 0.01)]), mesh, method, CONFIG).collect()
    assert len(got) == 2 and all(_turn((r.nx, r.ny, r.nz), (0, 0, 1)) < 2 and abs(math.hypot(r.nx, r.ny, r.nz) - 1) < 1e-9 for r in got)
    if method == "p1":
        assert {r.source for r in got} == {"jet_fit"} and all(r.residual < 1e-6 and r.confidence == "high" for r in got)


def test_open_cylinder(spark):
    n = 24
    ring = [(0.5 * math.cos(2 * math.pi * k / n), 0.5 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    vertices = [(*p, z) for z in (-0.5, 0.5) for p in ring]
    faces = [t for k in range(n) for t in ((k, (k + 1) % n, n + k), ((k + 1) % n, n + (k + 1) % n, n + k))]
    mesh, report = normals.prepared(*_mesh(spark, vertices, faces))
    assert report.first().conflicts == 0 and not report.first().turned
    angles = [2 * math.pi * k / 12 for k in range(12)]
    points = _points(spark, [(0.5 * math.cos(a), 0.5 * math.sin(a), 0.1) for a in angles])
    got = {r.point_index: r for r in normals.estimate(points, mesh, "p1", normals.Config()).collect()}
    off = [_turn((got[i].nx, got[i].ny, got[i].nz), (math.cos(a), math.sin(a), 0)) for i, a in enumerate(angles)]
    assert np.median(np.minimum(off, 180 - np.array(off))) < 10


@pytest.mark.parametrize("method", ["zhong2021", "zhang2015", "li2010", "cazals2005", "p1", "all"])
def test_edge(spark, method):
    flat, faces = _grid(8, lambda x, y: (x, y, 0.0))
    wall, _ = _grid(8, lambda x, y: (x, 0.0, y))
    vertices = [*flat, *wall]
    mesh, _ = normals.prepared(*_mesh(spark, vertices, [*faces, *[tuple(v + len(flat) for v in f) for f in faces]]))
    got = normals.estimate(_points(spark, [(0.5, 0.0, 0.0), (0.5, 0.9, 0.0)]), mesh, method, CONFIG).orderBy("point_index").collect()
    assert all(abs(math.hypot(r.nx, r.ny, r.nz) - 1) < 1e-9 for r in got)
    assert abs(got[1].nz) > 0.999
    if method == "zhang2015":
        assert got[0].source == "two_side_bisector" and abs(abs(got[0].ny) - math.sqrt(0.5)) < 1e-6 and got[0].confidence == "high"
    if method == "cazals2005":
        assert "secondary_surface_ignored" in got[0].reasons


def test_winding(spark):
    vertices, faces = _grid(6, lambda x, y: (x, y, 0.1 * x * y))
    turned = [f if i % 3 else (f[0], f[2], f[1]) for i, f in enumerate(faces)]
    mesh, report = normals.prepared(*_mesh(spark, vertices, turned))
    rows = {r.face_id: r for r in mesh.collect()}
    flips = {i for i, r in rows.items() if r.flipped}
    assert flips in ({i for i in range(72) if i % 3}, {i for i in range(72) if i % 3 == 0})
    assert len({r.nz > 0 for r in rows.values()}) == 1
    one = report.first()
    assert (one.components, one.conflicts, one.crowded_edges) == (1, 0, 0) and one.volume >= 0
    # a box of two shells, the inner one apart; volume turns it outwards
    cube = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    sides = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    tris = [t for a, b, c, d in sides for t in ((a, c, b), (a, d, c))]
    mesh, report = normals.prepared(*_mesh(spark, cube, tris))
    assert abs(report.first().volume - 1) < 1e-12
    for r in mesh.collect():
        middle = np.mean([[r.ax, r.ay, r.az], [r.bx, r.by, r.bz], [r.cx, r.cy, r.cz]], axis=0) - 0.5
        assert middle @ [r.nx, r.ny, r.nz] > 0.3


def test_moebius_band(spark):
    """No flips make a Moebius band agree: one conflict, and its windings stay; the plain strip beside it is repaired."""
    n = 9
    vertices = [((1 + w * math.cos(a / 2)) * math.cos(a), (1 + w * math.cos(a / 2)) * math.sin(a), w * math.sin(a / 2)) for a in (2 * math.pi * k / n for k in range(n)) for w in (-0.3, 0.3)]
    faces = []
    for k in range(n):
        a, b, c, d = 2 * k, 2 * k + 1, (2 * k + 2) % (2 * n), (2 * k + 3) % (2 * n)
        c, d = (d, c) if k == n - 1 else (c, d)
        faces += [(a, b, c), (b, d, c)]
    base = len(vertices)
    vertices += [(5.0 + x, y, 0.0) for x in (0, 1) for y in (0, 1)]
    faces += [(base, base + 2, base + 1), (base + 1, base + 2, base + 3), (0, 0, 1)]
    f, v = _mesh(spark, vertices, faces)
    rows = {r.face_id: r for r in normals.winding(f.where("face_id < 20")).collect()}
    assert all(not rows[i].orientable and not rows[i].flip and rows[i].component == 0 for i in range(2 * n))
    assert rows[18].orientable and not rows[18].flip and not rows[19].flip and rows[19].component == 18
    mesh, report = normals.prepared(f, v)
    one = report.first()
    assert (one.components, one.conflicts) == (2, 1) and mesh.count() == 20


def _plain_clusters(ns, cosine):
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-12 else v * 0
    clusters = []
    for i, n in enumerate(ns):
        best, most = None, -2.0
        for c in clusters:
            d = float(n @ c["mean"])
            if d >= cosine and d > most:
                best, most = c, d
        if best is None:
            clusters.append({"of": [i], "sum": n.copy(), "mean": n.copy()})
        else:
            best["of"].append(i)
            best["sum"] = best["sum"] + n
            best["mean"] = unit(best["sum"])
    again = True
    while again:
        again = False
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                if not again and clusters[a]["mean"] @ clusters[b]["mean"] >= cosine:
                    clusters[a]["of"] += clusters[b]["of"]
                    clusters[a]["sum"] = clusters[a]["sum"] + clusters[b]["sum"]
                    clusters[a]["mean"] = unit(clusters[a]["sum"])
                    del clusters[b]
                    again = True
                    break
            if again:
                break
    label = [0] * len(ns)
    for k, c in enumerate(clusters):
        for i in c["of"]:
            label[i] = k
    return label


@pytest.mark.parametrize("seed", range(6))
def test_greedy_clusters(seed):
    rng = np.random.default_rng(seed)
    ns = rng.normal(size=(4, 3))[rng.integers(0, 4, 96)] + rng.choice([0.05, 0.3, 0.8]) * rng.normal(size=(96, 3))
    ns /= np.linalg.norm(ns, axis=1)[:, None]
    assert normals.greedy(ns, math.cos(math.radians(15))) == _plain_clusters(ns, math.cos(math.radians(15)))


def test_hull():
    area, inside = normals.hull(np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)]) - 0.5)
    assert abs(area - 4) < 1e-12 and inside
    assert normals.hull(np.array([(1.0, 1), (2, 1), (2, 2)]))[1] is False
    assert normals.hull(np.array([(0.0, 0), (1, 1), (2, 2), (3, 3)])) == (0.0, False)


def test_jet_against_least_squares(spark):
    rng = np.random.default_rng(3)
    vertices, faces = _grid(9, lambda x, y: (x, y, 0.3 * x * x - 0.2 * x * y + 0.1 * y + 0.004 * rng.normal()))
    mesh, _ = normals.prepared(*_mesh(spark, vertices, faces))
    points = _points(spark, [(0.5, 0.5, 0.08), (0.3, 0.6, 0.05)])
    members = normals._written(normals.neighbourhoods(points, mesh, CONFIG))
    tagged = normals._written(normals.clustered(members, 40.0, 2))
    stats = normals.patch_stats(tagged, points, mesh)
    got = {r.point_index: r for r in normals.jet_fits(tagged, stats, points, mesh, CONFIG).collect()}
    area = {r.face_id: r.area for r in mesh.collect()}
    primary = {r.point_index: np.array([r.primary.cx, r.primary.cy, r.primary.cz]) for r in stats.collect()}
    v = np.array(vertices)
    for p in points.collect():
        weight = {}
        for m in members.where(F.col("point_index") == p.point_index).collect():
            for k in faces[m.face_id]:
                weight[k] = weight.get(k, 0) + area[m.face_id] / max(m.distance, 1e-6)
        keys = sorted(weight)
        w = np.array([weight[k] for k in keys])
        w /= w.sum()
        c = v[keys] - [p.x, p.y, p.z]
        _, vectors = np.linalg.eigh((c * w[:, None]).T @ c)
        n = vectors[:, 0] * (1 if vectors[:, 0] @ primary[p.point_index] >= 0 else -1)
        u, q = vectors[:, 2], np.cross(n, vectors[:, 2])
        x, y, h = c @ u, c @ q, c @ n
        a = np.column_stack([x * x, x * y, y * y, x, y, np.ones_like(x)]) * np.sqrt(w)[:, None]
        fit, *_ = np.linalg.lstsq(a, h * np.sqrt(w), rcond=None)
        s = np.linalg.svd(a, compute_uv=False)
        want = n - fit[3] * u - fit[4] * q
        r = got[p.point_index]
        assert _turn(want / np.linalg.norm(want), (r.fx, r.fy, r.fz)) < 1e-4
        assert abs(r.residual - np.linalg.norm(a @ fit - h * np.sqrt(w))) < 1e-8 and abs(r.condition / (s[0] / s[-1]) - 1) < 1e-6
        assert r.fit_vertices == len(keys) and r.root_inside and r.fit_rank == 6


def test_few_faces_give_no_fit(spark):
    mesh, _ = normals.prepared(*_mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)]))
    got = normals.estimate(_points(spark, [(0.2, 0.2, 0.0)]), mesh, "p1", CONFIG).first()
    assert abs(got.nz) == 1 and not got.patch_valid and "invalid_patch" in got.reasons and got.confidence == "low"
    with pytest.raises(ValueError):
        normals.estimate(_points(spark, []), mesh, "unknown")
    assert normals.estimate(_points(spark, []), mesh, "p1", CONFIG).count() == 0


def test_two_side_bisectors(spark):
    """The line where a floor meets a wall; with flash points between them, and by the mesh's centre."""
    flat, faces = _grid(6, lambda x, y: (x, y, 0.0))
    wall, _ = _grid(6, lambda x, y: (x, 0.0, y))
    f, v = _mesh(spark, [*flat, *wall], [*faces, *[tuple(k + len(flat) for k in t) for t in faces]])
    tris = normals.gathered(f, v)
    curve = _points(spark, [(0.5, 0.0, 0.0), (0.7, 0.0, 0.0)]).withColumns({"tx": F.lit(1.0), "ty": F.lit(0.0), "tz": F.lit(0.0)})
    flash = spark.createDataFrame([(0, 0.5, 0.3, 0.3)], "point_id long, qx double, qy double, qz double")
    config = bisectors.Sides(faces=48)
    for more, sign in (({"flash": flash}, 1), ({"center": (0.5, 1.0, 1.0)}, -1)):
        for r in bisectors.two_side_bisectors(curve, tris, config, **more).collect():
            assert r.sides == 2 and r.by == "projected_offset" and np.allclose([r.nx, r.ny, r.nz], [0, sign * math.sqrt(0.5), sign * math.sqrt(0.5)], atol=1e-9)
    with pytest.raises(ValueError):
        bisectors.two_side_bisectors(curve, tris, config)
    with pytest.raises(ValueError):
        bisectors.Sides(degrees=90.0)


def test_methods_of_surface_normals(spark):
    """Every kind of method on a plane; windings differ, jumps are mended, unknown names refused."""
    vertices, faces = _grid(6, lambda x, y: (x, y, 0.0))
    f, v = _mesh(spark, vertices, [t if i % 3 else (t[0], t[2], t[1]) for i, t in enumerate(faces)])
    places = [(0.2 + 0.1 * k, 0.5, 0.0) for k in range(5)]
    curve = _points(spark, places).withColumns({"branch_id": F.lit(0), "seq": F.col("point_index"), "tx": F.lit(1.0), "ty": F.lit(0.0), "tz": F.lit(0.0)})
    flash = spark.createDataFrame([(0, 0.5, 0.5, 1.0)], "point_id long, qx double, qy double, qz double")
    for method in ("zhong2021", "surface_patch_continuity", "two_face_angle_bisector"):
        got = patches.surface_normals(curve, f, v, method, flash=flash, config=CONFIG, patch=patches.Patch(radius=0.3), sides=bisectors.Sides(faces=24)).collect()
        assert len(got) == 5 and all(abs(abs(r.nz) - 1) < 1e-9 for r in got)
        if method == "two_face_angle_bisector":
            assert all(r.nz > 0 for r in got)
    with pytest.raises(ValueError, match="unknown method"):
        patches.surface_normals(curve, f, v, "none")


def test_adaptive_patch(spark):
    """Distances 0.01, 0.02 and so on: three times the nearest, filled up to the least number, within the radius."""
    near = spark.createDataFrame([(0, k, 0.01 * k) for k in range(1, 9)] + [(1, k, 0.5 + k) for k in range(1, 9)], "point_index long, rank long, distance double")
    kept = lambda **c: {p: sorted(r["rank"] for r in patches.adaptive(near, patches.Patch(**c)).collect() if r.point_index == p) for p in (0, 1)}
    assert kept(least=2, radius=0.1) == {0: [1, 2, 3], 1: [1]}
    assert kept(least=5, radius=0.1) == {0: [1, 2, 3, 4, 5], 1: [1]}
    assert kept(least=5, radius=0.04) == {0: [1, 2, 3, 4], 1: [1]}
    low = {r.point_index: r.low_support for r in patches.adaptive(near, patches.Patch(least=5, radius=0.1)).collect()}
    assert low == {0: False, 1: True}
