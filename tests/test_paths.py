"""Block-wise shortest ways against a dynamic programme in Python, and whole queries against the thinned ones."""

import random
from math import dist

import pytest
from facetry.operators import paths
from facetry.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("block", [2, 64])
def test_chosen_way_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(paths, "BLOCK", block)
    rnd = random.Random(5)
    rows, want = [], {}
    for branch, many in ((0, 13), (1, 1), (2, 70)):
        layers = [(2 * s + 1, sorted((i, *(rnd.random() for _ in "xyz")) for i in rnd.sample(range(24), rnd.randrange(1, 5)))) for s in range(many)]
        rows += [(branch, -1, s, *n) for s, layer in layers for n in layer]
        best = {n: (0.0, [n[0]]) for n in layers[0][1]}
        for _, layer in layers[1:]:
            best = {n: min((c + dist(m[1:], n[1:]), [*w, n[0]]) for m, (c, w) in best.items()) for n in layer}
        want[branch] = min(best.values())
    nodes = spark.createDataFrame(rows, "branch_id int, lateral_side int, seq long, candidate_index long, x double, y double, z double")
    got = paths.chosen(nodes).orderBy("branch_id", "seq").collect()
    for branch, (cost, way) in want.items():
        mine = [r for r in got if r.branch_id == branch]
        assert [r.candidate_index for r in mine] == way
        assert all(abs(r.cost - cost) < 1e-9 and r.layers == len(way) for r in mine)


def test_whole_path_queries_keep_all_feasible_poses():
    for name in ("feasible_path", "feasible_path_metrics"):
        assert name in QUERIES and "% 3" not in ORACLES[name] and "feasible" in ORACLES[name]


NODES = "branch_id int, lateral_side int, seq long, candidate_index long, x double, y double, z double"


def test_a_point_without_node_refuses_its_side(spark):
    points = spark.createDataFrame([(10 + s, 0, s) for s in range(1, 4)], "point_index long, branch_id int, seq long")
    rows = [(0, 1, s, c, float(s), float(c), 0.0) for s in range(1, 4) for c in range(2)] + [(0, -1, 1, 0, 0.0, 0.0, 0.0), (0, -1, 3, 0, 9.0, 0.0, 0.0)]
    nodes = spark.createDataFrame(rows, NODES)
    got = {r.lateral_side: r for r in paths.planned(points, nodes).collect()}
    assert (got[1].status, got[1].missing, got[1].cost) == ("ok", 0, 2.0)
    assert (got[-1].status, got[-1].missing, got[-1].cost) == ("no_path", 1, None)
    layers = {(r.lateral_side, r.point_index): r.nodes for r in paths.side_layers(points, nodes).collect()}
    assert layers == {(1, 11): 2, (1, 12): 2, (1, 13): 2, (-1, 11): 1, (-1, 12): 0, (-1, 13): 1}


def _slow_covering(arc, layers, half):
    """Least cost of a covering way, by trying all predecessors; layers: lists of (candidate, place)."""
    total, n = arc[-1], len(arc)
    slack = 1e-9 * max(1.0, total)
    missing = [i for i in range(n) if not layers[i]]
    left, right = [], []
    for i, s in enumerate(arc):
        low = max((m for m in missing if m <= i), default=None)
        high = min((m for m in missing if m >= i), default=None)
        left.append(max(s - half, 0.0 if low is None else (arc[low] + arc[low + 1]) / 2 if low + 1 < n else arc[low]))
        right.append(min(s + half, total if high is None else (arc[high] + arc[high - 1]) / 2 if high else arc[high]))
    best = {}
    for i in range(n):
        for c, at in layers[i]:
            if left[i] > right[i] + slack:
                continue
            ways = [0.0] if left[i] <= slack else []
            for (k, d), (cost, place) in best.items():
                if k < i and arc[i] - arc[k] <= 2 * half + slack and left[i] <= right[k] + slack and right[i] > right[k] + slack:
                    ways.append(cost + dist(place, at))
            if ways:
                best[i, c] = min(ways), at
    return min((cost for (i, _), (cost, _) in best.items() if right[i] >= total - slack), default=None)


@pytest.mark.parametrize("gap", [0.0, 0.12])
def test_covering_ways(spark, gap):
    rnd = random.Random(int(gap * 100) + 1)
    points, nodes, want = [], [], {}
    for branch, many in ((0, 40), (1, 12), (2, 3)):
        arc, at = [], 0.0
        for _ in range(many):
            arc.append(at)
            at += rnd.uniform(0.02, 0.2)
        for side in (1, -1):
            layers = [[] if rnd.random() < gap else [(c, tuple(rnd.random() for _ in "xyz")) for c in sorted(rnd.sample(range(12), 3))] for _ in arc]
            want[branch, side] = _slow_covering(arc, layers, 0.25)
            nodes += [(branch, side, s, c, *place) for s, layer in enumerate(layers) for c, place in layer]
        points += [(100 * branch + s, branch, s, a) for s, a in enumerate(arc)]
    curve = spark.createDataFrame(points, "point_index long, branch_id int, seq long, arc_length double")
    way = paths.covering(curve, spark.createDataFrame(nodes, NODES), 0.25)
    got = {(r.branch_id, r.lateral_side): r for r in paths.covered(curve, way).collect()}
    assert {k: r.status for k, r in got.items()} == {k: "no_path" if c is None else "ok" for k, c in want.items()}
    place = {(b, s, q, c): p for b, s, q, c, *p in nodes}
    for key, cost in want.items():
        if cost is None:
            assert got[key].chosen == 0 and not got[key].union_ok
            continue
        rows = sorted((r for r in way.collect() if (r.branch_id, r.lateral_side) == key), key=lambda r: r.seq)
        ats = [place[(*key, r.seq, r.candidate_index)] for r in rows]
        assert got[key].cost == pytest.approx(cost) == sum(dist(a, b) for a, b in zip(ats, ats[1:]))
        assert got[key].union_ok and got[key].chosen == len(rows)
    assert any(c is not None for c in want.values())
