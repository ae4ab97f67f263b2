"""Paths through feasible poses: continuous side signs, layered shortest paths, coverage paths, metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.vec import angle, dot, unit, vec
from .curves import _written as shared

#: Layers of one block, and blocks of one block of the next round.
BLOCK = 64
_UNIT = "branch_id int, lateral_side int, block long, layers long, head binary, tail binary, costs binary"


def _branch() -> WindowSpec:
    return Window.partitionBy("branch_id").orderBy("seq")


def _so_far() -> WindowSpec:
    return _branch().rowsBetween(Window.unboundedPreceding, 0)


def side_signs(framed: DataFrame) -> DataFrame:
    """framed with sign: q is flipped where it opposes the (flipped) q before it. The sign is the parity of negative
    products since the last zero product, which starts anew with +1."""
    before = dot(vec("q"), tuple(F.lag(f"q{a}").over(_branch()) for a in "xyz"))
    rows = framed.withColumn("product", before).withColumn("part", F.count_if(F.col("product") == 0).over(_so_far()))
    along = Window.partitionBy("branch_id", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # the first row of a part has no product with it
    odd = F.count_if(F.col("product") < 0).over(along) % 2
    return rows.select(*framed.columns, F.when(odd == 1, -1).otherwise(1).alias("sign"))


def sides(poses: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """poses (with sign) and lateral_side: +1 or -1 by the direction along the signed q, 0 on the midline."""
    along = dot(vec("e"), vec("q")) * F.col("sign")
    return poses.withColumn("lateral_side", F.when(along > tolerance, 1).when(along < -tolerance, -1).otherwise(0))


def layered(nodes: DataFrame) -> DataFrame:
    """The shortest way that takes one node of every layer, for each branch and side: nodes has branch_id,
    lateral_side, seq, candidate_index, x, y, z. Returns cost, layers and the chosen candidates; of equal costs the
    lowest candidate wins. Only the ids of the way are collected; `chosen` gives it as rows."""
    way = F.transform(F.array_sort(F.collect_list(F.struct("seq", "candidate_index"))), lambda n: n["candidate_index"])
    return chosen(nodes).groupBy("branch_id", "lateral_side").agg(F.first("layers").alias("layers"), F.first("cost").alias("cost"), way.alias("way"))


class _Unit:
    """A stretch of layers: the nodes of its first and of its last layer (rows of candidate_index, x, y, z and more) and
    the least cost of a way between each of the ones and each of the others."""

    def __init__(self, head: np.ndarray, tail: np.ndarray, costs: np.ndarray):
        self.head, self.tail, self.costs = head, tail, costs


Steps = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _steps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cost of a step from each of the nodes a to each of b."""
    d = a[:, None, 1:4] - b[None, :, 1:4]
    return np.sqrt((d * d).sum(2))


def _through(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product, one column at a time."""
    return np.stack([(a + column).min(1) for column in b.T], axis=1)


def _joined(units: list[_Unit], steps: Steps = _steps) -> _Unit:
    costs = units[0].costs
    for a, b in pairwise(units):
        costs = _through(_through(costs, steps(a.tail, b.head)), b.costs)
    return _Unit(units[0].head, units[-1].tail, costs)


def _traced(units: list[_Unit], first: int, last: int, steps: Steps = _steps) -> list[tuple[int, int]]:
    """The best way from a node of the first layer to one of the last: where it enters and leaves each unit."""
    reached, back = units[0].costs[first], []
    for a, b in pairwise(units):
        ends = reached[:, None] + steps(a.tail, b.head)
        inner = ends.min(0)[:, None] + b.costs
        back.append((ends.argmin(0), inner.argmin(0)))
        reached = inner.min(0)
    out, leave = [], last
    for before, enters in reversed(back):
        enter = int(enters[leave])
        out.append((enter, leave))
        leave = int(before[enter])
    return [(first, leave), *reversed(out)]


def _read(rows: pd.DataFrame, wide: int) -> list[_Unit]:
    ends = [[np.frombuffer(x).reshape(-1, wide) for x in rows[c]] for c in ("head", "tail")]
    return [_Unit(h, t, np.frombuffer(c).reshape(len(h), len(t))) for h, t, c in zip(*ends, rows["costs"], strict=True)]


def _row(key: tuple, layers: int, unit: _Unit) -> pd.DataFrame:
    parts = [np.ascontiguousarray(x, dtype=float).tobytes() for x in (unit.head, unit.tail, unit.costs)]
    return pd.DataFrame([(*map(int, key), layers, *parts)], columns=[c.split()[0] for c in _UNIT.split(", ")])


@dataclass
class _Layered:
    """One node of every layer; layers are those that have a node."""

    columns: tuple[str, ...] = ("candidate_index", "x", "y", "z")
    steps: Steps = _steps

    def units(self, rows: pd.DataFrame) -> list[_Unit]:
        return [_Unit(x, x, np.where(np.eye(len(x), dtype=bool), 0.0, np.inf)) for _, x in self._layers(rows)]

    def _layers(self, rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        rows = rows.sort_values(["seq", "candidate_index"])
        for seq, layer in rows.groupby("seq", sort=True):
            yield int(seq), layer[list(self.columns)].to_numpy(float)

    def ends(self, unit: _Unit) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(unit.head), bool), np.ones(len(unit.tail), bool)

    def picked(self, rows: pd.DataFrame, enter: int, leave: int) -> list[tuple[int, int]]:
        layers = list(self._layers(rows))
        got = _traced(self.units(rows), enter, leave, self.steps)
        return [(seq, int(x[a, 0])) for (seq, x), (a, _) in zip(layers, got, strict=True)]


@dataclass
class _Covering:
    """Layers may be left out where the intervals of the chosen ones overlap. A block is as long as the longest step, so
    a way goes from block to neighbouring block, and one unit holds all ways inside a block."""

    reach: float
    columns: tuple[str, ...] = ("candidate_index", "x", "y", "z", "seq", "arc_length", "left", "right", "slack", "first", "last")

    def steps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        costs, slack = _steps(a, b), a[:, None, 8]
        forward = (b[None, :, 4] > a[:, None, 4]) & (b[None, :, 5] - a[:, None, 5] <= self.reach + slack)
        over = (b[None, :, 6] <= a[:, None, 7] + slack) & (b[None, :, 7] > a[:, None, 7] + slack)
        return np.where(forward & over, costs, np.inf)

    def _nodes(self, rows: pd.DataFrame) -> np.ndarray:
        return rows.sort_values(["seq", "candidate_index"])[list(self.columns)].to_numpy(float)

    def _inside(self, nodes: np.ndarray, start: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Least costs from every node (or one) to every node, and the node before each on the ways from `start`."""
        n, step = len(nodes), self.steps(nodes, nodes)
        costs = np.where(np.eye(n, dtype=bool), 0.0, np.inf)[slice(None) if start is None else [start]]
        before = np.full(n, -1)
        for j in range(n):  # a step goes on in order of seq
            ways = costs + step[:, j]
            better = ways.min(1) < costs[:, j]
            if start is not None and better[0]:
                before[j] = int(ways[0].argmin())
            costs[better, j] = ways.min(1)[better]
        return costs, before

    def units(self, rows: pd.DataFrame) -> list[_Unit]:
        nodes = self._nodes(rows)
        return [_Unit(nodes, nodes, self._inside(nodes)[0])]

    def ends(self, unit: _Unit) -> tuple[np.ndarray, np.ndarray]:
        return unit.head[:, 9] > 0, unit.tail[:, 10] > 0

    def picked(self, rows: pd.DataFrame, enter: int, leave: int) -> list[tuple[int, int]]:
        nodes = self._nodes(rows)
        before, way = self._inside(nodes, enter)[1], [leave]
        while way[-1] != enter:
            way.append(int(before[way[-1]]))
        return [(int(nodes[i, 4]), int(nodes[i, 0])) for i in reversed(way)]


def _shortest(lean: DataFrame, rule: _Layered | _Covering) -> DataFrame:
    """The shortest way through nodes (branch_id, lateral_side, block, seq and the rule's columns): branch_id,
    lateral_side, seq, candidate_index, cost (of the whole way) and layers; no rows where there is no way. Blocks become
    min-plus matrices, which are joined in rounds until a branch and side is one; the way is then traced back through
    the same rounds, so no task holds more than one block of layers or `BLOCK` matrices."""
    keys, wide, steps = ["branch_id", "lateral_side"], len(rule.columns), rule.steps

    def block(key, rows):
        units = rule.units(rows)
        return _row(key, int(rows["seq"].nunique()), _joined(units, steps))

    def join(key, rows):
        rows = rows.sort_values("block")
        return _row(key, int(rows["layers"].sum()), _joined(_read(rows, wide), steps))

    rounds = [shared(lean.groupBy(*keys, "block").applyInPandas(block, _UNIT))]
    while rounds[-1].groupBy(*keys).count().where("count > 1").limit(1).count():
        up = rounds[-1].withColumn("up", F.floor(F.col("block") / BLOCK).cast("long"))
        rounds.append(shared(up.groupBy(*keys, "up").applyInPandas(join, _UNIT)))

    def top(batches):
        for b in batches:
            out = []
            for at, u in enumerate(_read(b, wide)):
                head, tail = rule.ends(u)
                costs = np.where(head[:, None] & tail[None], u.costs, np.inf)
                i, j = np.unravel_index(costs.argmin(), costs.shape)
                out.append((at, int(i), int(j), float(costs[i, j])))
            got = pd.DataFrame(out, columns=["at", "enter", "leave", "cost"])
            rows = pd.concat([b[[*keys, "block", "layers"]].reset_index(drop=True), got.drop(columns="at")], axis=1)
            yield rows[np.isfinite(rows["cost"])]

    whole = "branch_id int, lateral_side int, block long, layers long, enter long, leave long, cost double"
    ways = rounds[-1].mapInPandas(top, whole)

    def trace(key, rows):
        rows = rows.sort_values("block")
        got = _traced(_read(rows, wide), int(rows["enter"].iloc[0]), int(rows["leave"].iloc[0]), steps)
        return rows[[*keys, "block", "total", "cost"]].rename(columns={"total": "layers"}).assign(enter=[a for a, _ in got], leave=[b for _, b in got])[[*keys, "block", "layers", "enter", "leave", "cost"]]

    above = lambda: ways.select(*keys, F.col("block").alias("up"), F.col("layers").alias("total"), "enter", "leave", "cost")
    for units in reversed(rounds[:-1]):
        both = units.withColumn("up", F.floor(F.col("block") / BLOCK).cast("long")).join(above(), [*keys, "up"])
        ways = shared(both.groupBy(*keys, "up").applyInPandas(trace, whole))

    def pick(key, rows):
        got = rule.picked(rows, int(rows["enter"].iloc[0]), int(rows["leave"].iloc[0]))
        one = rows.iloc[0]
        return pd.DataFrame({"branch_id": int(key[0]), "lateral_side": int(key[1]), "seq": [s for s, _ in got], "candidate_index": [c for _, c in got], "cost": float(one["cost"]), "layers": int(one["total"])})

    both = lean.withColumn("up", F.col("block")).join(above(), [*keys, "up"])
    return both.groupBy(*keys, "block").applyInPandas(pick, "branch_id int, lateral_side int, seq long, candidate_index long, cost double, layers long")


def _typed(nodes: DataFrame) -> list[Column]:
    return [*[F.col(k).cast("int").alias(k) for k in ("branch_id", "lateral_side")], *[F.col(c).cast("long").alias(c) for c in ("seq", "candidate_index")]]


def chosen(nodes: DataFrame) -> DataFrame:
    """The shortest way of `layered`, one row for each layer: branch_id, lateral_side, seq, candidate_index, cost (of the
    whole way) and layers. Layers are those that have a node; `planned` refuses a side that lacks one."""
    lean = shared(nodes.select(*_typed(nodes), "x", "y", "z"))
    low = lean.agg(F.coalesce(F.min("seq"), F.lit(0))).first()[0]
    return _shortest(lean.withColumn("block", F.floor((F.col("seq") - low) / BLOCK).cast("long")), _Layered())


def side_layers(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many feasible nodes each point (point_index, branch_id, seq) has on either side, with zeros."""
    both = points.select("point_index", F.col("branch_id").cast("int").alias("branch_id"), "seq", F.explode(F.array(F.lit(1), F.lit(-1))).alias("lateral_side"))
    found = nodes.groupBy(F.col("branch_id").cast("int").alias("branch_id"), F.col("lateral_side").cast("int").alias("lateral_side"), "seq").agg(F.count("*").alias("nodes"))
    return both.join(found, ["branch_id", "lateral_side", "seq"], "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)))


def _refused(points: DataFrame, nodes: DataFrame) -> DataFrame:
    layers = side_layers(points, nodes)
    return layers.groupBy("branch_id", "lateral_side").agg(F.count("*").alias("points"), F.count_if(F.col("nodes") == 0).alias("missing"))


def planned(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every branch and side: status (ok, or no_path where some point has no node on the side), points, missing and
    cost of the shortest way that takes one node of every point."""
    keys = ["branch_id", "lateral_side"]
    sides_ = shared(_refused(points, nodes))
    typed = nodes.withColumns({k: F.col(k).cast("int") for k in keys})
    ways = chosen(typed.join(sides_.where("missing = 0").select(*keys), keys, "left_semi")).select(*keys, "cost").distinct()
    return sides_.join(ways, keys, "left").select(*keys, F.when(F.col("missing") == 0, "ok").otherwise("no_path").alias("status"), "points", "missing", "cost")


def covering(curve: DataFrame, nodes: DataFrame, half: float) -> DataFrame:
    """The shortest way whose chosen points cover their branch, one row for each chosen node: branch_id, lateral_side,
    seq, candidate_index, left, right, cost. A chosen point covers `half` of arc length to either side, but not beyond
    the middle towards a point without a node; points in between may be left out. curve has branch_id, seq,
    point_index, arc_length. Sides without such a way have no rows."""
    if half <= 0:
        raise ValueError("half > 0 is needed")
    keys = ["branch_id", "lateral_side"]
    layers = side_layers(curve, nodes).join(curve.select(F.col("branch_id").cast("int").alias("branch_id"), "seq", "arc_length"), ["branch_id", "seq"])
    sided = shared(layers.select(*keys, "seq", "arc_length", (F.col("nodes") == 0).alias("missing")))
    bounds = coverage_bounds(sided, half, keys)
    total = F.max("arc_length").over(Window.partitionBy(*keys))
    slack = F.greatest(F.lit(1.0), F.col("total")) * 1e-9
    rows = bounds.withColumn("total", total).withColumn("slack", slack).where("NOT missing AND left <= right + slack")
    rows = rows.withColumn("first", (F.col("left") <= F.col("slack")).cast("double")).withColumn("last", (F.col("right") >= F.col("total") - F.col("slack")).cast("double"))
    length = 2 * half * (1 + 1e-6)
    block = F.least(F.floor(F.col("arc_length") / length), F.greatest(F.floor(F.col("total") / length) - 1, F.lit(0)))
    rows = rows.select(*keys, "seq", "arc_length", "left", "right", "slack", "first", "last", block.cast("long").alias("block"))
    lean = shared(nodes.select(*_typed(nodes), "x", "y", "z").join(rows, [*keys, "seq"]))
    ways = _shortest(lean, _Covering(2 * half))
    return ways.drop("layers").join(rows.select(*keys, "seq", "left", "right"), [*keys, "seq"]).select(*keys, "seq", "candidate_index", "left", "right", "cost")


def covered(curve: DataFrame, way: DataFrame) -> DataFrame:
    """Every branch and side: status, cost, chosen and skipped points, the widest gap between neighbouring intervals, and
    whether they cover the branch from end to end. way is the result of `covering`."""
    keys = ["branch_id", "lateral_side"]
    ends = curve.groupBy(F.col("branch_id").cast("int").alias("branch_id")).agg(F.count("*").alias("points"), F.max("arc_length").alias("total"))
    both = ends.withColumn("lateral_side", F.explode(F.array(F.lit(1), F.lit(-1))))
    gap = F.greatest(F.lit(0.0), F.lead("left").over(Window.partitionBy(*keys).orderBy("seq")) - F.col("right"))
    found = way.withColumn("gap", gap).groupBy(*keys).agg(F.first("cost").alias("cost"), F.count("*").alias("chosen"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"), F.min("left").alias("low"), F.max("right").alias("high"))
    slack = F.greatest(F.lit(1.0), F.col("total")) * 1e-9
    whole = (F.col("low") <= slack) & (F.col("high") >= F.col("total") - slack) & (F.col("gap") <= slack)
    rows = both.join(found, keys, "left")
    return rows.select(*keys, F.when(F.col("chosen").isNotNull(), "ok").otherwise("no_path").alias("status"), "cost", F.coalesce("chosen", F.lit(0)).alias("chosen"), (F.col("points") - F.coalesce("chosen", F.lit(0))).alias("skipped"), "gap", F.coalesce(whole, F.lit(False)).alias("union_ok"))


_COUNTED = "branch_id int, lateral_side int, block long, head binary, tail binary, costs binary, ways binary"
Counted = tuple[np.ndarray, np.ndarray]


def _both(a: Counted, b: Counted) -> Counted:
    """Product of (least cost, number of ways of that cost, at most two): costs add and ways multiply; of several ways the
    least cost stays with the sum of the ways within 1e-9 of it."""
    costs, ways = [], []
    for cost, way in zip(b[0].T, b[1].T, strict=True):
        each = a[0] + cost
        least = each.min(1)
        near = each <= (least + 1e-9 * np.maximum(1.0, np.abs(least)))[:, None]
        costs.append(least)
        ways.append(np.minimum(2, (a[1] * way * near).sum(1)))
    return np.stack(costs, 1), np.stack(ways, 1)


def co_optimal(nodes: DataFrame) -> DataFrame:
    """branch_id, lateral_side, cost, ways: the cost of the shortest way of `chosen` and whether it is the only one (1) or
    not (2). Blocks of layers become matrices of (cost, ways), joined in rounds as for the way itself."""
    keys, wide = ["branch_id", "lateral_side"], 4
    rule = _Layered()
    lean = nodes.select(*_typed(nodes), "x", "y", "z")
    low = lean.agg(F.coalesce(F.min("seq"), F.lit(0))).first()[0]
    lean = shared(lean.withColumn("block", F.floor((F.col("seq") - low) / BLOCK).cast("long")))

    def one(key, head, tail, counted):
        parts = [np.ascontiguousarray(x, dtype=float).tobytes() for x in (head, tail, *counted)]
        return pd.DataFrame([(*map(int, key), *parts)], columns=[c.split()[0] for c in _COUNTED.split(", ")])

    def joined(key, parts):
        head, tail, now = parts[0]
        for h, t, c in parts[1:]:
            step = _steps(tail, h)
            now = _both(_both(now, (step, np.ones_like(step))), c)
            tail = t
        return one(key, head, tail, now)

    def block(key, rows):
        return joined(key, [(u.head, u.tail, (u.costs, np.eye(len(u.head)))) for u in rule.units(rows)])

    def join(key, rows):
        parts = []
        for r in rows.sort_values("block").itertuples():
            head, tail = (np.frombuffer(x).reshape(-1, wide) for x in (r.head, r.tail))
            parts.append((head, tail, tuple(np.frombuffer(x).reshape(len(head), len(tail)) for x in (r.costs, r.ways))))
        return joined(key, parts)

    now = shared(lean.groupBy(*keys, "block").applyInPandas(block, _COUNTED))
    while now.groupBy(*keys).count().where("count > 1").limit(1).count():
        up = now.withColumn("up", F.floor(F.col("block") / BLOCK).cast("long"))
        now = shared(up.groupBy(*keys, "up").applyInPandas(join, _COUNTED))

    def top(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                costs, ways = np.frombuffer(r.costs), np.frombuffer(r.ways)
                least = costs.min()
                out.append((r.branch_id, r.lateral_side, float(least), int(min(2, ways[costs <= least + 1e-9 * max(1.0, abs(least))].sum()))))
            yield pd.DataFrame(out, columns=[*keys, "cost", "ways"])

    return now.mapInPandas(top, "branch_id int, lateral_side int, cost double, ways long")


def axis_steps(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, max_axis_step and mean_axis_step: degrees between the axes a* of neighbouring nodes (seq)."""
    w = Window.partitionBy(*keys).orderBy("seq")
    turn = angle(unit(vec("a")), tuple(F.lag(c).over(w) for c in ("_x", "_y", "_z")))
    rows = nodes.withColumns({f"_{a}": c for a, c in zip("xyz", unit(vec("a")), strict=True)}).withColumn("turn", turn)
    return rows.groupBy(*keys).agg(F.max("turn").alias("max_axis_step"), F.avg("turn").alias("mean_axis_step"))


def node_records(nodes: DataFrame, frame: DataFrame) -> DataFrame:
    """nodes of a way (branch_id, lateral_side, seq, point_index, candidate_index, angle, x, y, z, a*, q*, e*) with angle_deg,
    lateral_projection, the centre in the normalised and in the source frame and the axis. frame is one row of
    `meshes.bbox_frame`."""
    one = frame.select(F.struct("scale", "cx", "cy", "cz").alias("f")).scalar()
    rows = nodes.withColumn("f", one)
    source = [(F.col(a) * F.col("f.scale") + F.col(f"f.c{a}")).alias(f"source_{a}") for a in "xyz"]
    return rows.select("branch_id", "lateral_side", "seq", "point_index", "candidate_index", F.degrees("angle").alias("angle_deg"), dot(vec("e"), vec("q")).alias("lateral_projection"), *[F.col(a).alias(f"norm_{a}") for a in "xyz"], *source, "ax", "ay", "az")


def side_records(points: DataFrame, nodes: DataFrame, frame: DataFrame) -> DataFrame:
    """Every branch and side as a report: status, points, missing, length_norm, length_source, longest segment, turns, axis
    steps, ways (at most two shortest ones) and side_name. nodes are the feasible poses of `planned`, with angle and a*."""
    keys = ["branch_id", "lateral_side"]
    plan = shared(planned(points, nodes))
    typed = nodes.withColumns({k: F.col(k).cast("int") for k in keys}).join(plan.where("status = 'ok'").select(*keys), keys, "left_semi")
    way = shared(chosen(typed).select(*keys, "seq", "candidate_index"))
    on_way = shared(typed.join(way, way.columns))
    scale = frame.select("scale").scalar()
    rows = plan.join(metrics(on_way, keys).drop("nodes"), keys, "left").join(axis_steps(on_way, keys), keys, "left").join(co_optimal(typed).drop("cost"), keys, "left")
    name = F.when(F.col("lateral_side") > 0, "+q").otherwise("-q")
    return rows.select(*keys, name.alias("side_name"), "status", "points", "missing", F.col("cost").alias("length_norm"), (F.col("cost") * scale).alias("length_source"), "max_segment", "max_turn", "mean_turn", "max_axis_step", "mean_axis_step", F.coalesce("ways", F.lit(0)).alias("ways"))


def metrics(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Length, longest segment and angle steps of ordered nodes (seq, x, y, z, angle)."""
    w = Window.partitionBy(*keys).orderBy("seq")
    seg = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in "xyz"), F.lit(0.0)))
    turn = F.abs(F.degrees(F.col("angle") - F.lag("angle").over(w)))
    rows = nodes.withColumn("seg", seg).withColumn("turn", F.least(turn, 360 - turn))
    return rows.groupBy(*keys).agg(F.count("*").alias("nodes"), F.coalesce(F.sum("seg"), F.lit(0.0)).alias("length"), F.max("seg").alias("max_segment"), F.max("turn").alias("max_turn"), F.avg("turn").alias("mean_turn"))


def coverage_bounds(curve: DataFrame, half: float, keys: Sequence[str] = ("branch_id",)) -> DataFrame:
    """curve (keys, seq, arc_length, missing): [s - half, s + half] cut at the middle between the nearest missing
    point and its neighbour on this point's side; without one at the branch's ends."""
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("seq")
    rows = curve.withColumn("gap_left", (F.col("arc_length") + F.lead("arc_length").over(order)) / 2).withColumn("gap_right", (F.col("arc_length") + F.lag("arc_length").over(order)) / 2)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    lo = F.coalesce(F.last(F.when(F.col("missing"), F.coalesce("gap_left", "arc_length")), ignorenulls=True).over(so_far), F.lit(0.0))
    hi = F.coalesce(F.first(F.when(F.col("missing"), F.coalesce("gap_right", "arc_length")), ignorenulls=True).over(ahead), F.max("arc_length").over(whole))
    more = [] if list(keys) == ["branch_id"] else ["arc_length"]
    return rows.select(*keys, "seq", "missing", *more, F.greatest(F.col("arc_length") - half, lo).alias("left"), F.least(F.col("arc_length") + half, hi).alias("right"))
