"""Neighbour and overlap joins: equi joins on grid cells with an exact residual test, and a descent through nested cells
for the nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import distance, vec
from .curves import _written

#: Most cells of one level that are broadcast (about 20 MB), points of a cell beyond which repeated places are thinned,
#: levels of cells, left rows of a part that goes down through them, and of one that asks what is within reach.
CELLS, CROWD, DEEPEST, PART, REACH_PART = 200_000, 1_000, 30, 500, 20_000


def _cell(v, size: float) -> list[Column]:
    return [F.floor(c / size) for c in v]


def within(left: DataFrame, right: DataFrame, radius: float, parts: int | None = None) -> DataFrame:
    """Pairs of left (x, y, z) and right (qx, qy, qz) rows at most radius apart, with their distance. Each left row lies
    in one cell; each right row reaches into the 27 around its own, so put the smaller table on the right. parts: a fixed
    number of parts, which are not put together by their few bytes."""
    lies = left.select("*", *[c.alias(f"cell_{a}") for c, a in zip(_cell(vec(), radius), "ijk", strict=True)])
    looks = right
    for c, a in zip(vec("q"), "ijk", strict=True):
        looks = looks.withColumn(f"cell_{a}", F.explode(F.sequence(F.floor(c / radius) - 1, F.floor(c / radius) + 1)))
    cell = ["cell_i", "cell_j", "cell_k"]
    lies, looks = (df.repartition(parts, *cell) if parts else df for df in (lies, looks))
    met = lies.join(looks, cell).drop(*cell)
    return met.withColumn("distance", distance(vec(), vec("q"))).where(F.col("distance") <= radius)


def reached(left: DataFrame, right: DataFrame, radius: float, keys: list[str], near: Callable[[Column], Column]) -> DataFrame:
    """keys of the left rows (x, y, z) that have a right row (qx, qy, qz) at a distance of at most radius that is near; what
    is near stays so at a lesser distance. As one row is enough, crowded places are not paired: the right rows of a small
    cell are one box at first, and a left row is done if the farthest corner of some box is near. Boxes are met by a bounded
    number of left rows' cells. Only what no box decides, so what has few rows around it, meets the rows themselves. Left rows
    are dealt out by cells to a number of parts that grows with them: the work is in the pairs, not in the few bytes."""
    left, found, cell = _written(left), [], ["cell_x", "cell_y", "cell_z"]
    most = _box_distances()[1]
    for halves in (2, 4):
        parts = 1 + left.count() // REACH_PART
        ends = [f(f"q{a}").alias(f"b{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
        boxes = right.groupBy(*[c.alias(f"small_{a}") for c, a in zip(_cell(vec("q"), radius / halves), "xyz", strict=True)]).agg(*ends)
        lies = left.select("*", *[c.alias(f"cell_{a}") for c, a in zip(_cell(vec(), radius), "xyz", strict=True)])
        looks = boxes.drop("small_x", "small_y", "small_z")
        for a in "xyz":
            own = F.floor(F.col(f"blo{a}") / radius)
            looks = looks.withColumn(f"cell_{a}", F.explode(F.sequence(own - 1, own + 1)))
        met = lies.repartition(parts, *cell).join(looks.repartition(parts, *cell), cell).withColumn("distance", most)
        done = _written(met.where((F.col("distance") <= radius) & near(F.col("distance"))).select(*keys).distinct())
        found.append(done)
        left = _written(left.join(done, keys, "left_anti"))
    rest = within(left, right.select("qx", "qy", "qz"), radius, 1 + left.count() // REACH_PART).where(near(F.col("distance"))).select(*keys).distinct()
    return found[0].unionByName(found[1]).unionByName(rest)


def _box_distances() -> tuple[Column, Column]:
    """The least and the largest distance of x, y, z to the points of a box blo*, bhi*."""
    least = [F.greatest(F.lit(0.0), F.col(f"blo{a}") - F.col(a), F.col(a) - F.col(f"bhi{a}")) for a in "xyz"]
    most = [F.greatest(F.abs(F.col(a) - F.col(f"blo{a}")), F.abs(F.col(a) - F.col(f"bhi{a}"))) for a in "xyz"]
    return tuple(F.sqrt(sum((d * d for d in v), F.lit(0.0))) for v in (least, most))


def _touched() -> Column:
    """The distance of x, y, z within which a box blo*, bhi* is known to hold a row: each side of the box has one on it."""
    near, far = ([f(F.abs(F.col(a) - F.col(f"blo{a}")), F.abs(F.col(a) - F.col(f"bhi{a}"))) for a in "xyz"] for f in (F.least, F.greatest))
    return F.sqrt(F.least(*[sum((d * d for d in (near[i] if i == j else far[j] for j in range(3))), F.lit(0.0)) for i in range(3)]))


def _cells(placed: DataFrame) -> DataFrame:
    """Count and bounding box of every finest cell."""
    ends = [f(f"q{a}").alias(f"b{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    return placed.groupBy("cell_x", "cell_y", "cell_z").agg(F.count("*").alias("n"), *ends)


def _coarser(cells: DataFrame, shift: int) -> DataFrame:
    up = [F.shiftright(f"cell_{a}", shift).alias(f"cell_{a}") for a in "xyz"]
    ends = [f(f"b{n}{a}").alias(f"b{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    return cells.groupBy(*up).agg(F.sum("n").alias("n"), *ends)


def _depths(n: int, occupied: list[int], held: int) -> list[int]:
    """The levels to go down by, of which the last is the finest: the first (occupied: about how many cells of level 1, 2,
    ... hold rows) whose cells hold `held` rows on the average, or half of the cells of the deepest level where rows lie in
    few places. A step goes down so many levels that a cell has about eight children, one in space and three on a line."""
    enough = min(n / held, occupied[-1] / 2)
    finest = next((i for i, x in enumerate(occupied, 1) if x >= enough), len(occupied))
    steps, now = [], 1
    while not steps or steps[-1] < finest:
        at = steps[-1] if steps else 0
        at = max([at + 1, *[i for i in range(at + 1, finest + 1) if occupied[i - 1] <= 8 * now]])
        steps.append(at)
        now = occupied[at - 1]
    return steps


def nearest(left: DataFrame, right: DataFrame, key: str, ties: list[str], k: int = 1) -> DataFrame:
    """The k nearest right rows of every left row (told apart by key), with distance and rank; of equals by ties.

    Right rows lie in nested cells with counts and bounding boxes, as deep as it takes for few rows a cell. Left rows are
    dealt out by key and go down step by step: of the cells whose parents are still in question, those stay that are not
    beyond the distance within which the nearest cells already hold k rows. So a row far from all others meets the few
    cells that face it, not the whole table. Only the finest cells meet their rows. Rows with a null coordinate are nobody's
    neighbours; on the left they come out once, with nulls for neighbour, distance and rank."""
    there = lambda p: F.col(f"{p}x").isNotNull() & F.col(f"{p}y").isNotNull() & F.col(f"{p}z").isNotNull()
    nowhere, left, right = left.where(~there("")), left.where(there("")), right.where(there("q"))
    span = right.agg(F.count("*").alias("n"), *[f(f"q{a}").alias(f"{m}{a}") for a in "xyz" for m, f in (("lo", F.min), ("hi", F.max))]).first()
    size = max([1e-300, *[span[f"hi{a}"] - span[f"lo{a}"] for a in "xyz" if span["n"]]])
    at_level = lambda level: [F.least(F.floor((F.col(f"q{a}") - F.lit(span[f"lo{a}"])) / size * 2**level), F.lit(2**level - 1)) for a in "xyz"]
    occupied = right.select(*[c.alias(f"cell_{a}") for c, a in zip(at_level(DEEPEST), "xyz", strict=True)])
    shifts = range(DEEPEST - 1, -1, -1)
    occupied = list(occupied.agg(*[F.approx_count_distinct(F.xxhash64(*[F.shiftright(f"cell_{a}", s) for a in "xyz"])) for s in shifts]).first())
    steps = _depths(span["n"], occupied, max(8, k // 4))
    depth = steps[-1]
    placed = right.select("*", *[c.alias(f"cell_{a}") for c, a in zip(at_level(depth), "xyz", strict=True)])
    cells = _written(_cells(placed))
    many, fullest = cells.agg(F.count("*"), F.max("n")).first()
    if (fullest or 0) > CROWD + k:  # of rows in one place at most k can be among the nearest
        spot = Window.partitionBy("qx", "qy", "qz").orderBy(*ties)
        placed = _written(placed.withColumn("_in_spot", F.row_number().over(spot)).where(F.col("_in_spot") <= k).drop("_in_spot"))
        cells = _written(_cells(placed))
    keys = ["cell_x", "cell_y", "cell_z"]
    # a fixed number of parts: by their few bytes they would be put together in one task
    dealt = left.select(key, *[F.col(a).cast("double").alias(a) for a in "xyz"])
    dealt = dealt.repartition(1 + dealt.count() // PART, key)
    now = dealt.select("*", *[F.lit(0).cast("long").alias(c) for c in keys], F.lit(math.inf).alias("bound"))
    for before, level in zip([0, *steps], steps, strict=False):
        below = _coarser(cells, depth - level) if level < depth else cells
        below = below.withColumns({f"p{a}": F.shiftright(f"cell_{a}", level - before) for a in "xyz"})
        below = F.broadcast(below) if min(many, 8**level) <= CELLS else below
        parents = now.select(key, "x", "y", "z", "bound", *[F.col(f"cell_{a}").alias(f"p{a}") for a in "xyz"])
        least, most = _box_distances()
        most = _touched() if k == 1 else most
        met = parents.join(below, ["px", "py", "pz"]).select(key, "x", "y", "z", "bound", "n", *keys, least.alias("least"), most.alias("most"))
        met = met.where(F.col("least") <= F.col("bound"))
        whole = Window.partitionBy(key)
        if k > 1:  # one row needs no counts, and so no order of the cells
            met = met.withColumn("held", F.sum("n").over(whole.orderBy("most").rangeBetween(Window.unboundedPreceding, 0)))
        bound = F.min(F.when(F.col("held") >= k if k > 1 else F.lit(True), F.col("most") * (1 + 1e-12))).over(whole)
        met = met.withColumn("bound", F.least("bound", F.coalesce(bound, F.lit(math.inf))))
        now = met.where(F.col("least") <= F.col("bound")).select(key, "x", "y", "z", *keys, "bound")
    found = now.join(placed, keys).withColumn("distance", distance(vec(), vec("q"))).where(F.col("distance") <= F.col("bound"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", *ties))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k).select(key, *right.columns, "distance", "rank")
    return left.join(found, key).unionByName(nowhere, allowMissingColumns=True)


def _levels(boxes: DataFrame, lo: str, hi: str) -> tuple[DataFrame, list[int]]:
    """boxes with the level at which a box covers at most two cells an axis (cells of size 2 ** level), and all levels."""
    extent = F.greatest(F.lit(2.0**-60), *[F.col(f"{hi}{a}") - F.col(f"{lo}{a}") for a in "xyz"])
    out = boxes.withColumn("_level", F.ceil(F.log2(extent)).cast("int"))
    return out, sorted(x for x in out.agg(F.collect_set("_level")).first()[0])


def overlapping(queries: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pairs whose boxes (lo*/hi* against qlo*/qhi*) overlap, once each. Each box covers at most eight cells of a level;
    a pair meets at the level of its larger box, in the first cell that both cover. The levels that occur are few
    numbers, which both sides need to know."""
    own, queries_at = _levels(queries, "lo", "hi")
    other, boxes_at = _levels(boxes, "qlo", "qhi")

    def covered(df: DataFrame, lo: str, hi: str, theirs: list[int], name: str) -> DataFrame:
        at = F.filter(F.array(*[F.lit(x) for x in theirs]), lambda x: x > F.col("_level")) if theirs else F.array().cast("array<int>")
        at = F.when(F.col("_level") >= F.lit(min(theirs, default=999)), F.concat(F.array("_level"), at)).otherwise(at)
        out = df.withColumn("at", F.explode(at)).withColumnRenamed("_level", name)
        for a in "xyz":
            out = out.withColumn(f"cell_{a}", F.explode(F.sequence(*[F.floor(F.col(f"{n}{a}") / F.pow(F.lit(2.0), "at")) for n in (lo, hi)])))
        return out

    met = covered(own, "lo", "hi", boxes_at, "_own").join(covered(other, "qlo", "qhi", queries_at, "_other"), ["at", *[f"cell_{a}" for a in "xyz"]])
    met = met.where(F.col("at") == F.greatest("_own", "_other"))
    for a in "xyz":
        first = F.floor(F.greatest(f"lo{a}", f"qlo{a}") / F.pow(F.lit(2.0), "at"))
        met = met.where((F.col(f"lo{a}") <= F.col(f"qhi{a}")) & (F.col(f"qlo{a}") <= F.col(f"hi{a}")) & (F.col(f"cell_{a}") == first))
    return met.drop("at", "_own", "_other", *[f"cell_{a}" for a in "xyz"])
