"""The nearest samples of tool poses in blocks: neighbouring poses are one block, which gets the samples that can be among
the nearest of any of them. What is shuffled are poses and, for each block, these samples; distances arise and are reduced
inside a task, in numpy, to a row a pose."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blocks import KEYS, TASKS, _dealt, _schema
from .curves import _written
from .spatial import CROWD, nearest, overlapping

#: Poses that are compared with the samples around them at once.
ROWS = 64
#: Takes some poses' numbers (by name), the numbers of their nearest samples (by name; a row a pose) in order, and their
#: distances, and returns the columns.
Weigh = Callable[[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def _reaches(dealt: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """block, its box lo*, hi*, and reach: no nearest sample of a pose is farther from the box. A pose is at most as far from
    its k samples as the middle of its octant of the block is from its own, and the way to that middle."""
    ends = [f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    made = _written(dealt.groupBy("block").agg(*ends))
    half = [(F.col(a) > (F.col(f"lo{a}") + F.col(f"hi{a}")) / 2).alias(f"upper_{a}") for a in "xyz"]
    octants = dealt.select("block", "x", "y", "z").join(made, "block").select("block", "x", "y", "z", *half).groupBy("block", *[f"upper_{a}" for a in "xyz"]).agg(*ends)
    size = F.sqrt(sum(((F.col(f"hi{a}") - F.col(f"lo{a}")) ** 2 for a in "xyz"), F.lit(0.0))) / 2
    middles = octants.select(F.struct("block", *[f"upper_{a}" for a in "xyz"]).alias("key"), *[((F.col(f"lo{a}") + F.col(f"hi{a}")) / 2).alias(a) for a in "xyz"], size.alias("size"))
    middles = _written(middles)
    far = nearest(middles, right, "key", ["sample_id"], k).where("rank IS NOT NULL").groupBy("key").agg(F.max("distance").alias("far"))
    reach = middles.join(far, "key").groupBy("key.block").agg((F.max(F.col("far") + F.col("size")) * (1 + 1e-9) + 1e-12).alias("reach"))
    return _written(made.join(reach, "block"))


def nearest_reduced(poses: DataFrame, samples: DataFrame, k: int, more: list[str], weigh: Weigh, columns: str) -> DataFrame:
    """For each pose (keys, x, y, z and the numbers `more`) the keys and the columns that `weigh` makes of its k nearest
    samples (sample_id, x, y, z and other numbers); of equals the least sample_id comes first. Poses of which a number is null
    have no row, nor has any without samples; samples with a null coordinate are nobody's neighbours."""
    held = ["x", "y", "z", *more]
    samples = _written(samples.dropna(subset=["x", "y", "z"]))
    others = [c for c in samples.columns if c not in ("sample_id", "x", "y", "z")]
    rows = poses.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in held]).dropna()
    boxed = rows.select("*", *[F.col(a).alias(f"{n}{a}") for n in ("lo", "hi") for a in "xyz"])
    dealt = _written(_dealt(_written(boxed)).drop(*[f"{n}{a}" for n in ("lo", "hi") for a in "xyz"]))
    placed = samples.select("sample_id", *[F.col(a).alias(f"q{a}") for a in "xyz"], *others)
    made = _reaches(dealt, placed.select("sample_id", "qx", "qy", "qz"), k)
    # samples of one small cell meet a block together
    size = max(made.agg(F.coalesce(F.percentile_approx("reach", 0.5), F.lit(1.0))).first()[0], 1e-9)
    cell = [f"cell_{a}" for a in "xyz"]
    placed = placed.withColumns({c: F.floor(F.col(f"q{a}") / (size / 2)) for c, a in zip(cell, "xyz", strict=True)})
    if (placed.groupBy(*cell).count().agg(F.max("count")).first()[0] or 0) > CROWD + k:  # of samples in one place at most k can be among the nearest
        spot = Window.partitionBy("qx", "qy", "qz").orderBy("sample_id")
        placed = _written(placed.withColumn("_in_spot", F.row_number().over(spot)).where(F.col("_in_spot") <= k).drop("_in_spot"))
    cells = placed.groupBy(*cell).agg(*[f(f"q{a}").alias(f"q{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    wide = made.select("block", "reach", *[F.col(f"{n}{a}").alias(f"b{n}{a}") for n in ("lo", "hi") for a in "xyz"], *[(F.col(f"lo{a}") - F.col("reach")).alias(f"lo{a}") for a in "xyz"], *[(F.col(f"hi{a}") + F.col("reach")).alias(f"hi{a}") for a in "xyz"])
    named_cells = cells.withColumnsRenamed({c: f"own_{c}" for c in cell})
    apart = lambda low, high: F.sqrt(sum((F.greatest(F.lit(0.0), F.col(f"blo{a}") - F.col(f"{high}{a}"), F.col(f"{low}{a}") - F.col(f"bhi{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    met = overlapping(wide, named_cells).where(apart("qlo", "qhi") <= F.col("reach"))
    met = met.select("block", "reach", *[f"b{n}{a}" for n in ("lo", "hi") for a in "xyz"], *[F.col(f"own_{c}").alias(c) for c in cell])
    order = [f"sample_id.{f}" for f in samples.schema["sample_id"].dataType.names] if isinstance(samples.schema["sample_id"].dataType, StructType) else ["sample_id"]
    ids = [f"id_{n}" for n in range(len(order))]
    around = met.join(placed, cell).where(apart("q", "q") <= F.col("reach")).select("block", *[F.col(c).alias(n) for c, n in zip(order, ids, strict=True)], "qx", "qy", "qz", *[F.col(c).cast("double").alias(c) for c in others])
    tasks = max(1, min(TASKS, made.count()))  # a fixed number: by their few bytes parts would be put together

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        right = right.sort_by([(c, "ascending") for c in ids])
        s = {c: right.column(c).to_numpy() for c in ["qx", "qy", "qz", *others]}
        p = {c: left.column(c).to_numpy() for c in held}
        at, to = np.stack([p[a] for a in "xyz"], axis=1), np.stack([s[f"q{a}"] for a in "xyz"], axis=1)
        places = np.floor((at - at.min(axis=0)) / np.maximum(np.ptp(at, axis=0), 1e-12) * 7.999)
        sorted_, out = np.lexsort(tuple(places.T)), []
        for start in range(0, len(sorted_), ROWS):
            some = sorted_[start : start + ROWS]
            low, high = at[some].min(axis=0), at[some].max(axis=0)
            near = to
            if len(to) > k:  # as in `_reaches`, for these poses
                far = np.sqrt(((to - (low + high) / 2) ** 2).sum(axis=1))
                reach = (np.partition(far, k - 1)[k - 1] + np.sqrt(((high - low) ** 2).sum()) / 2) * (1 + 1e-9) + 1e-12
                beyond = np.maximum(0.0, np.maximum(low - to, to - high))
                chosen = np.flatnonzero((beyond * beyond).sum(axis=1) <= reach * reach)
                near = to[chosen]
            else:
                chosen = np.arange(len(to))
            distance = np.sqrt(sum((at[some, a, None] - near[:, a]) ** 2 for a in range(3)))
            first = np.argmin(distance, axis=1)[:, None] if k == 1 else np.argsort(distance, axis=1, kind="stable")[:, :k]
            found = weigh({c: x[some] for c, x in p.items()}, {c: x[chosen[first]] for c, x in s.items()}, np.take_along_axis(distance, first, axis=1))
            out.append(pa.table({**{c: left.column(c).take(pa.array(some)) for c in KEYS}, **found}).select(schema.names).cast(schema))
        return pa.concat_tables(out).combine_chunks()

    schema = _schema(KEYS, columns)
    sides = [df.repartition(tasks, "block").groupBy("block") for df in (dealt, around)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, ", ".join([*[f"{c} long" for c in KEYS], columns]))
