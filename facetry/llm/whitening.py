"""Whitening of embeddings from a compensated covariance.

Entries become integers x = floor(64 c) + 1000000, far from zero, so that sums of squares would lose the covariance.
Two passes: exact integer sums per dimension, then the covariance centred before multiplying. A centred entry x - S/n is
a pair of doubles (high and low part). Error-free transformations split each block of centred vectors into slices of
`BITS` bits at one scale per dimension; products of slices are summed by matrix products without any rounding, as 2
`BITS` bits and the rows of a block fit 53 bits. The exact partial sums are added to the task's covariance in
double-double (two-sum); tasks hand on high and low parts by row of the matrix, and these are merged in double-double on
Spark, in two steps. The matrix, whose size depends on the dimension alone, then goes to the driver, where LAPACK's
`syevd` solves it: Householder reduction to tridiagonal form, then divide and conquer. One correction step with the low
parts brings residuals to double precision. The components travel in the closure of the map that projects.

Rows are whitened in one map and staged; their own covariance, by the same operator, gives identity_error.

Defined cases: rows are dropped whose vector is null, or holds a null, a non-finite entry or one beyond a long's range,
or has another length than most vectors have (of equally frequent lengths the longest counts); repeated rows and
repeated or null ids count each; with fewer than 32 dimensions there are as many components; a component without
variance (at most `DIM * 1e-15` of the trace) has null for whitened and is left out of identity_error; explained is null
where the trace is 0; a deviation that no long holds is null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Bits of a slice, slices of a centred entry, and rows of a block: 2 * 22 bits and 256 summands fit 53 bits.
BITS, SLICES, BLOCK = 22, 4, 256
_SPLIT = 134217729.0  # 2**27 + 1 parts a double into halves whose products are exact
Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded sum and its error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(a: Pair, b: Pair) -> Pair:
    """Sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded product and its error, exactly."""
    p = a * b
    ah, bh = a * _SPLIT, b * _SPLIT
    ah, bh = ah - (ah - a), bh - (bh - b)
    return p, ((ah * bh - p) + ah * (b - bh) + (a - ah) * bh) + (a - ah) * (b - bh)


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """high + low, by column, as a sum of slices that are multiples of one power of two and have at most `BITS` bits."""
    top = np.abs(high).max(axis=0, initial=0.0)
    grain = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))) + 1 - BITS)
    out = []
    for _ in range(SLICES):
        part = np.rint(high / grain) * grain
        high, low = two_sum(high - part, low)
        out.append(part)
        grain = grain * 2.0**-BITS
    return out


def outer_sum(high: np.ndarray, low: np.ndarray) -> Pair:
    """Sum over the rows of the outer products of high + low, in double-double."""
    d = high.shape[1]
    total = (np.zeros((d, d)), np.zeros((d, d)))
    for at in range(0, len(high), BLOCK):
        parts = slices(high[at : at + BLOCK], low[at : at + BLOCK])
        for i, p in enumerate(parts):
            for q in parts[: SLICES - i]:
                total = added(total, (p.T @ q, np.zeros((d, d))))
    return total


def _kept(vectors: DataFrame, col: str) -> DataFrame:
    """Rows whose vector has only entries that are finite and fit, and the common length."""
    fits = F.forall(col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 2.0**56))
    rows = vectors.where(F.col(col).isNotNull() & fits)
    counted = rows.groupBy(F.size(col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size(col) == (counted["d"] if counted else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def shifted(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64)).astype(np.int64) + SHIFT


def exact_sums(rows: DataFrame, col: str) -> tuple[int, list[int]]:
    """n and the sum of each dimension, as integers of any size: high and low halves, summed as decimals on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        n, high, low = 0, 0, 0
        for b in batches:
            if b.num_rows:
                x = shifted(_matrix(b.column(0)))
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    parts = rows.select(col).mapInArrow(run, "i long, n long, high long, low long")
    sums = parts.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()
    return (int(sums[0]["n"]) if sums else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in sums]


def _pair_of(value: Fraction) -> tuple[float, float]:
    high = float(value)
    return high, float(value - Fraction(high))


def centred(x: np.ndarray, mean: list[Fraction]) -> Pair:
    """x - mean in double-double; x are integers."""
    high, low = (np.array(p) for p in zip(*map(_pair_of, mean), strict=True))
    upper = (x >> 26 << 26).astype(np.float64)
    x_pair = two_sum(upper, (x & 0x3FFFFFF).astype(np.float64))
    return added(x_pair, (np.broadcast_to(-high, x.shape), np.broadcast_to(-low, x.shape)))


def covariance(rows: DataFrame, col: str, n: int, mean: list[Fraction], entries=lambda m: m) -> Pair:
    """Covariance (divisor n) of the vectors in col, in double-double. `entries` makes numbers of the stored ones."""
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for b in batches:
            m = entries(_matrix(b.column(0))) if b.num_rows else None
            if m is not None:
                own = centred(m, mean) if m.dtype == np.int64 else added((m, np.zeros(m.shape)), tuple(np.broadcast_to([-p[k] for p in map(_pair_of, mean)], m.shape) for k in (0, 1)))
                some = outer_sum(*own)
                total, part = (some if total is None else added(total, some)), (part + int(np.abs(m).sum() % 64)) % 64
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, part)), pa.array(list(total[0])), pa.array(list(total[1]))], ["i", "part", "high", "low"])

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        total = (np.zeros(d), np.zeros(d))
        for pair in zip(g["high"], g["low"], strict=True):
            total = added(total, pair)
        return pd.DataFrame({"i": [g["i"].iloc[0]], "part": [0], "high": [total[0]], "low": [total[1]]})

    form = "i long, part long, high array<double>, low array<double>"
    tasks = rows.select(col).mapInArrow(run, form)
    merged = tasks.groupBy("i", "part").applyInPandas(merge, form).groupBy("i").applyInPandas(merge, form).orderBy("i").collect()
    high, low = (np.array([r[c] for r in merged]) for c in ("high", "low"))
    q = high / n
    p, e = two_product(q, np.float64(n))
    return two_sum(q, (((high - p) - e) + low) / n)


def components(v: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows) of a symmetric double-double matrix."""
    high, low = (v[0] + v[0].T) / 2, (v[1] + v[1].T) / 2
    e, u = np.linalg.eigh(high)  # syevd: tridiagonal reduction, divide and conquer
    # one correction step against the whole matrix: its entries in the found basis, accumulated in extended precision
    wide = u.astype(np.longdouble)
    inner = (wide.T @ (high.astype(np.longdouble) + low) @ wide).astype(np.float64)
    own, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-own, kind="stable")
    u = u @ turn[:, order]
    return own[order], (u / np.linalg.norm(u, axis=0)).T


def whitened(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row per kept vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = staged(_kept(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(col).alias("vector")), "vector"))
    n, sums = exact_sums(rows, "vector")
    form = "vec_id long, n long, deviation long, white array<double>"
    names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not sums:
        return vectors.sparkSession.createDataFrame([], names)
    mean = [Fraction(s, n) for s in sums]
    v = covariance(rows, "vector", n, mean, shifted)
    values, units = components(v)
    trace, count = float(np.trace(v[0])), min(count, len(mean))
    sound = (values > len(mean) * 1e-15 * trace)[:count]
    turn = units[:count] / np.sqrt(np.where(sound, values[:count], 1.0))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = shifted(_matrix(b.column("vector")))
                high, low = centred(x, mean)
                white = high @ turn.T + low @ turn.T
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(np.full(len(x), n)), pa.array(_deviation(x, n, sums), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], ["vec_id", "n", "deviation", "white"])

    done = staged(rows.mapInArrow(run, form))
    error = _identity_error(done, n, sound) if sound.any() else None
    shares = [None if trace <= 0 else float(x / trace) for x in values[:count]]
    each = F.arrays_zip("white", F.array(*[F.lit(bool(s)) for s in sound]).alias("sound"), F.array(*[F.lit(s).cast("double") for s in shares]).alias("share"))
    flat = done.select("vec_id", "n", "deviation", F.posexplode(each).alias("k", "c"))
    value = F.when(F.col("c.sound"), F.col("c.white"))
    return flat.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", value.alias("whitened"), F.col("c.share").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 of each row; in integers of any size where a long might not hold a step."""
    mean = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)  # n x - S = n (x - mean) - rest
    far = float(n) * (np.abs((x - mean).astype(np.float64)).max(initial=0.0) + 1)
    if far * far * len(sums) < 2.0**62:
        return ((n * (x - mean) - rest) ** 2).sum(axis=1).tolist()
    exact = (sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x)
    return [t if t < 1 << 63 else None for t in exact]


def _identity_error(done: DataFrame, n: int, sound: np.ndarray) -> float:
    """The largest entry of the whitened rows' own covariance, of the sound components, minus the identity."""
    sums = done.select(F.posexplode("white").alias("k", "w")).groupBy("k").agg(F.sum("w").alias("s")).orderBy("k").collect()
    high, _ = covariance(done, "white", n, [Fraction(r["s"]) / n for r in sums])
    return float(np.abs(high - np.eye(len(high)))[np.ix_(sound, sound)].max())
