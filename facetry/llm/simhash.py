"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased form four-word shingles, repeats included; a bit of the
fingerprint is 1 if it is set in over half of the shingles' XXH64 values (seed 42). Fingerprints that differ in at
most four bits are linked, and a component is everything reachable.

Balls of half the radius around all 64 bits have 2,081 variants each, many times the texts themselves. So the bits
are cut into three blocks: of two fingerprints within four bits, some two blocks together hold at most two of the
differences, and for these 42 or 43 bits each fingerprint emits the variants within half of that radius, one bit:
131 rows. They are shuffled on the variant. Fingerprints that meet are verified against each other, up to `FEW` at
one spot, and tied by a spanning forest. Where more meet, the ball is completed over the third block: a fingerprint `a` bits from the meeting point emits the variants of its
third block within 2 - a bits. Those who meet again differ in at most 2 + 2 bits, and whoever differs in at most
four bits meets somewhere, so the members are tied to the least of them, without pairs. Only distinct fingerprints
take part: copies never multiply rows.

Defined cases: a null or word-less text has fingerprint zero and is linked like any other; fewer than four words
form one shingle; repeated rows share a component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import staged, text_or_empty
from .components import components

WORDS, SEED, RADIUS = 4, 42, 4
#: Up to so many fingerprints that meet are compared in one task at once, about so many rows a task; where more meet,
#: the ball is completed over the third block.
FEW, GROUP_ROWS = 1024, 50_000
#: Bits of the three blocks.
BLOCKS = (tuple(range(22)), tuple(range(22, 43)), tuple(range(43, 64)))


def simhash(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned number."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, k = b" ".join(parts), min(words, len(parts))
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(e + 1 for e in ends[:-k])]
    n = len(starts)
    h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed): one map over the whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter(map(simhash, b["text"]), np.uint64, len(b)).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def _flips(bits: tuple[int, ...], most: int) -> list[int]:
    return [_mask(c) for n in range(most + 1) for c in combinations(bits, n)]


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Ties that join whatever pairs within the radius join, by a search from the least fingerprint on."""
    left, ties = np.sort(fps).view(np.uint64), []
    while len(left):
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            near = np.bitwise_count(left[None, :] ^ edge[:, None]) <= RADIUS
            got = near.any(0)
            ties += zip(left[got].view(np.int64).tolist(), edge[near[:, got].argmax(0)].view(np.int64).tolist(), strict=True)
            edge, left = left[got], left[~got]
    return ties


def links(nodes: DataFrame) -> DataFrame:
    """u, v: ties between distinct fingerprints (column fp) whose components are those of all pairs within four bits."""
    balls = []
    for side, rest in enumerate(BLOCKS):
        own = tuple(b for block in BLOCKS if block != rest for b in block)
        balls += [F.struct(F.lit(side).alias("side"), _long(_mask(own)).alias("held"), _long(x).alias("flip")) for x in _flips(own, 1)]
    emitted = nodes.select("fp", F.explode(F.array(*balls)).alias("b")).select(
        F.col("fp").bitwiseAND(F.col("b.held")).bitwiseXOR(F.col("b.flip")).alias("spot"), F.col("b.side").alias("side"), "fp"
    )
    w = Window.partitionBy("spot", "side")
    met = staged(emitted.select("spot", "side", "fp", F.count("*").over(w).alias("n")).where("n > 1"))

    def pairs(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["spot", "side"])
        cut = np.flatnonzero((df["spot"].diff() != 0) | (df["side"].diff() != 0))
        fps = df["fp"].to_numpy()
        return pd.DataFrame([t for a, b in zip(cut, [*cut[1:], len(fps)], strict=True) for t in _spanning(fps[a:b])], columns=["u", "v"])

    few = met.where(F.col("n") <= FEW)
    groups = max(1, few.count() // GROUP_ROWS)
    ties = few.groupBy(F.pmod(F.xxhash64("spot", "side"), F.lit(groups)).alias("g")).applyInPandas(pairs, "u long, v long")
    for side, rest in enumerate(BLOCKS):
        many = met.where((F.col("n") > FEW) & (F.col("side") == side))
        held = F.col("fp").bitwiseAND(_long(_mask(rest)))
        off = F.bit_count(F.col("fp").bitwiseXOR(F.col("spot")).bitwiseAND(_long(_mask(b for b in range(64) if b not in rest))))
        near, far = (F.array(*map(_long, _flips(rest, n))) for n in (1, 2))
        around = many.select("spot", "fp", held.alias("held"), F.explode(F.when(off == 0, far).otherwise(near)).alias("flip"))
        around = around.select(F.col("held").bitwiseXOR(F.col("flip")).alias("third"), "spot", "fp")
        low = F.min("fp").over(Window.partitionBy("third", "spot"))
        ties = ties.unionByName(around.select(F.col("fp").alias("u"), low.alias("v")).where("u <> v"))
    return ties.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    rows = staged(simhashes(docs, id_col, text_col))
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes))
    tied = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    tied = staged(tied)
    least = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = tied.join(least, "root").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
