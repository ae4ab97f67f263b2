"""A Merkle manifest of a table: a 16-ary tree over each source's rows, one over the sources, and a proof for every row.

A node is the hex SHA-256 of its children's hex digests. Leaves are digests of all columns, made by Spark functions.
Rows are numbered within their source by a range-partitioned sort: each task numbers its own rows, and the counts of
tasks and sources before it are added. Blocks of 16^3 = 4,096 aligned nodes are then walked one after another: for each
level the traversal holds the run of nodes that the current leaf's path needs, while a treehash stack makes the level's
next run, one leaf a step, so that it is ready when the walk gets there; beside the block's leaves it holds at most 32
nodes a level and a stack. The roots of the blocks are the nodes of the next round, until a source has one block, and the
sources' roots are the nodes of the last tree. Each block's path through the rounds above is shared by its leaves: it is
laid beside the block as one row and appended to each path. Spark deals blocks out, so a hot source is many tasks.

Defined cases: nulls, empty and long texts have encodings of their own (`-`, `0:`); rows of a null source are a source
that comes before all others; within a source null ids come first, and rows that repeat an id follow each other by their
leaf; equal rows have equal leaves and places of their own; a table of one row has the leaf for its root; an empty table
gives an empty result; columns other than the five are not part of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, staged

RUN, LEVELS = 16, 3
BLOCK = RUN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Places of runs and their other nodes, from the leaves upwards: "place:digests" joined by commas.
_NODES = "s string, place long, node string"
_PATHS = "s string, place long, path string"
_ROWS = 20_000


def h(digests: str) -> str:
    return sha256(digests.encode()).hexdigest()


class Treehash:
    """Makes a node from RUN**level leaves that come one by one; holds unfinished runs only. A short last run closes
    early."""

    def __init__(self) -> None:
        self.runs: list[list[str]] = []

    def push(self, leaf: str, level: int) -> str | None:
        """The node of the given level that this leaf completes, if it completes one."""
        node = leaf
        for k in range(level):
            if k == len(self.runs):
                self.runs.append([])
            self.runs[k].append(node)
            if len(self.runs[k]) < RUN:
                return None
            node = h("".join(self.runs[k]))
            self.runs[k] = []
        return node

    def close(self, level: int) -> str | None:
        """The node of the leaves that are left, hashed up to the given level."""
        node = None
        for k in range(level):
            run = (self.runs[k] if k < len(self.runs) else []) + ([node] if node is not None else [])
            node = h("".join(run)) if run else None
        self.runs = []
        return node


class Level:
    """One level of a traversal: the run under the path, and the next run in the making."""

    def __init__(self, leaves: list[str], level: int):
        self.leaves, self.level, self.span = leaves, level, RUN ** (level + 1)
        self.hash, self.ahead, self.next = Treehash(), 0, []
        for _ in range(self.span):
            self.advance()
        self.run, self.next = self.next, []

    def advance(self) -> None:
        """Give the treehash one more leaf, or end it after the last one."""
        if self.ahead < len(self.leaves):
            node = self.hash.push(self.leaves[self.ahead], self.level)
            self.ahead += 1
            if self.ahead == len(self.leaves) and node is None:
                node = self.hash.close(self.level)
            if node is not None:
                self.next.append(node)

    def step(self, leaf: int) -> None:
        """Move on to the given leaf."""
        self.advance()
        if leaf % self.span == 0:
            self.run, self.next = self.next, []


def traversal(leaves: list[str], levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf in order its path: per level the place in the run and the run's nodes."""
    held = [Level(leaves, k) for k in range(levels)]
    for i in range(len(leaves)):
        if i:
            for level in held:
                level.step(i)
        yield [(i // RUN**k % RUN, level.run) for k, level in enumerate(held)]


def levels_of(n: int) -> int:
    """Levels until one node is left of n, at most those of a block."""
    k = 0
    while RUN**k < n and k < LEVELS:
        k += 1
    return k


def block_root(leaves: list[str], levels: int) -> str:
    stack = Treehash()
    node = None
    for leaf in leaves:
        node = stack.push(leaf, levels)
    return node if node is not None else stack.close(levels)


def folded(node: str, path: list[tuple[int, str]]) -> str:
    """The root that a node and the other nodes of its runs give."""
    for place, others in path:
        node = h(others[: place * 64] + node + others[place * 64 :])
    return node


def _shown(path: list[tuple[int, list[str]]]) -> str:
    return ",".join(f"{p}:{''.join(run[:p] + run[p + 1 :])}" for p, run in path)


def _read(path: str) -> list[tuple[int, str]]:
    return [(int(p), others) for p, others in (level.split(":") for level in path.split(","))] if path else []


def _field(c: str) -> Column:
    value = F.col(c).cast("string")
    return F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(text: str = "text") -> Column:
    return F.sha2(F.concat(*[_field(c if c != "text" else text) for c in COLUMNS]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `place`, their number from 0 within column s by order, and `n`, the rows of s. One range-partitioned
    sort; no task holds a whole s, and what is joined back is one row for each task and s that it holds."""
    form = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            own = b.groupby("s", sort=False).cumcount()
            own += (b["s"] == last) * count
            last, count = b["s"].iloc[-1], int(own.iloc[-1]) + 1
            yield b.assign(part=part, own=own)

    sorted_rows = rows.repartitionByRange("s", *order).sortWithinPartitions("s", *order)
    own = staged(sorted_rows.mapInPandas(number, f"{form}, part int, own long"))
    counts = own.groupBy("s", "part").agg(F.count("*").alias("held"))
    whole = Window.partitionBy("s")
    before = F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = staged(counts.select("s", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(whole).alias("n")))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    return own.join(counts, ["s", "part"]).select(*rows.columns, (F.col("own") + F.col("before")).alias("place"), "n")


def _by_block(nodes: DataFrame) -> DataFrame:
    """Nodes (s, place, n, node, ...) dealt out by block, each block in order."""
    block = F.floor(F.col("place") / BLOCK).alias("block")
    return nodes.select("*", block).repartition("s", "block").sortWithinPartitions("s", "block", "place")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole blocks from batches of rows sorted by s, block, place."""
    held: list[pd.DataFrame] = []
    for b in batches:
        key = b["s"].ne(b["s"].shift()) | b["block"].ne(b["block"].shift())
        starts = [*key.to_numpy().nonzero()[0].tolist(), len(b)]
        for i, j in zip(starts, starts[1:], strict=False):
            some = b.iloc[i:j]
            if held and (held[0]["s"].iloc[0], held[0]["block"].iloc[0]) != (some["s"].iloc[0], some["block"].iloc[0]):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(some)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def block_roots(nodes: DataFrame) -> DataFrame:
    """One node for each block of each s: s, place (the block's number), n (blocks of s), node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in _blocks(batches):
            n = int(g["n"].iloc[0])
            out.append((g["s"].iloc[0], int(g["block"].iloc[0]), -(-n // BLOCK), block_root(g["node"].tolist(), levels_of(n))))
            if len(out) == _ROWS:
                yield pd.DataFrame(out, columns=["s", "place", "n", "node"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["s", "place", "n", "node"])

    return staged(_by_block(nodes.select("s", "place", "n", "node")).mapInPandas(run, "s string, place long, n long, node string"))


def _with_upper(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """Nodes dealt out by block, and before each block's nodes (place -1) the row of what all its paths share."""
    block = F.floor(F.col("place") / BLOCK).alias("block")
    both = nodes.select("*", block).unionByName(upper.withColumnRenamed("place", "block").withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
    return both.repartition("s", "block").sortWithinPartitions("s", "block", "place")


def _paths_below(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """For each node its path up to the top; upper has s, place (block), path, the way on from each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _blocks(batches):
            rest, g = g["path"].iloc[0], g.iloc[1:]
            ways = traversal(g["node"].tolist(), levels_of(int(g["n"].iloc[0])))
            yield pd.DataFrame({"s": g["s"], "place": g["place"], "path": [",".join(filter(None, (_shown(w), rest))) for w in ways]})

    return staged(_with_upper(nodes, upper).mapInPandas(run, _PATHS))


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the roots of their blocks, of blocks of these, and so on until each s has one block; its root is
    the last table's node."""
    out = [nodes]
    while True:
        out.append(block_roots(out[-1]))
        if not out[-1].where("n > 1").limit(1).count():
            return out


def manifest(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = docs.sparkSession
    s = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("s")
    small = F.translate("text", ascii_uppercase, ascii_lowercase)
    marked = docs.select(*COLUMNS, s, (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("hit"))
    marked = marked.withColumn("small", F.when(F.col("hit"), small))
    leaves = marked.select("s", "doc_id", leaf_of().alias("node"), F.when(F.col("hit"), leaf_of("small")).alias("changed"))
    rows = staged(numbered(leaves, ["doc_id", "node"]))

    within = rounds(rows)
    subroots = within[-1].where("place = 0").select("s", F.col("node"))
    tops = staged(numbered(subroots.select(F.lit("").alias("s"), F.col("s").alias("source"), "node"), ["source"]))
    above = rounds(tops)
    if not (last := above[-1].select("node").first()):
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    root = last[0]

    none = above[-1].select("s", "place", F.lit("").alias("path"))
    for nodes in reversed(above[:-1]):
        none = _paths_below(nodes.select("s", "place", "n", "node"), none)
    ways = tops.select("source", "node", "place").join(none.select("place", "path"), "place")
    upper = ways.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("place"), "path", F.col("node").alias("subroot"))
    subroot = upper.select("s", "subroot")
    upper = upper.drop("subroot")
    for nodes in reversed(within[1:-1]):
        upper = _paths_below(nodes, upper)
    upper = upper.join(subroot, "s")

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _blocks(batches):
            rest, sub, g = _read(g["path"].iloc[0]), g["subroot"].iloc[0], g.iloc[1:]
            shared = "".join(x for _, x in rest)
            proofs, found = [], []
            ways = traversal(g["node"].tolist(), levels_of(int(g["n"].iloc[0])))
            for way, leaf, changed in zip(ways, g["node"], g["changed"].fillna(""), strict=True):
                own = [(p, "".join(run[:p] + run[p + 1 :])) for p, run in way]
                proofs.append(h("".join(x for _, x in own) + shared))
                found.append(folded(folded(changed or leaf, own), rest))
            yield pd.DataFrame({"doc_id": g["doc_id"], "leaf": g["node"], "subroot": sub, "root": root, "proof_sha256": proofs, "folded_root": found, "verified": [f == root for f in found]})

    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_upper(rows, upper).mapInPandas(prove, out)


_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)))"
_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in COLUMNS)
_SMALL = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
SQL = f"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || source, '') AS s, sha256({_FIELDS}) AS leaf, sha256({_FIELDS.replace("text", f"{_SMALL}")}) AS other, xor({_CRC}, 4294967295) % 5 = 0 AS hit FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY s) AS n FROM d),
t AS (SELECT s, 0 AS level, place, leaf AS node, n FROM l
  UNION ALL SELECT s, level + 1, place >> 4, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 15) >> 4 FROM t WHERE n > 1 GROUP BY s, level, place >> 4),
sub AS (SELECT s, node AS subroot, level AS height, row_number() OVER (ORDER BY s) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, place, subroot AS node, n FROM sub
  UNION ALL SELECT level + 1, place >> 4, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 15) >> 4 FROM u WHERE n > 1 GROUP BY level, place >> 4),
root AS (SELECT node AS root, level AS top FROM u WHERE n = 1),
runs AS (SELECT s, level, place >> 4 AS run, list(node ORDER BY place) AS nodes FROM t WHERE n > 1 GROUP BY s, level, place >> 4
  UNION ALL SELECT NULL, level, place >> 4, list(node ORDER BY place) FROM u WHERE n > 1 GROUP BY level, place >> 4),
p AS (SELECT l.*, subroot, height, sub.place AS sub_place, top, root FROM l JOIN sub USING (s), root),
f AS (SELECT *, 0 AS step, CASE WHEN hit THEN other ELSE leaf END AS now, '' AS proof, CASE WHEN height > 0 THEN place ELSE sub_place END AS spot FROM p
  UNION ALL SELECT f.* EXCLUDE (step, now, proof, spot), step + 1, sha256(array_to_string(nodes[:spot & 15] || [now] || nodes[(spot & 15) + 2:], '')),
    proof || array_to_string(nodes[:spot & 15] || nodes[(spot & 15) + 2:], ''), CASE WHEN step + 1 = height THEN sub_place ELSE spot >> 4 END
  FROM f JOIN runs r ON step < height + top AND r.s IS NOT DISTINCT FROM CASE WHEN step < height THEN f.s END
    AND r.level = CASE WHEN step < height THEN step ELSE step - height END AND r.run = spot >> 4)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified FROM f WHERE step = height + top"""
