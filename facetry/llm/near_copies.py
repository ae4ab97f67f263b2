"""Near copies: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Words are those of SimHash (bytes between white space, A-Z lower-cased); a text of one to four words is one shingle.
SimHash comes first: sets of one fingerprint, and those whose fingerprints are within four bits (`simhash.links`), are
tied where the exact check on the whole sets holds. Fingerprints alone cannot find all pairs, as at similarity 0.8 they
differ in seven to nine bits and more, so MinHash bands, 40 of six rows, go on from there: a pair of similarity 0.8 shares
none with probability (1 - 0.8**6) ** 40 = 5e-6, one of 0.85 with 2e-9, and texts that share a passage only seldom meet.
Pairs whose signatures (a byte of each of the 240 MinHash values) agree in less than `SIGNED` of the places go first: of
similarity 0.8 that happens with a probability of about 3e-8. Every link is verified on the whole shingle sets.

Only distinct sets take part. In each spot the members are first tried against one of them (the least by a hash
that changes with the round); sets that are tied already need no further pairs, so clusters of copies cost a star and
not all pairs. Spots whose members are all tied are done. What meets and is still in different components is then
compared inside the spots, in blocks, by signatures and then by sets, each pair in the first spot that it shares, and
only links become rows.

Defined cases: word-less and null texts have the empty set and are linked with each other only; repeated rows share
a component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import BROADCAST_ROWS, batches_of, own_name, row_numbers, staged, text_or_empty
from .components import components
from .simhash import links, simhash

WORDS, LEAST, BANDS, ROWS = 5, 0.8, 40, 6
SIGNED = 0.66
#: Most bytes of signatures or sets that are broadcast to their pairs; beyond it they are shuffled.
SMALL = 1 << 23
#: Bytes of a block of members of a spot, of which a task compares one or two, and of a member without its set.
BLOCK, MEMBER = 1 << 20, 600
#: Rounds of stars go on, up to so many, while the pairs left are more than so many and one try in a hundred ties.
STARS, PAIRS, GAIN = 6, 2_000_000, 0.01
_RNG = np.random.default_rng(6)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_MUL = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    out = np.full(len(parts) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(parts) - k + 1 + i]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def spots(s: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One hash for each band of the set's MinHash values, and its signature; nothing for the empty set."""
    if not len(s):
        return np.zeros(0, np.uint64), bytes(BANDS * ROWS)
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(s), 256):
        low = np.minimum(low, ((s[at : at + 256, None] ^ _XOR) * _MUL).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _ODD
        key ^= key >> np.uint64(29)
    return key, (low * _ODD >> np.uint64(56)).astype(np.uint8).tobytes()


def node(s: np.ndarray) -> int:
    return int(np.uint64(xxh3_64_intdigest(s.tobytes())).view(np.int64))


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def _signed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("gu", "gv"))
            yield b.select(["u", "v"]).filter(pa.array((one == two).sum(axis=1) >= SIGNED * BANDS * ROWS))

    of = staged(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "signature"), "node"))
    of = F.broadcast(of) if of.count() * BANDS * ROWS <= SMALL else of
    both = pairs.join(of.select(F.col("node").alias("u"), F.col("signature").alias("gu")), "u")
    both = both.join(of.select(F.col("node").alias("v"), F.col("signature").alias("gv")), "v")
    return both.select("u", "v", "gu", "gv").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(*(np.frombuffer(x.as_buffer(), np.uint64) for x in xy)) for xy in zip(b.column("su"), b.column("sv"), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    size = sets.agg(F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first()[0]
    sets = F.broadcast(sets) if size <= SMALL else sets
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
    return both.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _blocks(at: DataFrame, payload: DataFrame, weight: Column) -> DataFrame:
    """Members of each spot in groups of one or two blocks of about `BLOCK` bytes (weight: bytes of a member), so that
    every two members are in one group. Payloads are joined to members, before those are dealt to several groups."""
    sizes = at.groupBy("spot").agg(F.ceil(F.sum(weight) / BLOCK).cast("int").alias("blocks"))
    dealt = at.join(sizes, "spot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    full = dealt.join(payload, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct("node", "root", "size", "block", *[c for c in payload.columns if c != "node"])
    groups = full.groupBy("spot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return groups.agg(F.collect_list(member).alias("members")).where(F.size("members") > 1).select("spot", "members")


def _close(spot: int, m: pa.StructArray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of members and of those after them that signatures do not rule out: in different components, and of the
    spots that both share this is the first, so that a pair is looked at once and not in every spot."""
    root, block = m.field("root").to_numpy(), m.field("block").to_numpy()
    signed = np.frombuffer(b"".join(m.field("signature").to_pylist()), np.uint8).reshape(len(m), -1)
    bands = m.field("spots").flatten().to_numpy().reshape(len(m), BANDS)
    whole = block.min() == block.max()
    for i in range(len(m) - 1):
        later = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (whole | (block[i + 1 :] != block[i])))
        later = later[(signed[later] == signed[i]).sum(axis=1) >= SIGNED * BANDS * ROWS]
        if len(later):
            yield i, later[bands[i, (bands[later] == bands[i]).argmax(axis=1)] == spot]


def _within_spots(at: DataFrame, nodes: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (u, v) that tie what members of a spot (at: spot, node, root) link between different components. Members are
    compared by their signatures first; sets (of given nodes) go only to those who then have a partner left."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for spot, group in zip(b.column("spot").to_pylist(), b.column("members"), strict=True):
                m = group.values
                some = np.zeros(len(m), bool)
                for i, later in _close(spot, m):
                    some[later] = True
                    some[i] |= len(later) > 0
                met = pa.array(some)
                left = [m.field(c).filter(met) for c in ("node", "root", "size")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), spot), pa.int64()), *left], ["spot", "node", "root", "size"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for spot, group in zip(b.column("spot").to_pylist(), b.column("members"), strict=True):
                m = group.values
                node, root = (m.field(c).to_numpy() for c in ("node", "root"))
                shingled = [np.frombuffer(x.as_buffer(), np.uint64) for x in m.field("shingles")]
                up = {r: r for r in root.tolist()}

                def find(x: int) -> int:
                    while up[x] != x:  # noqa: B023
                        up[x] = x = up[up[x]]  # noqa: B023
                    return x

                for i, later in _close(spot, m):
                    for k in later.tolist():
                        one, two = find(int(root[i])), find(int(root[k]))
                        if one != two and alike(shingled[i], shingled[k]):
                            up[two] = one
                            out.append((node[i], node[k]))
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["u", "v"])

    signed = nodes.select("node", "signature", "spots")
    sized = at.join(nodes.select("node", "size"), "node")
    with batches_of(at.sparkSession, 32):
        few = staged(_blocks(sized, signed, F.lit(MEMBER)).mapInArrow(likely, "spot long, node long, root long, size long").distinct())
        whole = sets(few.select("node").distinct()).join(signed, "node")
        return staged(_blocks(few, whole, MEMBER + 8 * F.col("size")).mapInArrow(linked, "u long, v long").distinct())


def kept_rows(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row, as its number in column `row_col`: that of the smallest doc_id (null ids come last),
    and of repeated ids the smallest number."""
    rows = near_copies(docs, id_col, text_col, row_col)
    best = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), row_col))
    return rows.groupBy("root").agg(best[row_col].alias(row_col)).select(row_col)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, component_id (the smallest doc_id reachable over links); with `row_col`, that
    column and root, the component's name, too."""
    more = [F.col("row").alias(row_col), "root"] if row_col else []
    if not row_col:
        row_col = own_name(docs, "facetry_row")
        docs = row_numbers(docs, row_col)
    texts = docs.select(F.col(row_col).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(node(s), *spots(s), len(s)) for s in (shingles(t.as_py()) for t in b.column("text"))]
            fps = np.fromiter((simhash(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows).view(np.int64)
            columns = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1].view(np.int64) for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.binary()), pa.array([m[3] for m in made], pa.int64()), pa.array(fps)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *columns], ["row", "doc_id", "node", "spots", "signature", "size", "fp"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(node, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    rows = staged(texts.mapInArrow(hashed, "row long, doc_id long, node long, spots array<long>, signature binary, size long, fp long"))
    nodes = staged(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("spots", "signature", "size")], F.min("fp").alias("fp")))
    emitted = nodes.select("node", F.explode("spots").alias("spot"))
    shared = emitted.groupBy("spot").agg(F.count("*").alias("n")).where("n > 1").select("spot")
    met = staged(emitted.join(shared, "spot"))

    def sets(wanted: DataFrame) -> DataFrame:
        few = staged(nodes.join(wanted, "node", "left_semi").select("row"))
        few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
        return staged(texts.join(few, "row", "left_semi").select("text").mapInArrow(whole, "node long, shingles binary"))

    def checked(tried: DataFrame) -> DataFrame:
        likely = staged(_signed(tried, nodes))
        return staged(_verified(likely, sets(likely.select(F.explode(F.array("u", "v")).alias("node")).distinct())))

    # what fingerprints link: sets of one fingerprint with the least of them, and those of fingerprints within four bits
    heads = staged(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    alone = nodes.join(heads, "fp").where("node <> head").select(F.least("node", "head").alias("u"), F.greatest("node", "head").alias("v"))
    tied = links(heads.select("fp")).join(head("u"), "u").join(head("v"), "v").select(F.least("u_head", "v_head").alias("u"), F.greatest("u_head", "v_head").alias("v"))
    ties = checked(staged(alone.unionByName(tied).distinct()))
    roots = staged(components(ties))
    at, gained = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), True
    for turn in range(STARS + 1):
        # spots where more than one component meets, and the pairs between their components
        sizes = at.groupBy("spot", "root").agg(F.count("*").alias("n")).groupBy("spot")
        sizes = sizes.agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"), F.count("*").alias("roots")).where("roots > 1")
        at = staged(at.join(sizes.select("spot", "pairs"), "spot"))
        left = at.groupBy("spot").agg(F.first("pairs").alias("pairs")).agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]
        if not left:
            break
        last = turn > 0 and (left <= PAIRS or not gained) or turn == STARS
        if last:
            ties = ties.unionByName(_within_spots(at.select("spot", "node", "root"), nodes, sets))
            break
        hub = at.groupBy("spot").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(turn))).alias("hub"))
        pairs = at.join(hub, "spot").where("root <> hub.root").select("spot", F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v"))
        tried = staged(pairs.select("u", "v").distinct())
        found = checked(tried)
        gained = found.count() >= GAIN * tried.count()
        ties = ties.unionByName(found)
        roots = staged(components(ties))
        # only spots go on of which some pair is still in two components
        side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        ruled = tried.join(found, ["u", "v"], "left_anti").join(side("u"), "u", "left").join(side("v"), "v", "left")
        ruled = staged(ruled.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v"))
        open_spots = staged(pairs.join(ruled, ["u", "v"], "left_semi").select("spot").distinct())
        at = staged(at.drop("root", "pairs").join(open_spots, "spot", "left_semi"))
        at = at.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    tied = nodes.join(components(ties), "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    tied = staged(tied)
    found = tied.join(tied.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "root", "component_id")
    return rows.select("row", "doc_id", "node").join(found, "node").select("doc_id", "component_id", *more)
