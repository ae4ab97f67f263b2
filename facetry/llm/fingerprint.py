"""Document fingerprints: a threshold-scaled sketch (a fixed fraction of all shingle hashes).

The shingles are five consecutive words; a text of one to four words is one shingle. Every distinct hash below
2**64 / `scale` is retained and no other, so the union of sketches is the sketch of the union, sketches of very unequal
documents can be merged and compared, and containment and likeness are found by counting. The default scale of 1
retains all: any smaller fraction leaves short texts next to no hashes. With a larger scale they are estimates, and a
short text's sketch may be empty.

Defined cases: a null text counts as empty; two empty sketches have likeness 1, an empty and a non-empty one 0;
equal texts have equal fingerprints; repeated ids are ordered by their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from xxhash import xxh3_64_intdigest

from .common import packed, staged, text_or_empty, unpacked

WORDS, SCALE = 5, 1
#: Characters of one staged run of neighbours.
CHUNK = 500_000


def sketch(text: str | None, words: int = WORDS, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles below 2**64 / scale."""
    parts = (text or "").encode("utf-8", "surrogatepass").split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    out = np.full(len(parts) - k + 1, k, np.uint64)
    for i in range(k):  # mixes the words' hashes in their order
        out = (out ^ h[i : len(parts) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out[out <= np.uint64((1 << 64) // scale - 1)])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two shingle sets; exact, as both retain the hashes below one threshold."""
    return np.union1d(a, b)


def shown(s: np.ndarray) -> str:
    return ",".join(f"{x:x}" for x in s.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the two shingle sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's shingles that b holds too."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def edited(text: str, after: str) -> str:
    """The second half replaced by as much of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, fingerprint: one map over the whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_chars": b["text"].map(len), "fingerprint": [shown(sketch(t, words, scale)) for t in b["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COLS = [c.split()[0] for c in _ROW.split(", ")]


def _judged(key, text: str, own: np.ndarray, after: str, other: np.ndarray) -> tuple:
    new = edited(text, after)
    s = sketch(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), sha, shown(own), shown(s), likeness(own, s), likeness(own, other)


def edits_and_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and the next document by ascending id (the first after the last).

    One range-partitioned sort puts neighbours beside each other. Runs of them are staged as compressed texts, each
    run beginning with the last row of the one before, and judged as they are read, so no sketch is staged. The first
    and last row of each task are set aside, at most two per partition, and joined by rank."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = packed(rows.withColumn("tie", F.xxhash64("text")))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, begun, chunk, size = TaskContext.get().partitionId(), False, [], 0
        for b in batches:
            for key, text in zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None), map(unpacked, b["text"]), strict=True):
                if not begun:
                    begun = True
                    yield _frame((None, 0, part, key, text))
                chunk.append((key, text))
                size += len(text)
                if len(chunk) > 1 and size > CHUNK:
                    yield _frame((_tight(chunk), *(None,) * 4))
                    chunk, size = chunk[-1:], len(text)
        if len(chunk) > 1:
            yield _frame((_tight(chunk), *(None,) * 4))
        if chunk:
            yield _frame((None, 1, part, *chunk[-1]))

    def _tight(chunk: list[tuple]) -> bytes:
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(chunk))

    def _frame(row: tuple) -> pd.DataFrame:
        df = pd.DataFrame([row], columns=["chunk", "edge", "part", "edge_id", "edge_text"])
        return df.astype({c: "Int64" for c in ("edge", "part", "edge_id")})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk in b["chunk"]:
                pairs = pickle.loads(zstandard.decompress(chunk))
                sketches = (sketch(text) for _, text in pairs)
                out, own = [], next(sketches)
                for (key, text), (_, after), other in zip(pairs, pairs[1:], sketches):
                    out.append(_judged(key, text, own, after, other))
                    own = other
                yield pd.DataFrame(out, columns=_COLS).astype({"doc_id": "Int64"})

    done = staged(ordered.mapInPandas(run, "chunk binary, edge int, part int, edge_id long, edge_text string"))
    edges = done.where("edge IS NOT NULL").select("edge", "part", "edge_id", "edge_text")
    parts = edges.select("part").distinct().select("part", F.row_number().over(Window.orderBy("part")).alias("rank"))
    parts = parts.withColumn("then", F.col("rank") % parts.agg(F.count("*")).scalar() + 1)
    ends = edges.where("edge = 1").join(F.broadcast(parts), "part")
    starts = edges.where("edge = 0").join(F.broadcast(parts), "part").select(F.col("rank").alias("then"), F.col("edge_text").alias("after"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = b["edge_id"].astype(object).where(b["edge_id"].notna(), None)
            out = [_judged(k, t, sketch(t), a, sketch(a)) for k, t, a in zip(keys, b["edge_text"], b["after"], strict=True)]
            yield pd.DataFrame(out, columns=_COLS).astype({"doc_id": "Int64"})

    wrapped = ends.join(starts, "then").select("edge_id", "edge_text", "after").mapInPandas(finish, _ROW)
    return done.where("edge IS NULL").select("chunk").mapInPandas(judge, _ROW).unionByName(wrapped)
