"""SentencePiece encoding and decoding with a max-plus parallel scan over giant documents.

The public model is a BPE one. A sequence of pieces is its encoding exactly if every two neighbouring pieces are what
BPE makes of their own joined text; so the encoding is the best path of a lattice in which a pair of pieces weighs 0
if it is stable and minus infinity if not, and a max-plus (here 0 or minus infinity) scan finds it. Documents of more
than `giant` characters are cut into chunks anywhere, even inside a word. The states at a boundary are the pieces
that cover its last character; each chunk's task, not knowing what came before, computes the transfer matrix from
every possible entry state to the exit states. The matrices of a document are few and sparse; they are combined by an
associative max-plus product, first within blocks of `BLOCK` chunks, then over the blocks of a document; that gives
each block and then each chunk its entry and exit state, and each chunk is traced back by itself. Shorter documents are encoded whole by the library in one map.

Defined cases: a null or empty text has no ids; characters outside the vocabulary become byte pieces; white space is
kept as the model does; repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

GIANT, CHUNK = 65_536, 8_192
#: Chunks whose matrices are multiplied together first, and chunks of one task.
BLOCK, TASK = 64, 16
_BLANK = "▁"


class Lattice:
    """The model's pieces, and which pairs of them are stable."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        special = [i for i in range(n) if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)]
        self.ids = {self.library.id_to_piece(i): i for i in range(n)}
        for i in special:
            del self.ids[self.library.id_to_piece(i)]
        self.score = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.bytes = {b: self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.stable = functools.lru_cache(500_000)(lambda a, b: self.merged(a + b) == [a, b])
        self.whole = functools.lru_cache(200_000)(lambda a: self.merged(a) == [a])

    def merged(self, text: str) -> list[str]:
        """BPE: the pair of the best joined piece first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def starting(self, text: str, at: int) -> list[str]:
        """The pieces that text may go on with at a place; a single character always is one."""
        out = [text[at]]
        for end in range(at + 2, min(len(text), at + self.longest) + 1):
            if (p := text[at:end]) in self.ids and self.whole(p):
                out.append(p)
        return out

    def entries(self, text: str, at: int) -> list[tuple[int, int]]:
        """The pieces that cover the character before a place, as (start, end)."""
        return [(a, a + len(p)) for a in range(max(0, at - self.longest), at) for p in self.starting(text, a) if a + len(p) >= at]

    def paths(self, text: str, start: tuple[int, int] | None, stop: int) -> tuple[dict, set]:
        """From a state on: the predecessor of each piece reached, and the pieces that cover the character before stop."""
        before, ends, done = {}, {}, set()
        if start is not None and start[1] >= stop:
            return before, {start}
        todo = [start]
        ends[start[1] if start else 0] = todo
        for at in range(start[1] if start else 0, stop):
            for last in ends.pop(at, ()):
                for p in self.starting(text, at):
                    if last is not None and not self.stable(text[last[0] : last[1]], p):
                        continue
                    now = (at, at + len(p))
                    before[now] = last
                    if now[1] >= stop:
                        done.add(now)
                    else:
                        ends.setdefault(now[1], []).append(now)
        return before, done

    def numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return out


@functools.cache
def lattice(path: str | None) -> Lattice:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Lattice(path)


def product(a: dict, b: dict) -> dict:
    """The max-plus product of two transfer matrices, {entry: {exit: weight}} with weights of 0; what is missing is
    minus infinity. It is associative."""
    return {i: {k: 0 for j in row for k in b.get(j, ())} for i, row in a.items()}


def transfer(l: Lattice, text: str, begin: int, end: int, base: int, first: bool) -> dict:  # noqa: E741
    """Of the chunk [begin, end) of text, whose place in the document is base: exits by entry, in document places."""
    states = [None] if first else l.entries(text, begin)
    shift = lambda s: s and (s[0] + base, s[1] + base)
    return {shift(s): {shift(x): 0 for x in l.paths(text, s, end)[1]} for s in states}


def _states(b: pd.DataFrame, first: tuple | None, last: tuple | None) -> list[tuple]:
    """Entry and exit of each of the rows' matrices, in order, on a best path from state first to state last (the
    text's end where it is None): products of the prefixes from the left, then one step back at a time."""
    each = [pickle.loads(m) for m in b["matrix"]]
    reached, prefix = [], {first: {first: 0}}
    for m in each:
        prefix = product(prefix, m)
        reached.append(set(prefix[first]))
    state = last or next(x for x in reached[-1] if x[1] == int(b["length"].iloc[-1]))
    out = []
    for n in range(len(each) - 1, -1, -1):
        entry = first if n == 0 else next(s for s in reached[n - 1] if state in each[n].get(s, ()))
        out.append((entry, state))
        state = entry
    return out[::-1]


def _chunks(b: pd.DataFrame, longest: int, chunk: int) -> Iterator[tuple]:
    for key, row, text in zip(b["doc_id"], b["row"], b["text"], strict=True):
        whole = _BLANK + text.replace(" ", _BLANK)
        for i, at in enumerate(range(0, len(whole), chunk)):
            low = max(0, at - longest)
            yield key, row, i, low, at - low, min(at + chunk, len(whole)) - low, whole[low : at + chunk + longest]


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (array<int>): one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    large = F.char_length("text") > giant

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = lattice(model_path).library
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.iloc[at : at + 256]
                yield pd.DataFrame({"doc_id": some["doc_id"], "ids": library.encode(list(some["text"]), num_threads=1)})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in _chunks(b, lattice(model_path).longest, chunk):
                yield pd.DataFrame([c], columns=["doc_id", "row", "i", "base", "begin", "end", "text"])

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [pickle.dumps(transfer(lattice(model_path), t, s, e, base, i == 0)) for t, s, e, base, i in zip(b["text"], b["begin"], b["end"], b["base"], b["i"], strict=True)]
            yield b[["row", "i"]].assign(length=b["base"] + b["end"], matrix=made)

    def block(b: pd.DataFrame) -> pd.DataFrame:
        """The product of a block's matrices."""
        b = b.sort_values("i")
        whole = functools.reduce(product, map(pickle.loads, b["matrix"]))
        return pd.DataFrame({"row": b["row"].iloc[:1], "block": b["i"].iloc[:1] // BLOCK, "length": b["length"].max(), "matrix": [pickle.dumps(whole)]})

    def over_blocks(b: pd.DataFrame) -> pd.DataFrame:
        """Each block's entry and exit state in its document."""
        b = b.sort_values("block")
        return pd.DataFrame([(r, n, pickle.dumps(x)) for r, n, x in zip(b["row"], b["block"], _states(b, None, None), strict=True)], columns=["row", "block", "states"])

    def within_block(b: pd.DataFrame) -> pd.DataFrame:
        """Each chunk's entry and exit state, from its block's."""
        b = b.sort_values("i")
        first, last = pickle.loads(b["states"].iloc[0])
        return pd.DataFrame([(r, n, pickle.dumps(x)) for r, n, x in zip(b["row"], b["i"], _states(b, first, last), strict=True)], columns=["row", "i", "states"])

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, row, i, base, end, text, states in zip(*(b[c] for c in ("doc_id", "row", "i", "base", "end", "text", "states")), strict=True):
                l = lattice(model_path)  # noqa: E741
                start, at = ((x and (x[0] - base, x[1] - base)) for x in pickle.loads(states))
                before, pieces = l.paths(text, start, end)[0], []
                while at != start:
                    pieces.append(text[at[0] : at[1]])
                    at = before[at]
                out.append((key, row, i, l.numbers(pieces[::-1])))
            yield pd.DataFrame(out, columns=["doc_id", "row", "i", "ids"])

    n_giant = rows.where(large).count()
    done = rows.where(~large).mapInPandas(small, "doc_id long, ids array<int>")
    if not n_giant:
        return done
    chunks = staged(rows.where(large).withColumn("row", F.monotonically_increasing_id()).mapInPandas(cut, "doc_id long, row long, i int, base long, begin int, end int, text string"))
    tasks = max(1, -(-chunks.count() // TASK))
    spread = chunks.repartition(tasks, "row", "i")
    made = staged(spread.mapInPandas(matrices, "row long, i int, length long, matrix binary"))
    by_block = made.groupBy("row", F.floor(F.col("i") / BLOCK).alias("n"))
    blocks = by_block.applyInPandas(block, "row long, block int, length long, matrix binary")
    entered = blocks.groupBy("row").applyInPandas(over_blocks, "row long, block int, states binary")
    states = made.withColumn("block", F.floor(F.col("i") / BLOCK).cast("int")).join(entered, ["row", "block"])
    states = staged(states.groupBy("row", "block").applyInPandas(within_block, "row long, i int, states binary"))
    traced = spread.join(states, ["row", "i"]).repartition(tasks, "row", "i").mapInPandas(trace, "doc_id long, row long, i int, ids array<int>")
    joined = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("all"))
    return done.unionByName(joined.select("doc_id", F.flatten("all.ids").alias("ids")))


def decode(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = lattice(model_path).library
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.iloc[at : at + 256]
                ids = [np.asarray(x, "<u4") for x in some["ids"]]
                yield pd.DataFrame({"doc_id": some["doc_id"], "n_ids": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids], "text": library.decode([x.tolist() for x in ids])})

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id long, n_ids long, ids_crc32 long, text string")


def encoded_and_decoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256: the ids of every whole text and the text that they decode to."""
    return decode(encode(docs)).select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
