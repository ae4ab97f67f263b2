"""Best-fit packing of tokenised documents into sequences by bin completion.

A document's stream is its token ids and an end id; only longer streams are cut, into pieces of the full sequence
length and a rest. Pieces are dealt by a hash into groups of about `group_pieces`, and every group is packed by one
task: the better of best-fit decreasing and one dive is the incumbent, then branch and bound completes one sequence at
a time around the longest piece left. All undominated fillings are enumerated lazily, of any number of pieces, least
waste first, and a branch ends when the waste so far shows that it cannot beat the incumbent. A group that reaches the
lower bound (its tokens over the length, rounded up) stops at once. Only `nodes`, the search steps per piece, ends the
search before it is complete; each row reports its group's sequences and lower bound, which shows how far that may be
from the best. Many groups cost at most a partly filled sequence each.

Defined cases: a null text counts as empty and is packed as its end id alone; repeated rows are packed each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import staged, text_or_empty

#: NODES: search steps per piece after which a group keeps its best packing.
LENGTH, GROUP_PIECES, NODES = 2048, 20_000, 20
#: Texts that are encoded together.
BATCH = 256
#: Most remembered chunks per worker; further ones are encoded anew: about 130 MB, which an idle worker still holds.
REMEMBERED = 500_000
#: Texts without such a character are encoded by their white-space chunks; lower-casing and NFC act on each alike.
OTHER = re.compile(r"[^\t-\r\x20-\x7e\xa1-\xff]")
#: The words that the tokenizer cuts a chunk into; a fixed value of the vocabulary's file.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Ids:
    """Token ids of a text as little-endian 32-bit words, remembering the ids of white-space chunks."""

    def __init__(self, path: str):
        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunks(self, new: list[str]) -> dict[str, bytes]:
        """Ids of many chunks by one call; they are told apart by the words' last tokens."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        words = np.cumsum([1 if c.isalpha() else len(WORDS.findall(c)) for c in new])
        if not len(ends) or len(ends) != words[-1] or ends[-1] != len(ids):
            return {c: self.whole(c) for c in new}
        at, data = [0, *(4 * ends[words - 1]).tolist()], ids.tobytes()
        return {c: data[a:b] for c, a, b in zip(new, at, at[1:], strict=False)}

    def batch(self, texts: list[str]) -> list[bytes]:
        known, plain = self.known, [None if OTHER.search(t) else t.lower().split() for t in texts]
        new = set().union(*filter(None, plain)).difference(known)
        found = {c: self.whole(c) for c in new if "<|" in c}
        if rest := [c for c in new if c not in found]:
            found |= self.chunks(rest)
        full = len(known) + len(found) > REMEMBERED
        known |= found
        out = [self.whole(t) if p is None else b"".join(map(known.__getitem__, p)) for t, p in zip(texts, plain, strict=True)]
        if full:  # this batch's chunks are not remembered
            for c in found:
                del known[c]
        return out


@functools.cache
def ids_of(path: str) -> Ids:
    """One memory per worker and file."""
    return Ids(path)


def pieces(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a map over the texts. `tokenizer_path`: a tokenizers file; by default
    the public word_bpe_49k.json, found on each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        ids, end = ids_of(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for first in range(0, len(b), BATCH):
                some = b.iloc[first : first + BATCH]
                keys = some["doc_id"].astype(object).where(some["doc_id"].notna(), None)
                for key, data in zip(keys, ids.batch(list(some["text"])), strict=True):
                    data += end
                    for i, at in enumerate(range(0, len(data), 4 * length)):
                        part = data[at : at + 4 * length]
                        out.append((key, i, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Counts:
    """How many pieces of each length are left, with the lengths that occur as bits of one integer."""

    def __init__(self, counts: dict[int, int], length: int):
        self.n, self.length, self.has, self.back = dict(counts), length, 0, 0
        for x in counts:
            self._mark(x)

    def _mark(self, x: int) -> None:
        self.has ^= 1 << x
        self.back ^= 1 << (self.length - x)

    def take(self, x: int) -> None:
        self.n[x] -= 1
        if not self.n[x]:
            self._mark(x)

    def put(self, x: int) -> None:
        self.n[x] += 1
        if self.n[x] == 1:
            self._mark(x)

    def longest(self, most: int) -> int:
        """The longest length left of at most `most`, or 0."""
        return (self.has & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.has & ((2 << most) - 1) else 0

    def least(self) -> int:
        """The shortest length left, or 0."""
        return (self.has & -self.has).bit_length() - 1 if self.has else 0

    def pairs(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        """Every two pieces of that total, none longer than `most`, the longest first."""
        if total < 2:
            return
        both = self.has & (self.back >> (self.length - total)) & ((2 << most) - 1)
        while both:
            a = both.bit_length() - 1
            if a * 2 < total:
                return
            if a * 2 > total or self.n[a] > 1:
                yield a, total - a
            both ^= 1 << a


class _Spent(Exception):
    """The nodes are used up."""


class _Budget:
    def __init__(self, nodes: int):
        self.nodes = nodes

    def use(self) -> bool:
        self.nodes -= 1
        return self.nodes >= 0


def _exact(left: _Counts, total: int, budget: _Budget) -> Iterator[tuple[int, ...]]:
    """Every multiset of the pieces left with that total: one piece, two, then more, the longest first. While a
    filling is out, `left` is as it was; it has to be so again when the next one is asked for."""
    if left.n.get(total, 0):
        yield (total,)
    chosen: list[int] = []
    rooms, following = [total], [total]
    entered = True
    while rooms:
        if not budget.use():
            for x in chosen:
                left.put(x)
            raise _Spent
        room, most = rooms[-1], following[-1]
        if entered:
            for two in list(left.pairs(room, min(room, chosen[-1] if chosen else room))):
                for x in chosen:
                    left.put(x)
                yield (*chosen, *two)
                for x in chosen:
                    left.take(x)
        a = left.longest(min(most, room - 2 * left.least()))
        if a:
            following[-1] = a - 1
            left.take(a)
            chosen.append(a)
            rooms.append(room - a)
            following.append(a)
            entered = True
        else:
            rooms.pop()
            following.pop()
            if chosen:
                left.put(chosen.pop())
            entered = False


def dominated(left: _Counts, filling: tuple[int, ...], waste: int) -> bool:
    """Can a piece that is not in the filling be added, or replace a shorter one, or two or more of at most its length,
    within the waste? Then the filling with that piece leaves no more to do than this one. `left` has the filling taken out."""
    none, one, more = 1, 0, 0  # sums of no, one, and several of the filling's pieces, as bits
    for x in filling:
        more |= (more | one) << x
        one |= none << x
    wide, step = more, 1
    while step <= waste:
        wide |= wide << min(step, waste + 1 - step)
        step *= 2
    longer, step = one << 1 if waste else 0, 1
    while step < waste:
        longer |= longer << min(step, waste - step)
        step *= 2
    return bool(left.has & (wide | longer | ((2 << waste) - 2)))


def completions(left: _Counts, room: int, budget: _Budget) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of the room, one at a time, least waste first."""
    total = sum(x * n for x, n in left.n.items() if n) if left.least() and left.least() * 64 > room else room + 1
    if total <= room:  # all that is left fits
        yield tuple(x for x, n in left.n.items() for _ in range(n))
        return
    if not left.longest(room):
        yield ()
        return
    for waste in range(room - left.least() + 1):
        for filling in _exact(left, room - waste, budget):
            for x in filling:
                left.take(x)
            bad = dominated(left, filling, waste)
            for x in filling:
                left.put(x)
            if not bad:
                yield filling


def _greedy(left: _Counts, room: int) -> tuple[int, ...]:
    """Best fit: the longest piece that fits, again and again."""
    filling = []
    while x := left.longest(room):
        filling.append(x)
        left.take(x)
        room -= x
    for x in filling:
        left.put(x)
    return tuple(filling)


def dive(counts: dict[int, int], length: int = LENGTH, effort: int = 200) -> list[tuple[int, ...]]:
    """An incumbent: each sequence, around the longest piece left, takes its first filling that is found within
    `effort` nodes, or else best fit's."""
    left, out = _Counts(counts, length), []
    while first := left.longest(length):
        left.take(first)
        try:
            filling = next(completions(left, length - first, _Budget(effort)))
        except _Spent:
            filling = _greedy(left, length - first)
        for x in filling:
            left.take(x)
        out.append((first, *filling))
    return out


def best_fit(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, ...]]:
    """The incumbent: each piece, longest first, goes where the least room is left."""
    rooms: dict[int, list[int]] = {}
    has, bins = 0, []
    for x in sorted(counts, reverse=True):
        for _ in range(counts[x]):
            fitting = has >> x
            if fitting:
                room = x + (fitting & -fitting).bit_length() - 1
                k = rooms[room].pop()
                if not rooms[room]:
                    has ^= 1 << room
            else:
                room, k = length, len(bins)
                bins.append([])
            bins[k].append(x)
            if room > x:
                if not rooms.setdefault(room - x, []):
                    has |= 1 << (room - x)
                rooms[room - x].append(k)
    return [tuple(b) for b in bins]


def lower_bound(counts: dict[int, int], length: int = LENGTH) -> int:
    return -(-sum(x * n for x, n in counts.items()) // length)


def pack(counts: dict[int, int], length: int = LENGTH, nodes: int = NODES) -> list[tuple[int, ...]]:
    """Fillings that use every piece, in the fewest sequences; `nodes` search steps per piece at most, and without
    having reached them the result is the least possible."""
    total, bound = sum(x * n for x, n in counts.items()), lower_bound(counts, length)
    best = min(best_fit(counts, length), dive(counts, length), key=len)
    left, path, waste, budget = _Counts(counts, length), [], 0, _Budget(nodes * sum(counts.values()))
    stack: list[tuple[int, Iterator[tuple[int, ...]]]] = []
    try:
        while len(best) > bound:
            first = left.longest(length)
            if not first:
                if len(path) < len(best):
                    best = list(path)
            elif waste <= (len(best) - 1) * length - total:
                left.take(first)
                stack.append((first, completions(left, length - first, budget)))
                path.append(())
            while stack:  # the next filling of the deepest sequence that has one
                first, options = stack[-1]
                if path[-1]:
                    for x in path[-1][1:]:
                        left.put(x)
                    waste -= length - sum(path[-1])
                filling = next(options, None)
                if filling is not None:
                    path[-1] = (first, *filling)
                    for x in filling:
                        left.take(x)
                    waste += length - sum(path[-1])
                    break
                left.put(first)
                stack.pop()
                path.pop()
            if not stack:
                break
    except _Spent:
        pass
    return best


def packed(parts: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES, nodes: int = NODES) -> DataFrame:
    """parts with sequence_id and offset, and the sequences and lower bound of its group; every input column stays."""
    groups = max(1, round(parts.count() / group_pieces))
    grouped = parts.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        lengths = df["length"].to_numpy()
        values, at, n = np.unique(-lengths, return_index=True, return_counts=True)
        following = {-int(v): int(a) for v, a in zip(values, at, strict=True)}
        row_bin, offset = np.zeros(len(df), np.int64), np.zeros(len(df), np.int64)
        counts = {-int(v): int(c) for v, c in zip(values, n, strict=True)}
        fillings = pack(counts, length, nodes)
        for k, filling in enumerate(fillings):
            place = 0
            for x in filling:
                i = following[x]
                following[x] += 1
                row_bin[i], offset[i] = k, place
                place += x
        df["sequence_id"], df["offset"] = (df["pack_group"].to_numpy() << 32) + row_bin, offset
        df["group_sequences"], df["group_bound"] = len(fillings), lower_bound(counts, length)
        return df.drop(columns="pack_group")

    new = [F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset", "group_sequences", "group_bound")]
    return grouped.groupBy("pack_group").applyInPandas(run, parts.select("*", *new).schema)


def best_fit_packing(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, nodes: int = NODES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, group_sequences, group_bound."""
    return packed(staged(pieces(docs, tokenizer_path, id_col, text_col, length)), length, nodes=nodes)
