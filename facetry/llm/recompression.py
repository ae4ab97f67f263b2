"""Substring deduplication by recompression.

Words are named by a hash of their bytes, so equal words have equal names everywhere. The first round names runs of
one word; each of the rounds after it names pairs, a symbol of the left half of a hash-split alphabet followed by one of
the right half. Each symbol carries the interval of words that its making depends on; wherever those words occur, the
same symbol is made, so equal substrings have the same interior symbols. Names are hashes, so all tasks agree on them
without a shuffle; what Spark's rounds settle globally is which of them are shared.

A text's top symbol names all its words (128 bits of a SHA-256). Texts of one top symbol repeat each other from end to end: those of
the smallest id go on to the windows, of the others all words go.

The symbols of a level fall into `PARTS` classes by name, which thins them out. A window takes the highest level that
has a symbol whose interval lies inside, of it the first class that has one, and all symbols of that class inside it; a
window without any is its own symbol. Equal windows take the same symbols. So a window can occur in two
documents only if *all* its symbols do. Spark finds the symbols that several documents share (counts combined on the
map side), brings them to their documents, and only for windows all of whose symbols are shared shuffles the windows'
own names to find the smallest doc_id that has each: two of 64 bits each, from two independent hashes of each word.
Names of inner symbols are sums modulo 2^64; two that meet by chance only let more windows be compared. A word goes if a covering window occurs in a document of
smaller id. Names that fill much of a table (at most `common.HEAVY`) are joined by broadcast, all others by shuffle.

Defined cases: rows are told apart by their id and the hash of their text, so rows that repeat an id keep their own
words and their own verdict (rows that repeat both are judged alike); a null text has no words; texts shorter than a
window keep all words; repeats within one document, or among rows of one id, stay; rows without an id come after all
others and not before each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import BROADCAST_ROWS, joined_to_counted, release, staged, text_or_empty

WINDOW, ROUNDS, PARTS = 13, 3, 8
#: Texts that are parsed together, and their bytes, which bound a worker's memory (one longer text goes alone).
BATCH, BYTES = 64, 1 << 19
_LAST = (1 << 63) - 1
#: An odd base of the symbols' names. Where two symbols of different words meet in one name, more windows are compared.
_BASE = 0xD1342543DE82EF95
_FAR = np.int64(1 << 40)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Symbols:
    """A parse: names with the interval of words [low, high) that each depends on."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.low, self.high = name, low, high

    def runs(self, salt: int) -> Symbols:
        """Runs of a symbol become one, named by symbol and length; that a run ends depends on its neighbours."""
        first = np.flatnonzero(np.concatenate([[True], self.name[1:] != self.name[:-1]]))
        last = np.concatenate([first[1:], [len(self.name)]]) - 1
        n = (last - first + 1).astype(np.uint64)
        name = np.where(n > 1, _mix(self.name[first] + n, salt), self.name[first])
        low, high = np.concatenate([[-_FAR], self.low[:-1]]), np.concatenate([self.high[1:], [_FAR]])
        return Symbols(name, low[first], high[last])

    def pairs(self, salt: int) -> Symbols:
        """A left symbol and the right symbol after it become one; of the others each depends on the side it faces."""
        left = (_mix(self.name, salt) & np.uint64(1)).astype(bool)
        at = np.flatnonzero(left[:-1] & ~left[1:])
        low, high = self.low.copy(), self.high.copy()
        alone = np.flatnonzero(~left[1:]) + 1
        low[alone] = np.minimum(low[alone], self.low[alone - 1])
        alone = np.flatnonzero(left[:-1])
        high[alone] = np.maximum(high[alone], self.high[alone + 1])
        if not left[0]:
            low[0] = -_FAR
        if left[-1]:
            high[-1] = _FAR
        name = self.name.copy()
        name[at] = _mix(self.name[at] * np.uint64(3) + _mix(self.name[at + 1], salt + 1), salt)
        low[at], high[at] = np.minimum(self.low[at], self.low[at + 1]), np.maximum(self.high[at], self.high[at + 1])
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        return Symbols(name[keep], low[keep], high[keep])


class Names:
    """Names of all substrings of a word sequence, by prefix sums."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        power = np.full(n + 1, base, np.uint64)
        back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        power[0] = back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.cumprod(power)[:-1], out=self.sums[1:])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _mix((self.sums[high] - self.sums[low]) * self.back[low] + (high - low).astype(np.uint64), 77)


def _spread(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """How many of the ranges [a, b] hold each of 0..n-1."""
    return np.cumsum(np.bincount(a, minlength=n + 1)[: n + 1] - np.bincount(b + 1, minlength=n + 1)[: n + 1])[:n]


class Parsed:
    """Some texts with their windows and the symbols that the windows take."""

    def __init__(self, texts: list[str], window: int = WINDOW):
        self.words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        self.window, flat = window, []
        for i, w in enumerate(self.words):
            flat.append(xxh3_64_intdigest(i.to_bytes(8, "little"), 1))  # parts the texts: no window has it
            flat += map(xxh3_64_intdigest, w)
        flat.append(xxh3_64_intdigest(b"end", 1))
        self.hashes = h = np.array(flat, np.uint64)
        n, self.n_windows = len(h), np.array([max(0, len(w) - window + 1) for w in self.words])
        self.begins = np.cumsum([1, *(len(w) + 1 for w in self.words)])[:-1]
        self.valid = np.zeros(n, bool)
        for at, many in zip(self.begins.tolist(), self.n_windows.tolist(), strict=True):
            self.valid[at : at + many] = True
        names, place = Names(h, _BASE), np.arange(n, dtype=np.int64)
        levels, now = [], Symbols(h, place, place + 1).runs(1)
        for r in range(ROUNDS):
            now = now.pairs(2 * r + 2)
            levels.append(now)
        need = self.valid.copy()
        #: By level: the window starts [first, last] that have each symbol inside, and the symbol's name.
        self.taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in reversed(levels):
            short = (level.high - level.low <= window) & (level.low >= 0) & (level.high <= n)
            low, high = level.low[short], level.high[short]
            first, total = np.maximum(high - window, 0), np.concatenate([[0], np.cumsum(need)])
            name = names.of(low, high)
            part = (name >> np.uint64(40)) % np.uint64(PARTS)
            for p in range(PARTS):
                own = np.flatnonzero(part == p)
                serves = own[total[low[own] + 1] > total[first[own]]]
                self.taken.append((first[serves], low[serves], name[serves]))
                need &= _spread(first[serves], low[serves], n) == 0
                if p + 1 < PARTS:
                    np.cumsum(need, out=total[1:])
        alone = np.flatnonzero(need)
        self.taken.append((alone, alone, names.of(alone, alone + window)))

    def symbols(self) -> list[np.ndarray]:
        """Each text's symbols, without repeats."""
        place = np.concatenate([low for _, low, _ in self.taken])
        name = np.concatenate([name for _, _, name in self.taken])
        of = np.searchsorted(self.begins, place, side="right") - 1
        order = np.lexsort((name, of))
        of, name = of[order], name[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (name[1:] != name[:-1])
        of, name = of[new], name[new]
        return np.split(name, np.searchsorted(of, np.arange(1, len(self.words))))

    def shared(self, wanted: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose symbols are among the text's wanted ones: text, start in the text, and the two names."""
        n, alive, need = len(self.hashes), self.valid.copy(), self.valid.copy()
        text = np.repeat(np.arange(len(wanted), dtype=np.uint64), [len(x) for x in wanted])
        known = np.sort(_mix(np.concatenate(wanted), 3) + _mix(text, 4)) if len(wanted) else np.zeros(0, np.uint64)
        for first, low, name in self.taken:
            of = (np.searchsorted(self.begins, low, side="right") - 1).astype(np.uint64)
            key = _mix(name, 3) + _mix(of, 4)
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            dead = known[at] != key if len(known) else np.ones(len(key), bool)
            alive &= ~(need & (_spread(first[dead], low[dead], n) > 0))
            need &= _spread(first, low, n) == 0
        at = np.flatnonzero(alive)
        of = np.searchsorted(self.begins, at, side="right") - 1
        other = np.zeros(n, np.uint64)
        for text in np.unique(of).tolist():  # a hash of its own for the second name, so that the two are independent
            words = self.words[text]
            other[self.begins[text] : self.begins[text] + len(words)] = np.fromiter((xxh3_64_intdigest(w, 2) for w in words), np.uint64, len(words))
        return of, at - self.begins[of], window_names(self.hashes, at, self.window, 21), window_names(other, at, self.window, 57)


def tops(texts: list[str]) -> list[tuple[int, int]]:
    """The top symbol of each text: the first 128 bits of the SHA-256 of its words, one blank between them."""
    digests = (hashlib.sha256(b" ".join(t.encode("utf-8", "surrogatepass").split())).digest() for t in texts)
    return [(int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:16], "little", signed=True)) for d in digests]


def window_names(hashes: np.ndarray, at: np.ndarray, window: int, salt: int) -> np.ndarray:
    """Names of the windows that start at the given places: their words' hashes mixed one after another, so that no sum
    of one window can stand for another's."""
    name = np.full(len(at), salt, np.uint64)
    for k in range(window):
        name = _mix(name * np.uint64(0xD1342543DE82EF95) + hashes[at + k], salt + k)
    return name


def _in_batches(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list]]:
    first, size, texts = 0, 0, []
    for n, x in enumerate(b["text"]):
        text = zstandard.decompress(x).decode("utf-8", "surrogatepass") if isinstance(x, bytes) else x
        if texts and (len(texts) == BATCH or size + len(text) > BYTES):
            yield b.iloc[first:n], texts
            first, size, texts = n, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield b.iloc[first:], texts


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as compressed bytes, which keeps the shuffles of whole texts small."""
    tight = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield b.assign(text=[tight.compress(t.encode("utf-8", "surrogatepass")) for t in b["text"]])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by spaces)."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")

    def symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for some, texts in _in_batches(b):
                each = Parsed(texts, window).symbols()
                n = [len(x) for x in each]
                yield pd.DataFrame({"symbol": np.concatenate(each).view(np.int64), "doc_id": np.repeat(some["doc_id"].to_numpy(), n), "mark": np.repeat(some["mark"].to_numpy(), n)})

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for some, texts in _in_batches(b):
                yield pd.DataFrame(tops(texts), columns=["one", "two"]).assign(doc_id=some["doc_id"].to_numpy(), mark=some["mark"].to_numpy())

    packed = rows.mapInPandas(_pack, "doc_id long, mark long, text binary")
    named = staged(rows.mapInPandas(top, "one long, two long, doc_id long, mark long"))
    classes = named.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    classes = staged(classes.select("one", "two", "first", "n"))
    copies = staged(joined_to_counted(named, classes, ["one", "two"]).where("doc_id > first").select("doc_id", "mark").distinct())
    release(named, classes)
    if copies.count() <= BROADCAST_ROWS:
        first_texts, first_packed = (x.join(F.broadcast(copies), ["doc_id", "mark"], "left_anti") for x in (rows, packed))
    else:
        first_texts = first_packed = packed.join(copies, ["doc_id", "mark"], "left_anti")
    found = staged(first_texts.mapInPandas(symbols, "symbol long, doc_id long, mark long"))
    shared = found.groupBy("symbol").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    shared = staged(shared.select("symbol", "n"))
    who = F.xxhash64("doc_id", "mark").alias("who")  # a clash only makes more windows look shared
    hits = staged(joined_to_counted(found.select("symbol", who), shared, ["symbol"]).groupBy("who").agg(F.collect_list("symbol").alias("symbols")))
    release(found, shared)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for some, texts in _in_batches(b):
                wanted = [np.asarray(x, np.int64).view(np.uint64) for x in some["symbols"]]
                of, start, one, two = Parsed(texts, window).shared(wanted)
                yield pd.DataFrame({"one": one.view(np.int64), "two": two.view(np.int64), "doc_id": some["doc_id"].to_numpy()[of], "mark": some["mark"].to_numpy()[of], "start": start.astype(np.int32)})

    seen = staged(first_packed.withColumn("who", who).join(hits, "who").drop("who").mapInPandas(windows, "one long, two long, doc_id long, mark long, start int"))
    first = seen.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    first = staged(first.select("one", "two", "first", "n"))
    again = joined_to_counted(seen, first, ["one", "two"]).where("doc_id > first")
    starts = again.groupBy("doc_id", "mark").agg(F.collect_set("start").alias("starts")).withColumn("whole", F.lit(False))
    starts = staged(starts.unionByName(copies.select("doc_id", "mark", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("whole"))))
    release(hits, seen, first)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for some, texts in _in_batches(b):
                out = []
                for key, text, gone, whole in zip(some["doc_id"], texts, some["starts"], some["whole"], strict=True):
                    words = text.encode("utf-8", "surrogatepass").split()
                    if whole is True and len(words) >= window:
                        kept = []
                    elif gone is not None and len(gone):
                        at = np.array(gone, np.int64)
                        kept = [w for w, n in zip(words, _spread(at, at + window - 1, len(words)).tolist(), strict=True) if not n]
                    else:
                        kept = words
                    joined = b" ".join(kept)
                    out.append((key, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass")))
                yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    done = packed.join(starts, ["doc_id", "mark"], "left").mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != _LAST, F.col("doc_id")))
