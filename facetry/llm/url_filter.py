"""URL filter: longest matching block or allow rule, found through a cascade of Bloom filters.

A rule is (verdict, host, path); it fits its host and every subdomain when the url's path starts with the rule's.
Each url offers a few keys, one per host suffix with as many labels as some rule's host and path prefix as long as
some rule's path; a rule fits exactly when its key is among them. The listed keys are encoded in level 0; the keys
of the corpus that pass it without being listed are encoded in level 1, the listed keys that pass level 1 in level
2, and so on until a level lets nothing wrong through. Membership is then exact over the corpus's complete key
universe and is read from a few filters of bounded size; no table is joined to the urls. Where a level would be larger
than `most_bits`, the keys are dealt by their hash into as many parts as needed, each with a cascade of its own, and the
parts judge the urls one after another, so that no task ever holds more than one part's filters.

Defined cases: a null url, or one without ``://``, has empty host and path and takes the default; a url with no
rule is allowed; among fitting rules the longest host + path wins, then the longer host; a rule listed both ways
blocks; repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: (verdict, host, path) of the registered query; fixed values.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Bits per key, hashes per key, and the largest level: 8 MB.
BITS, HASHES, MOST_BITS = 12, 6, 1 << 26


def host_path(url: str) -> tuple[Column, Column]:
    """Host and path of a url column."""
    u = F.col(url)
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"(?s)^([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = u.isNotNull() & F.contains(u, F.lit("://"))
    return F.when(known, lower).otherwise(""), F.when(known, path).otherwise("")


def _spots(key: Column, level: int, bits: int) -> list[Column]:
    """Bit numbers of a key: double hashing with two seeds per level."""
    a, b = (F.xxhash64(key, F.lit(2 * level + i)).bitwiseAND(F.lit((1 << 40) - 1)) for i in (0, 1))
    return [F.pmod(a + b * F.lit(i), F.lit(bits)) for i in range(HASHES)]


class TooLarge(Exception):
    """A level needs more than the largest filter."""


def _level(keys: DataFrame, level: int, n: int, most_bits: int) -> tuple[Column, int]:
    """A Bloom filter over n keys as one array of 63-bit words."""
    bits = 63 * max(2, math.ceil(n * BITS / 63))
    if bits > most_bits:
        raise TooLarge
    spots = keys.select(F.explode(F.array(*_spots(F.col("key"), level, bits))).alias("s"))
    words = spots.groupBy(F.floor(F.col("s") / 63).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 63).cast("int"))).alias("v")
    )
    full = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    array = full.select(
        F.transform(F.sequence(F.lit(0), F.lit(bits // 63 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("f")
    )
    return staged(array.coalesce(1)).scalar(), bits


class Cascade:
    """Exact membership of the listed keys within a universe of keys."""

    def __init__(self, name: str, listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS):
        """listed, universe: one string column named key. Only keys of the universe that pass level 0 are shuffled."""
        self.name, self.levels = name, []
        listed = staged(listed.distinct())
        if not (n := listed.count()):
            return
        self.levels.append(_level(listed, 0, n, most_bits))
        passing = self._passing(universe, 0).distinct()
        tagged = listed.select("key", F.lit(1).alias("tag")).unionByName(passing.select("key", F.lit(0).alias("tag")))
        known = staged(tagged.groupBy("key").agg((F.max("tag") == 1).alias("listed")))
        wrong = staged(known.where(~F.col("listed")).select("key"))
        right = known.where("listed").select("key")
        while n := wrong.count():
            level = len(self.levels)
            self.levels.append(_level(wrong, level, n, most_bits))
            wrong, right = staged(self._passing(right, level)), wrong

    def _passing(self, keys: DataFrame, level: int) -> DataFrame:
        words = keys.select("key", self.levels[level][0].alias(f"{self.name}{level}"))
        return words.where(self._passes(F.col("key"), level)).select("key")

    def _passes(self, key: Column, level: int) -> Column:
        spots = _spots(key, level, self.levels[level][1])
        hits = F.lit(True)
        for s in spots:
            word = F.element_at(f"{self.name}{level}", (F.floor(s / 63) + 1).cast("int"))
            hits = hits & (F.getbit(word, (s % 63).cast("int")) == 1)
        return hits

    def attached(self, df: DataFrame) -> DataFrame:
        """df with one column for each level's words, which contains() reads."""
        return df.select("*", *[words.alias(f"{self.name}{i}") for i, (words, _) in enumerate(self.levels)])

    def contains(self, key: Column) -> Column:
        """The first level that turns a key away decides: an even one says no, an odd one yes."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def cascades(name: str, listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS) -> list[Cascade]:
    """One cascade for each part of the keys; as many parts as keep every level within most_bits."""
    parts = 1
    while True:
        own = lambda keys, i: keys if parts == 1 else keys.where(_part(F.col("key"), parts) == i)  # noqa: B023, E731
        try:
            return [Cascade(name, own(listed, i), own(universe, i), most_bits) for i in range(parts)]
        except TooLarge:
            parts *= 2


def marked(df: DataFrame, names: list[str], verdict: str, each: list[Cascade]) -> DataFrame:
    """df with the verdict in column v<name> of every key column whose key is listed and that has none yet."""
    for i, cascade in enumerate(each):
        found = [F.coalesce(f"v{k}", F.when(((_part(F.col(k), len(each)) == i) if len(each) > 1 else F.lit(True)) & cascade.contains(F.col(k)), verdict)).alias(f"v{k}") for k in names]
        rest = [c for c in df.columns if c not in {f"v{k}" for k in names}]
        df = cascade.attached(df).select(*rest, *found)
        if len(each) > 1:
            df = staged(df)
    return df


def url_filter(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", most_bits: int = MOST_BITS
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    host, path = host_path("url")
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    shapes = sorted({(len(h.split(".")), len(p)) for _, h, p in rules})
    if not shapes:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    ends = {n: F.array_join(F.slice(labels, -n, n), ".") for n, _ in shapes}
    keys = [F.when((F.size(labels) >= n) & (F.char_length("path") >= m), F.concat(ends[n], F.substring("path", 1, m))) for n, m in shapes]
    offered = urls.select("page_id", "host", "path", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    names = [f"k{i}" for i in range(len(keys))]
    universe = offered.select(F.explode(F.array_compact(F.array(*names))).alias("key"))
    listed = spark.createDataFrame([(v, h + p) for v, h, p in rules], "verdict string, key string")
    judged = offered.select("*", *[F.lit(None).cast("string").alias(f"v{k}") for k in names])
    for verdict in ("block", "allow"):
        judged = marked(judged, names, verdict, cascades(verdict, listed.where(F.col("verdict") == verdict).select("key"), universe, most_bits))
    fits = [
        F.when(F.col(f"v{k}").isNotNull(), F.struct(F.char_length(k).alias("length"), (F.char_length(k) - m).alias("host_length"), F.col(k).alias("key"), F.col(f"v{k}").alias("verdict")))
        for k, (_, m) in zip(names, shapes, strict=True)
    ]
    best = F.array_max(F.array(*fits))
    return judged.select("page_id", "host", "path", best.alias("best")).select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict")
    )


SQL = r"""
WITH r(verdict, host, path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS h FROM u),
p AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) AS path FROM v),
m AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS n
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.n = 1
"""
