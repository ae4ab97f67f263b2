"""Quality rules by host.

Every text is measured whole (words, symbols, repeated lines, words in repeated windows of three), and each rule says of
a document whether it fails. Failures are counted by host; the spread of the hosts' rates gives a beta prior by the
method of moments (from five sums over hosts, so nothing but one row reaches the driver); a host's rate is its posterior
mean, so that a host of few documents is drawn to the rate of all. A host whose rate is above `LIMIT` for some rule
fails, and its verdict is joined back to its documents. A document stays if neither itself nor its host fails.

Hosts that fill more than one in `common.HEAVY` documents are broadcast (fewer than that many), the others are shuffled.

Defined cases: a null text has no word and so fails; a null host is no host: its documents are judged by themselves and
`host_rate` and `host_failed` are null; repeated rows and repeated or null ids are judged each and count each; an empty
table gives an empty result; where all hosts have one rate, or there is one host, the prior is that rate; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_to_counted, staged, text_or_empty

#: A document with fewer words, or with a larger share of words in repeated windows, fails by itself.
LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: A host fails beyond this share of failing documents.
LIMIT = 0.5
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: What a rule counts as a failure. The last two are taken as signs of a bad host only, not against single documents.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}


def measures(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of `_COUNTS`."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    chars = len(text) - sum(map(text.count, _BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more. Windows are numbered exactly, two words and then the third."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    pair = np.unique(ids[:-2] * len(known) + ids[1:-1], return_inverse=True)[1]
    _, window, uses = np.unique(pair * len(known) + ids[2:], return_inverse=True, return_counts=True)
    covered, again = np.zeros(len(words), bool), np.flatnonzero(uses[window] > 1)
    for i in range(3):
        covered[again + i] = True
    return int(covered.sum())


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts of each whole text: one map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([measures(t.as_py()) for t in b.column("text")], np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *map(pa.array, made.T)], ["doc_id", "host", *_COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS))


def _posterior(rule: str, sums: dict) -> Column:
    """A host's mean under the beta prior that the moments of all hosts' rates give."""
    hosts, docs, failed = sums["hosts"], sums["docs"], sums[f"{rule}_all"]
    own = F.col(rule) / F.col("n")
    if not failed or failed == docs:
        return own
    p = failed / docs
    spread = (sums[f"{rule}_squares"] - failed * failed / docs) / (p * (1 - p)) - (hosts - 1)
    room = docs - sums["squares"] / docs - (hosts - 1)
    if spread <= 0 or room <= 0:  # the rates differ no more than chance lets them, or cannot differ
        return F.lit(p)
    strength = max(0.0, room / spread - 1)
    return (F.col(rule) + F.lit(strength * p)) / (F.col("n") + F.lit(strength))


def host_verdicts(rows: DataFrame, limit: float = LIMIT) -> DataFrame:
    """host, n, host_rate (the largest posterior rate over the rules), host_failed; rows are `measured` and staged."""
    fails = [F.count_if(F.expr(sql)).alias(rule) for rule, sql in RULES.items()]
    hosts = staged(rows.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), *fails))
    moments = [f(F.col(r) * k).alias(f"{r}_{n}") for r in RULES for f, k, n in ((F.sum, F.lit(1), "all"), (F.sum, F.col(r) / F.col("n"), "squares"))]
    squares = F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("docs"), squares, *moments).first().asDict()
    rate = F.greatest(*[_posterior(r, sums) for r in RULES])
    return hosts.select("host", "n", F.round(rate, 6).alias("host_rate"), (rate > limit).alias("host_failed"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, kept, host, host_rate, host_failed."""
    rows = staged(measured(docs, id_col, text_col, host_col))
    verdicts = staged(host_verdicts(rows, limit))
    judged = joined_to_counted(rows.where("host IS NOT NULL"), verdicts, ["host"])
    judged = judged.unionByName(rows.where("host IS NULL"), allowMissingColumns=True)
    base = F.expr(f"{RULES['short']} OR {RULES['repeats']}")
    kept = ~base & ~F.coalesce(F.col("host_failed"), F.lit(False))
    return judged.select("doc_id", *_COUNTS, base.alias("base_failed"), kept.alias("kept"), "host", "host_rate", "host_failed")


def _sql() -> str:
    fails = ", ".join(f"count(*) FILTER ({sql}) AS {rule}" for rule, sql in RULES.items())
    moments = ", ".join(f"sum({r}) AS {r}_all, sum({r} * {r} / n) AS {r}_squares" for r in RULES)
    p = {r: f"({r}_all / docs)" for r in RULES}
    spread = {r: f"(({r}_squares - {r}_all * {r}_all / docs) / ({p[r]} * (1 - {p[r]})) - (hosts - 1))" for r in RULES}
    room = "(docs - squares / docs - (hosts - 1))"
    rates = ", ".join(
        f"CASE WHEN {r}_all = 0 OR {r}_all = docs THEN {r} / n WHEN {spread[r]} <= 0 OR {room} <= 0 THEN {p[r]} "
        f"ELSE ({r} + greatest(0, {room} / {spread[r]} - 1) * {p[r]}) / (n + greatest(0, {room} / {spread[r]} - 1)) END"
        for r in RULES
    )
    line = r"regexp_matches(l, '[^\x20\x09-\x0D]')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wd AS (SELECT row_no, unnest(range(1, len(w) - 1)) AS i, w FROM d),
wn AS (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, w[i], w[i + 1], w[i + 2]) AS uses FROM wd),
rp AS (SELECT row_no, count(DISTINCT place) AS n_repeat_words FROM (SELECT row_no, unnest([i, i + 1, i + 2]) AS place FROM wn WHERE uses > 1) GROUP BY row_no),
m AS (SELECT doc_id, host, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda l: {line})) AS n_lines,
  len(list_filter(string_split(text, chr(10)), lambda l: {line})) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: {line}))) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN rp USING (row_no)),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {fails} FROM m WHERE host IS NOT NULL GROUP BY host),
s AS (SELECT CAST(count(*) AS DOUBLE) AS hosts, sum(n) AS docs, sum(n * n) AS squares, {moments} FROM h),
v AS (SELECT host, greatest({rates}) AS host_rate FROM h, s)
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _COUNTS)}, {RULES['short']} OR {RULES['repeats']} AS base_failed,
  NOT ({RULES['short']} OR {RULES['repeats']}) AND NOT coalesce(host_rate > {LIMIT}, false) AS kept, host, round(host_rate, 6) AS host_rate, host_rate > {LIMIT} AS host_failed
FROM m LEFT JOIN v USING (host)"""


SQL = _sql()
