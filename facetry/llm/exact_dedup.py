"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after all white space of ``[\\x20\\x09-\\x0D]`` is deleted. A
frequent-items sketch (the Misra-Gries family, Spark's ``approx_top_k``) names the digests that fill much of the
table; their exact sizes and winners are computed with map-side combining, and at most ``heavy_items`` rows of them
are broadcast, so their rows never meet in one task. The remaining digests take an ordinary shuffle of narrow rows.

Defined cases: a null text counts as empty; all empty texts are one group; among equal texts the one with the most
code points in its original form stays, then the smallest doc_id, null ids last; rows that repeat a doc_id and its
text share one verdict; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, staged, text_or_empty

_LAST = (1 << 63) - 1


def _sizes(rows: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("n_points")).alias("shorter"), F.coalesce("doc_id", F.lit(_LAST)).alias("rank"), "row", "doc_id"))
    return rows.groupBy("text_sha256").agg(best["doc_id"].alias("keep_id"), best["row"].alias("keep_row"), F.count("*").alias("group_size"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_items: int = 256, sketch_items: int = 4096, row_col: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. With `row_col`, a column that numbers the
    rows, it is returned too and exactly one row of each group is kept, that of the least number among repeated ids."""
    text = text_or_empty(text_col)
    rows = staged(
        docs.select(
            (F.col(row_col) if row_col else F.lit(0)).cast("long").alias("row"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.char_length(text).cast("long").alias("n_points"),
            F.sha2(F.regexp_replace(text, SPACES, ""), 256).alias("text_sha256"),
        )
    )
    top = rows.agg(F.expr(f"approx_top_k(text_sha256, {heavy_items}, {sketch_items})").alias("top"))
    frequent = top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("text_sha256"))
    heavy = F.broadcast(staged(_sizes(rows.join(F.broadcast(frequent), "text_sha256", "left_semi"))))
    rest = rows.join(heavy, "text_sha256", "left_anti")
    kept = F.col("row") == F.col("keep_row") if row_col else F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return (
        rows.join(heavy, "text_sha256")
        .unionByName(rest.join(_sizes(rest), "text_sha256"))
        .select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", *([F.col("row").alias(row_col)] if row_col else []))
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
