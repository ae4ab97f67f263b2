"""Names that do not meet and row numbers that do not move."""

from collections import Counter

import corpus_pipeline
import numpy as np
from facetry.llm import common, recompression

from .test_operators import SCHEMA


def test_texts_whose_sums_meet(spark):
    """Even words in Thue-Morse order and its complement: polynomials modulo 2^64 are equal, no window is shared."""
    n = 4096
    bits = [bin(i).count("1") % 2 for i in range(n // 2)]
    texts = [" ".join(w for i, b in enumerate(bits) for w in ("ab"[b ^ side], f"u{side}-{i}")) for side in (0, 1)]
    got = recompression.substring_dedup(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_removed) for r in got} == {(0, n, 0), (1, n, 0)}
    h = np.random.default_rng(0).integers(0, 1 << 63, 2, dtype=np.uint64)
    ends = np.array([0, n // 4]), n // 4
    words = np.concatenate([h[bits[: n // 4]], h[[1 - b for b in bits[: n // 4]]]])
    names = recompression.window_names(words, *ends, 3)
    assert names[0] != names[1]


def test_rows_keep_their_numbers(spark, tmp_path):
    """The exact stage drops the same rows however the scan is split between its jobs."""
    rows = [(i, f"text {i % 4000}", "en", "s", 1) for i in range(5000)]
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    out = dict(corpus_pipeline.STAGES)["exact"](spark, docs, str(tmp_path))
    kept = {"spark.sql.leafNodeDefaultParallelism": "40", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "4096"}
    before = {k: spark.conf.get(k, None) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        got = Counter(r.text for r in out.collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == Counter(f"text {i}" for i in range(4000))


def test_numbers_of_other_tables(spark, tmp_path):
    """A table that is no scan of files is staged; columns keep their names and order."""
    one = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, facetry_row string")
    joined = one.join(spark.range(2))
    got = common.only_kept(joined, lambda rows, row: rows.where("doc_id = 1"))
    assert got.columns == joined.columns and got.count() == 4
    numbers = [r.no for r in common.row_numbers(joined, "no").collect()]
    assert len(set(numbers)) == 6
