"""The pipeline's stages, each against what its operator says about its own input."""

import corpus_pipeline
from collections import Counter

import pytest

from facetry.llm import packing

from .test_operators import SCHEMA, TEXTS


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _least_of_near(rows):
    """Ids that stay: of each component of similarity 0.8 the smallest, by all pairs."""
    root, sets = {i: i for i, _ in rows}, {i: _shingles(t) for i, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            either = len(sets[i] | sets[j])
            if i < j and (len(sets[i] & sets[j]) >= 0.8 * either):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in root if find(i) == i}


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, now, str(tmp_path)).write.parquet(path)
        seen[name] = now, spark.read.parquet(path)
        now = seen[name][1]
        if name != "packing":
            assert now.columns == docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["language"]
    lettered = {i for i, t, *_ in TEXTS if any(c.isalpha() for c in t or "")}
    assert {i for i in lettered if i < 104} <= ids(after) <= lettered
    before, after = seen["exact"]
    best = {}
    for r in before.collect():
        key = "".join((r.text or "").split())
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert ids(after) == {i for _, i in best.values()}
    before, after = seen["near"]
    assert ids(after) == _least_of_near([(r.doc_id, r.text or "") for r in before.collect()])
    before, after = seen["private"]
    assert ids(after) == ids(before) and "[EMAIL]" in after.where("doc_id = 120").first().text
    before, after = seen["packing"]
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in after.collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packing.pieces(before).collect()}
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == ids(after)


@pytest.mark.parametrize("stage", ["exact", "near"])
def test_repeated_and_missing_ids(spark, tmp_path, stage):
    """Rows are told apart whatever their ids: no unique text goes, one of each group stays."""
    rows = [(1, "same text"), (3, "same text"), (3, "unique text"), (None, "same text"), (None, "dup"), (None, "dup"), (None, None), (7, "")]
    spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], SCHEMA + ", facetry_row string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, "same text"), (3, "unique text"), (None, "dup"), (7, "")])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
