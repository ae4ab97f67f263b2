"""The near-copy stage against all pairs of exact five-word similarity."""

import random

import corpus_pipeline
import pytest
from facetry.llm import near_copies, simhash


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _texts():
    rnd = random.Random(3)
    out = []
    for _ in range(30):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([30, 120, 400]))]
        out.append(" ".join(words))
        for _ in range(3):
            words = list(words)
            for _ in range(max(1, len(words) * rnd.choice([1, 2, 4]) // 200)):
                words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**9)}"
            out.append(" ".join(words))
    return [*out, "", " \n", "one two", "One  two", "one three"]


@pytest.mark.parametrize("bound", [0, 10**9])
def test_near_stage_against_all_pairs(spark, monkeypatch, bound):
    monkeypatch.setattr(near_copies, "PAIRS", bound)
    texts = _texts()
    sets = list(map(_shingles, texts))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    wide = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                wide += (simhash.simhash(texts[i]) ^ simhash.simhash(texts[j])).bit_count() > 4
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert wide > 10  # pairs that fingerprints within four bits do not link
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == {find(i) for i in range(len(texts))}
    assert near_copies.near_copies(docs.where("false")).count() == 0
