"""Fingerprints against exact Jaccard similarity, by text length."""

import random

import numpy as np
import pytest
from facetry.llm import fingerprint


def _sets(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("length", [3, 12, 40, 100, 400])
def test_likeness_is_exact_at_every_length(length):
    rnd = random.Random(length)
    for _ in range(20):
        a = [f"w{rnd.randrange(10**6)}" for _ in range(length)]
        b = a[: length - length // 4] + [f"v{rnd.randrange(10**6)}" for _ in range(length // 4)]
        exact = len(_sets(a) & _sets(b)) / len(_sets(a) | _sets(b))
        assert fingerprint.likeness(*(fingerprint.sketch(" ".join(x)) for x in (a, b))) == exact


@pytest.mark.parametrize("scale", [1, 16])
def test_sketches_merge(scale):
    texts = [" ".join(f"w{i}{j}" for j in range(8)) for i in range(60)]
    for text in texts:
        assert (fingerprint.sketch(text, scale=scale) < (1 << 64) / scale).all()
    merged = np.unique(np.concatenate([fingerprint.sketch(t, scale=scale) for t in texts]))
    every = np.unique(np.concatenate([fingerprint.sketch(t, scale=1) for t in texts]))
    assert merged.tolist() == [x for x in every.tolist() if x < (1 << 64) // scale]


def test_runs_of_neighbours(spark, monkeypatch):
    """Short runs, with one text longer than a run, judge every neighbour once."""
    monkeypatch.setattr(fingerprint, "CHUNK", 100)
    rnd = random.Random(1)
    texts = [" ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.choice([1, 6, 20, 90]))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in fingerprint.edits_and_neighbours(docs).collect()}
    s = [fingerprint.sketch(t) for t in texts]
    assert got == {i: fingerprint.likeness(s[i], s[(i + 1) % 40]) for i in range(40)}
