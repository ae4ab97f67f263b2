"""Steps of the near-copy stage: fingerprints come first, and each pair of members is looked at once."""

import numpy as np
import pyarrow as pa

from facetry.llm import near_copies

TEXT = " ".join(f"w{i}" for i in range(200))


def test_fingerprints_link_first(spark, monkeypatch):
    """Sets of one fingerprint or of fingerprints within four bits are linked where the sets agree."""
    real, seen = near_copies.links, []
    monkeypatch.setattr(near_copies, "links", lambda fps: seen.append(fps.count()) or real(fps))
    texts = [TEXT, TEXT + " more", "other words are in this text of ten words here"]
    assert (near_copies.simhash(texts[0]) ^ near_copies.simhash(texts[1])).bit_count() <= 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == {0: 0, 1: 0, 2: 2}
    assert seen and seen[0] >= 2


def test_a_pair_is_looked_at_in_its_first_spot_only():
    made = [near_copies.spots(near_copies.shingles(TEXT + x)) for x in ("", " more")]
    shared = [int(s) for s in np.intersect1d(made[0][0], made[1][0]).view(np.int64)]
    members = pa.array([{"root": i, "block": 0, "signature": g, "spots": k.view(np.int64).tolist()} for i, (k, g) in enumerate(made)])
    assert len(shared) > 5
    assert sum(len(later) for s in shared for _, later in near_copies._close(s, members)) == 1
