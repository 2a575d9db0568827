"""The SimHash side of the near-dedup stage: its BK-trees alone find near copies."""

import random

import numpy as np

from alertloom.llm import jaccard
from alertloom.llm.simhash import RADIUS, fingerprint
from tests.llm.test_jaccard import kept


def test_fingerprints_bring_candidates(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(1500)]
        rows.append((2 * i, " ".join(words)))
        words[700] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    prints = [fingerprint(t.encode(), jaccard.SHINGLE) for _, t in rows]
    near = [(a ^ b).bit_count() <= RADIUS for a, b in zip(prints[::2], prints[1::2])]
    assert sum(near) >= 6

    def no_bands(own):  # texts meet in no band unless they are equal
        return np.full(jaccard.BANDS, int(own.sum()) >> 1, np.int64)

    monkeypatch.setattr(jaccard, "band_keys", no_bands)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in jaccard.drop_similar(docs).collect()}
    assert got == {d for d, _ in rows} - {2 * i + 1 for i, n in enumerate(near) if n}
    monkeypatch.undo()
    assert {r.doc_id for r in jaccard.drop_similar(docs).collect()} == set(kept(rows)) == {2 * i for i in range(12)}
