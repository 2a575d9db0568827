"""The near-dedup stage of the pipeline against brute-force Jaccard."""

import random

import numpy as np
import pytest

import corpus_pipeline
from alertloom.llm.jaccard import BANDS, ROWS, band_keys, drop_similar, shingles
from tests.llm.test_simhash import WORD, roots_of


def sets(text, k=5):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    texts = sorted({t or "" for _, t in rows})
    own = [sets(t) for t in texts]
    root = roots_of(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if alike(own[i], own[j])])
    at = {t: root[i] for i, t in enumerate(texts)}
    first = {}
    for doc, text in rows:
        r, key = at[text or ""], 2**63 if doc is None else doc
        first[r] = min(first.get(r, key), key)
    return sorted(first.values())


def corpus(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rng.randrange(90)) for _ in range(rng.choice([1, 4, 5, 12, 60, 60, 300]))]
        for _ in range(rng.choice([1, 2, 4, 9])):
            rows.append((len(rows) + 10, " ".join(words)))
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "new" + str(rng.randrange(999))
    rng.shuffle(rows)
    return rows + [(5, None), (6, ""), (7, " \n"), (900, rows[2][1].upper()), (901, rows[2][1]), (None, "alone in the world of texts"), (None, None)]


@pytest.mark.parametrize("cut_rows", [2, 512])
def test_equals_brute_force(spark, cut_rows):
    rows = corpus(8)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int").repartition(3)
    got = drop_similar(docs, cut_rows).collect()
    assert sorted(2**63 if r.doc_id is None else r.doc_id for r in got) == kept(rows)
    assert set(got[0].asDict()) == {"doc_id", "text", "root"}


def test_stage_links_at_four_fifths(spark):
    """Pairs that share more than 0.8 but lie beyond four SimHash bits go; those below 0.8 stay."""
    rng = random.Random(1)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(104)]
        rows.append((2 * i, " ".join(words)))
        for at in (10, 50) if i % 2 else (10, 40, 70):  # 10 or 15 of 100 shingles change: 90/110 or 85/115
            words[at] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == set(kept(rows)) == {d for d, _ in rows} - {d for d, _ in rows if d % 4 == 3}


def test_bands_meet_at_four_fifths():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(10, 400)) * 9
        own = np.unique(rng.integers(0, 2**64 - 1, n * 10 // 9, dtype=np.uint64))
        a, b = own[rng.permutation(len(own))], None
        a, b = np.sort(a[:n]), np.sort(a[len(own) - n:])
        both = len(np.intersect1d(a, b))
        assert 5 * both >= 4 * (len(a) + len(b) - both) * .99
        assert (band_keys(a) == band_keys(b)).any()
    assert (1 - .8 ** ROWS) ** BANDS < 1e-6
    assert len(shingles(b" ")) == len(shingles(b"one two")) == 1


def test_empty(spark):
    assert drop_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
