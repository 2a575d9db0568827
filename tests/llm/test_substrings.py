import hashlib
import random
import re

import numpy as np
import pytest

from alertloom.llm.substrings import Windows, kept_words, leftmost_minima, rolling, substring_digest

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    texts = [(d if d is not None else -(2**63), WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for (doc, _), (d, w) in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (d, i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([19, 20, 21, 60]))) for _ in range(5)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 19, 20, 80])))
        for _ in range(rng.choice([0, 1, 2])):
            text += "\t" + rng.choice(passages) + " \n" + rng.choice(vocabulary)
        rows.append((i * 3, text))
    rows += [(500, rows[7][1]), (501, "tick " * 70), (502, "tick tock " * 40), (500, rows[7][1]), (12, rows[9][1]), (None, passages[4]),
             (503, None), (504, ""), (505, " é\x85x\x1c ")]
    return rows


@pytest.mark.parametrize("log_cells", [4, 20])
def test_equals_brute_force(spark, log_cells):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, first string").repartition(5)
    got = sorted(map(tuple, substring_digest(docs, log_cells=log_cells).collect()), key=str)
    assert got == brute(rows, 20)
    assert sum(r[2] for r in got) > 500


def test_kept_text(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, f"c {passage} d\ne")], "doc_id int, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in kept_words(docs, log_cells=16).collect()}
    assert got == {1: f"a {passage} b", 2: "c d e"}


def test_empty(spark):
    assert substring_digest(spark.createDataFrame([], "doc_id long, text string"), log_cells=10).count() == 0


def test_minima_and_rolling():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 13):
        assert leftmost_minima(values, width).tolist() == [i + int(np.argmin(values[i:i + width])) for i in range(200 - width + 1)]
    h = rolling(values, 20, np.uint64(0x9E3779B97F4A7C15))
    again = rolling(np.concatenate([values[:3], values]), 20, np.uint64(0x9E3779B97F4A7C15))
    assert (h == again[3:]).all()


def test_anchor_counts_never_below_window_counts():
    texts = [("tick " * 60).encode(), ("tick tock " * 30).encode(), b"one two"]
    found = Windows(texts, 20, 8)
    k0, k1 = found.keys(np.arange(len(found.at)))
    anchors = np.repeat(np.arange(len(found.anchor)), found.run)
    for key in set(zip(k0.tolist(), k1.tolist())):
        own = [a for a, x, y in zip(anchors, k0.tolist(), k1.tolist()) if (x, y) == key]
        value = found.anchor[own[0]]
        assert all(found.anchor[a] == value for a in own)
        assert (found.anchor == value).sum() >= len(own)
