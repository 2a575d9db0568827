import random
import re

import numpy as np
import pytest
import xxhash

from alertloom.llm.bktree import Forest
from alertloom.llm.graph import components
from alertloom.llm.simhash import drop_near_duplicates, fingerprint, links, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprint():
    rng = random.Random(2)
    for text in ["", " \n", "One", "A b", "a b c d", "É x\x0by z w \x1c q", "a\x85b c d e f"]:
        assert fingerprint(text.encode()) == slow_print(text), text
    for n in (5, 6, 40, 700):
        text = " ".join(rng.choice(["Ab", "c", "dé", "f\n"]) for _ in range(n))
        assert fingerprint(text.encode()) == slow_print(text)


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(3)
    values, tree = [], []
    for t in range(6):
        base = rng.integers(0, 2**63, dtype=np.uint64)
        for _ in range(int(rng.integers(1, 60))):
            values.append(int(base) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))))
            tree.append(t)
    values, tree = np.array(values, np.uint64), np.array(tree)
    forest = Forest(values, tree)
    roots = np.array([forest.root_of[t] for t in tree.tolist()])
    got = {(int(q), int(v)) for qs, vs in forest.search(values, roots, 4) for q, v in zip(qs, vs)}
    want = {(i, j) for i in range(len(values)) for j in range(len(values))
            if tree[i] == tree[j] and int(values[i] ^ values[j]).bit_count() <= 4}
    assert got == want


@pytest.mark.parametrize("tree_size", [4, 4096])
def test_links_connect_like_all_pairs(spark, tree_size):
    rng = random.Random(9)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            values.add(v)
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                v ^= 1 << b
    values = sorted(values)
    pairs = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    prints = spark.createDataFrame([(signed(v),) for v in values], "print long")
    got = [(r.a % 2**64, r.b % 2**64) for r in links(prints, tree_size=tree_size).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in got)
    assert roots_of(values, got) == roots_of(values, pairs)


def test_components(spark):
    rng = random.Random(4)
    nodes = list(range(400))
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(250)] + [(i, i + 1) for i in range(900, 1000)] + [(2000, i) for i in range(2001, 2200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = [p for p in pairs if p[0] != p[1]]
    want = roots_of({n for p in linked for n in p}, linked)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus(seed=6):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        words = [rng.choice(["red", "green", "Blue", "sky", "été", "tree"]) for _ in range(rng.choice([1, 3, 4, 50, 200]))]
        for _ in range(rng.choice([1, 1, 3])):
            rows.append((len(rows) + 10, " ".join(words)))
            if len(words) > 20:
                words[rng.randrange(len(words))] = "changed"
    return rows + [(5, None), (6, ""), (7, " \n"), (12, rows[2][1]), (12, rows[2][1]), (None, "red green alone text"), (None, None)]


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    prints = [slow_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = roots_of(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[root[p]] = min(doc, least.get(root[p], doc))
    want = sorted(((doc, f"{p:016x}", least.get(root[p])) for (doc, _), p in zip(rows, prints)), key=str)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, print int, root int").repartition(4)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == want
    kept = drop_near_duplicates(docs).collect()
    assert len(kept) == len(set(root.values())) and set(kept[0].asDict()) == {"doc_id", "text", "print", "root"}
    assert {r.doc_id for r in kept} == set(least.values()) | {None} & {r.doc_id for r in kept}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0 and drop_near_duplicates(docs).count() == 0
