import numpy as np
import pytest

from alertloom.llm.neighbours import KdTree, box_distance, chi_square_below, nearest_neighbours, stop_factor


def brute(ids, v, every, k):
    out = {}
    norm = np.sqrt((v * v).sum(1))
    for i in np.flatnonzero(ids % every == 0):
        s = (v * v[i]).sum(1) / (norm * norm[i])
        own = sorted(((-x, j) for x, j in zip(s.tolist(), ids.tolist()) if j != ids[i]))[:k]
        out[int(ids[i])] = [(j, -x) for x, j in own]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_chi_square():
    assert abs(chi_square_below(20.090, 8) - .99) < 1e-4
    assert abs(stop_factor(.99, 8) - 20.090) < 1e-2


def test_kd_tree():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.random((500, 3)), np.ones((200, 3)), np.zeros((1, 3))])
    tree = KdTree(points, 16)
    assert sorted(np.concatenate(tree.order).tolist()) == list(range(len(points)))
    leaf = tree.leaf_of(points)
    low, high = tree.regions(3)
    for k, own in enumerate(tree.order):
        assert (leaf[own] == k).all() and (points[own] >= low[k]).all() and (points[own] <= high[k]).all()
    assert (box_distance(points[5], low, high)[leaf[5]]) == 0


@pytest.mark.parametrize("shard_rows", [100, 4096])
def test_recall_against_brute_force(spark, shard_rows, monkeypatch):
    monkeypatch.setattr("alertloom.llm.neighbours.SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 24))
    v = (centres[rng.integers(0, 20, 1200)] + .5 * rng.standard_normal((1200, 24))).astype(np.float32).astype(np.float64)
    v[600:900] = v[0]  # one vector a quarter of all rows
    ids = np.arange(1200) * 5
    rows = spark.createDataFrame([(int(i), x.tolist(), 1, "s") for i, x in zip(ids, v)], "vec_id long, embedding array<float>, leaf int, rank string")
    got, want = ranked(nearest_neighbours(rows.repartition(4))), brute(ids, v, 50, 5)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= .95 * sum(map(len, want.values()))
    exact = {q: dict(p) for q, p in brute(ids, v, 50, len(ids)).items()}
    assert all(abs(s - exact[q][j]) < 1e-12 for q, own in got.items() for j, s in own)
    assert got[0] == want[0]  # ties go to the smaller ids


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (50, [0.0, 2.0]), (50, [0.0, 2.0]), (100, None)]
    got = ranked(nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert {q: [j for j, _ in own] for q, own in got.items()} == {0: [1, 50], 50: [1, 0]}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest_neighbours(none).count() == 0
