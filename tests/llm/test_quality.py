import random
import zlib

import numpy as np
import pytest

from alertloom.llm import quality
from alertloom.llm.quality import Model, features, fit, keep_good, quality_scores

FOLDER = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.NAMES)))
    y = ((x[:, 0] > .5) ^ (x[:, 3] > .5)).astype(float)
    model = fit(x[:3000], y[:3000])
    assert auc(model.score(x[3000:]), y[3000:]) > .97
    assert {frozenset(p[:2]) for p in model.pairs} >= {frozenset((0, 3))}


def test_scores_are_sums_of_cells():
    model = Model(0.5, [np.array([1.0])], [np.array([-1.0, 2.0])], [np.array([1.0])], [(0, 0, np.array([[1.0, 9], [9, 3.0]]))])
    want = 1 / (1 + np.exp(-np.array([0.5 - 1 + 1, 0.5 + 2 + 3])))
    assert np.allclose(model.score(np.array([[0.0], [1.0]])), want)


def test_one_class_and_no_labels():
    x = np.zeros((3, len(quality.NAMES)))
    assert np.allclose(fit(x, np.ones(3)).score(x), 0.8)
    assert np.allclose(fit(x[:0], np.ones(0)).score(x), 0.5)


def test_features_of_odd_texts():
    for text in ("", " ", "\n\n", "É", "x" * 200_000):
        assert len(features(text.encode())) == len(quality.NAMES) and np.isfinite(features(text.encode())).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    test = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    score, y = map(np.array, zip(*test))
    assert auc(score, y) > .95
    assert ((score >= .3) == y).mean() > .9
    assert all(r.predicted == (r.score >= .3) for r in rows.values())


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality_scores(docs, labels).collect()) == sorted(quality_scores(docs, flipped).collect())


def test_nulls_repeats_and_clashes(spark):
    rng = random.Random(1)
    rows = [(i, ("fine words here " if i % 2 else "$$$ !!! ### ") * rng.randint(1, 40), "score", None) for i in range(60)]
    rows += [(3, rows[3][1], "score", 1), (None, None, None, None), (99, "", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, x int").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(60) if i % 2}
    assert quality_scores(docs.limit(0), labels).count() == 0 and keep_good(docs, labels.limit(0)).count() == len(rows)
