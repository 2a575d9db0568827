"""The sketch of operator 4 grows with the input: unique texts do not pass it, however many there are."""

import random

import pytest

from alertloom.llm import substrings as S


@pytest.mark.parametrize("n", [40, 640])
def test_unique_windows_do_not_pass_a_grown_sketch(spark, n):
    rng = random.Random(n)
    words = 100
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(words))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert S.candidates(docs, 20, 8, 10).count() < 0.05 * n * (words - 19)


def test_one_passage_in_very_many_texts(spark, monkeypatch):
    """Lots are cut small, so that the passage's first start lies in another lot than most of its others."""
    monkeypatch.setattr(S, "HASHES_AT_ONCE", 50)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: bytes(r.kept).decode() for r in S.kept_words(docs, log_cells=6).collect()}
    assert got == {i: rows[i][1] if i == 0 else f"a{i} b{i}" for i, _ in rows}
