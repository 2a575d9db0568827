import zlib
from collections import Counter

from alertloom.llm.sharding import interleave, shard_digest


def make(spark, n=2000):
    rows = [(i, f"text {i} é" if i % 7 else None, "hot" if i % 3 == 0 else f"s{i % 5}", 9) for i in range(n)]
    rows += [(5, "text 5 é", "s0", 9)] * 2 + [(None, "x", None, 9), (n, "", "", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(6), rows


def test_law_slots_and_mixture(spark):
    docs, rows = make(spark)
    got = shard_digest(docs).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(
        ((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _, _ in rows), key=str)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    source = {d: s for d, _, s, _ in rows}
    share = Counter(source.values())
    for s in counts:
        own = Counter(source[r.doc_id] for r in got if r.shard == s)
        assert all(abs(own[k] - share[k] * counts[s] / len(rows)) < 2.5 for k in share)


def test_same_result_for_other_partitions(spark):
    docs, _ = make(spark, 300)
    assert sorted(map(str, shard_digest(docs).collect())) == sorted(map(str, shard_digest(docs.coalesce(1)).collect()))
    assert sorted(map(str, interleave(docs, seed=1).collect())) != sorted(map(str, interleave(docs, seed=2).collect()))


def test_few_rows_and_none(spark):
    docs, _ = make(spark, 300)
    few = interleave(docs.limit(3)).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}
    assert interleave(docs.limit(0)).count() == 0
