"""The bucketed store: what a batch reads and writes, replays, growth, and the summary that is kept up."""

import os
import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import aggregates as A, identity as I
from alertloom.streaming import jobs as ST
from alertloom.streaming.store import AlertStore, BucketedTable
from tests.test_cases import ALERT, empty, version


def written(folder, version_number):
    """Bytes and files that one version wrote, over all tables of a store."""
    sizes = [
        os.path.getsize(os.path.join(root, f)) for root, _, files in os.walk(folder) for f in files
        if f"data-{version_number:012d}" in root and f.endswith(".parquet")]
    return sum(sizes), len(sizes)


def many(spark, low, high, prefix="k"):
    return spark.range(low, high).selectExpr(
        "id AS seq", "1 AS source_id", f"concat('{prefix}', id) AS source_alert_id", "concat('t', id) AS title", "TIMESTAMP '2024-01-01 00:00:00' AS issued_at",
        "'d' AS description", "'low' AS normalized_severity", "CAST(NULL AS STRING) AS expires_at", "sha2(CAST(id AS STRING), 256) AS content_hash")


@pytest.fixture(scope="module")
def row_schema(spark):
    return empty(spark).schema


def as_versions(spark, df, schema):
    want = {f.name: f.dataType for f in schema}
    cols = [(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in want.items() if n != "id"]
    return df.select(*([F.col("seq")] if "seq" not in want else []), *cols)


def test_a_batch_writes_its_buckets_whatever_the_store(spark, tmp_path, row_schema):
    cost = {}
    for n in (500, 4_000):
        folder = str(tmp_path / f"s{n}")
        rows = as_versions(spark, many(spark, 0, n), row_schema)
        stored = I.apply_upsert(empty(spark), rows, I.classify(rows, empty(spark)))
        job = ST.UpsertJob(spark, stored, folder, bucket_rows=50)
        for batch_id, size in enumerate((2, 8)):
            batch = as_versions(spark, many(spark, 10 + 100 * batch_id, 10 + 100 * batch_id + size).withColumn("content_hash", F.lit("new")), row_schema)
            job(batch, batch_id)
            cost[n, size] = written(folder, batch_id + 1)
            assert job.snapshot().count() == n and job.snapshot().filter("content_hash = 'new'").count() == sum((2, 8)[:batch_id + 1])
    assert cost[4_000, 2][0] < 2 * cost[500, 2][0] and cost[4_000, 8][0] < 2 * cost[500, 8][0]
    assert cost[4_000, 2][1] <= 4 and cost[4_000, 2][0] * 2 < cost[4_000, 8][0]


def test_keyed_table_versions(spark, tmp_path):
    rows = lambda lo, hi, v: spark.range(lo, hi).select("id", F.lit(v).alias("v"))
    table = BucketedTable(spark, str(tmp_path / "t"), rows(0, 100, "a"), "id", bucket_rows=10)
    read = lambda df: {r.id: r.v for r in df.collect()}
    for batch_id, name in enumerate("bcd"):
        keys = rows(batch_id * 3, batch_id * 3 + 2, name)
        buckets = table.touched(batch_id, keys)
        assert 1 <= len(buckets) <= 2
        part = table.before(batch_id, buckets).join(keys.select("id"), "id", "left_anti").unionByName(keys)
        for _ in range(2):  # a replayed batch repeats its output
            table.write(batch_id, part, buckets)
    want = dict.fromkeys(range(100), "a") | {0: "b", 1: "b", 3: "c", 4: "c", 6: "d", 7: "d"}
    assert read(table.newest()) == want and read(table.before(2)) == want | {6: "a", 7: "a"}
    assert table.versions() == [2, 3]
    again = BucketedTable(spark, str(tmp_path / "t"), rows(0, 1, "z"), "id", bucket_rows=10)
    assert read(again.newest()) == want
    empty_one = BucketedTable(spark, str(tmp_path / "e"), rows(0, 0, "a"), "id")
    assert empty_one.newest().count() == 0
    empty_one.write(0, rows(0, 0, "a"), [])
    empty_one.write(1, rows(0, 5, "a"), [0])
    assert empty_one.newest().count() == 5


def test_a_grown_table_doubles_its_buckets(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), spark.range(0, 10), "id", bucket_rows=10, bucket_bytes=300)
    assert table.manifest(0)[0]["buckets"] == 1
    for batch_id in range(3):
        new = spark.range(10 + batch_id * 15, 25 + batch_id * 15)
        buckets = table.touched(batch_id, new)
        table.write(batch_id, table.before(batch_id, buckets).unionByName(new), buckets)
        assert sorted(r.id for r in table.newest().collect()) == list(range(25 + batch_id * 15))
    assert table.manifest(3)[0]["buckets"] >= 2


def test_rows_without_id_find_their_alert_in_other_buckets(spark, tmp_path):
    rng = random.Random(4)
    rows = [version(i, rng.choice([None, f"k{rng.randint(0, 6)}"]), f"d{rng.randint(0, 2)}", "low", f"h{rng.randint(0, 3)}") for i in range(60)]
    df = spark.createDataFrame(rows, ALERT)
    job = ST.UpsertJob(spark, empty(spark), str(tmp_path / "job"), bucket_rows=1)
    current, marks = empty(spark), []
    for batch_id in range(3):
        batch = df.filter(f"seq >= {batch_id * 20} AND seq < {batch_id * 20 + 20}")
        job(batch, batch_id)
        marked = I.classify(batch, current)
        marks += [(r.seq, r.action, r.alert_id) for r in marked.collect()]
        after = I.apply_upsert(current, batch, marked)
        current = spark.createDataFrame(after.collect(), after.schema)
    assert sorted((r.seq, r.action, r.alert_id) for r in job.table("actions").collect()) == sorted(marks)
    key = lambda t: sorted((r.id, r.content_hash, r.description) for r in t.collect())
    assert key(job.snapshot()) == key(current)


def test_changed_title_moves_in_the_index(spark, tmp_path):
    rows = as_versions(spark, many(spark, 0, 3), empty(spark).schema)
    store = AlertStore(spark, str(tmp_path / "s"), I.apply_upsert(empty(spark), rows, I.classify(rows, empty(spark))), bucket_rows=1)
    batch = rows.filter("seq = 1").withColumn("title", F.lit("moved")).withColumn("content_hash", F.lit("x"))
    touched = store.touched(0, batch)
    current = store.before(0, touched)["alerts"]
    store.write(0, touched, {"alerts": I.apply_upsert(current, batch, I.classify(batch, current))})
    found = {r.lookup.split("\u0001")[2] for r in store.index.newest().collect() if r.lookup.startswith("title")}
    assert found == {"t0", "moved", "t2"}


def test_summary_is_that_of_the_snapshot_after_every_trigger(spark, tmp_path):
    rng = random.Random(2)
    schema = "seq long, source_id int, source_alert_id string, title string, issued_at timestamp, status string, normalized_severity string, content_hash string, description string, expires_at string"
    start = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS t").first().t
    rows = [(i, 1, f"k{rng.randint(0, 8)}", "t", start, rng.choice(["active", "expired"]), rng.choice(["critical", "low"]), f"h{rng.randint(0, 9)}", "d", None) for i in range(60)]
    df = spark.createDataFrame(rows, schema).withColumn("structured_advisory", F.lit("v")).withColumn("cache_key", F.lit(None).cast("string"))
    none = spark.createDataFrame([], df.schema).withColumnRenamed("seq", "id")
    ids = {r.source_alert_id: r.alert_id for r in I.classify(df, none).join(df.select("seq", "source_alert_id"), "seq").collect()}
    locations = spark.createDataFrame([(i, d) for k, i in sorted(ids.items()) for d in (f"D{int(k[1:]) % 4}", "", None)], "alert_id long, district string")
    sources = spark.createDataFrame([(0, "healthy", None), (2, "unhealthy", None)], "consecutive_failures int, health_status string, last_checked_at timestamp")
    job = ST.SummaryJob(spark, none, locations, sources, str(tmp_path / "job"), bucket_rows=2)
    for batch_id in range(4):
        job(df.filter(f"seq >= {batch_id * 15} AND seq < {batch_id * 15 + 15}"), batch_id)
        now = job.snapshot().withColumn("updated_at", F.lit(None).cast("timestamp"))
        want = A.summary_metrics(now, locations, sources).first().asDict()
        assert job.summary().first().asDict() == want | {"alerts_in_store": now.count()}
    assert spark.read.parquet(f"{job.folder}/summary").count() == 4
