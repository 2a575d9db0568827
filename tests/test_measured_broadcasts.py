"""Streaming batches do not broadcast by the bytes of compressed files."""

from alertloom.session import MEASURED
from alertloom.streaming import jobs as ST


def test_batches_join_compressed_tables_without_a_guessed_broadcast(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in MEASURED}
    spark.range(20_000).write.parquet(f"{tmp_path}/in")
    spark.range(20_000).selectExpr("id", "id AS v").write.parquet(f"{tmp_path}/side")
    plans = []

    def each(batch, batch_id):
        for session in (spark, batch.sparkSession):
            rows = session.read.parquet(f"{tmp_path}/in").join(session.read.parquet(f"{tmp_path}/side"), "id")
            plans.append(rows._jdf.queryExecution().executedPlan().toString())

    stream = ST.stream_documents(spark, f"{tmp_path}/in", spark.range(1).schema)
    ST.run_available(stream, each, checkpoint=f"{tmp_path}/state")
    assert len(plans) == 2 and not any("BroadcastHashJoin" in p for p in plans)
    assert {k: spark.conf.get(k, None) for k in MEASURED} == before
