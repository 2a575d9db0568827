"""Spans inside dropped spans, tables that are folders, phrases of two words, the filter of pattern starts."""

import os

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from alertloom.operators import mentions as M

FOLDER = "/root/testdata/sf0.001"


def test_span_inside_a_dropped_span(spark):
    rows = [(1, 0, 10, 7), (1, 1, 9, 8), (1, 2, 8, 7), (1, 20, 30, 7), (2, 2, 8, 7), (3, 0, 4, 5), (3, 0, 4, 6)]
    spans = spark.createDataFrame(rows, "id int, start int, end int, numeric_id long")
    got = sorted(tuple(r) for r in M.remove_contained(spans, ["id"]).select("id", "start", "end", "numeric_id").collect())
    assert got == [(1, 0, 10, 7), (1, 20, 30, 7), (2, 2, 8, 7), (3, 0, 4, 5)]


def test_streamed_table_may_be_a_folder(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("st1_stream_documents", "st2_stream_dedupe"):
        ours, theirs = (sorted(tuple(r) for r in entry_module.queries()[name](spark, d).collect()) for d in (str(tmp_path), FOLDER))
        assert ours == theirs and ours


def test_phrases_that_fold_into_three_words(spark, tmp_path):
    spark.createDataFrame([(1, "red-hot iron bar"), (2, "cold steel bar")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "A red-hot iron and cold steel."), (2, "cold steel, red hot iron")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, cols in (("e4_scan_documents", "doc_id, numeric_id, matched_text, start_at"), ("j9_dictionary_join", "numeric_id, hits, docs")):
        ours = sorted(tuple(r) for r in entry_module.queries()[name](spark, str(tmp_path)).selectExpr(*cols.split(", ")).collect())
        assert ours == sorted(con.sql(f"SELECT {cols} FROM ({entry_module.oracle_sql()[name]}) q").fetchall()) and ours


def choice(t="CITY"):
    return F.struct(F.col("id").alias("numeric_id"), F.lit(t).alias("entity_type"), F.lit(1).alias("method"))


def dictionary(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("stead "), F.col("id").cast("string")).alias("pattern"), choice().alias("best"),
        *[choice().alias(c) for c in ("DISTRICT", "TEHSIL", "PROVINCE", "DIVISION")])


def test_filter_stays_out_of_plans_and_grows_with_the_dictionary(spark):
    words = dictionary(spark, 200_000)
    texts = spark.range(20_000).selectExpr("id", "concat('at stead ', id * 100, ' and stead ', id + 300000) AS text")
    found = M.scan(texts, words, ["id"])
    assert len(found._jdf.queryExecution().toString()) < 1_000_000
    assert sorted((r.id, r.numeric_id) for r in found.select("id", "numeric_id").collect()) == [(i, i * 100) for i in range(2_000)]
    probe = M.Probe.of(words)
    others = spark.range(200_000, 300_000).select(probe.holds(F.lit("stead"), F.col("id").cast("string")).alias("held"))
    assert others.filter("held").count() < 10_000
