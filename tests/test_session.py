import time

from pyspark.sql import functions as F

from alertloom.llm.substrings import kept_words
from alertloom.session import CLEANUP, write_and_read
from tests.llm.test_substrings import corpus


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in map(str, (files.apply(i).getName() for i in range(files.size()))) if f.startswith("shuffle_")}


def left_behind(spark, before):
    """Files of shuffles that are still there some seconds later: they are removed beside the next job."""
    for _ in range(40):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.25)
    return left


def test_written_tables_leave_no_shuffles(spark):
    before = shuffle_files(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(write_and_read(counts, "counts").collect()) == sorted(counts.collect())
    made = shuffle_files(spark) - before
    assert len({f.split("_")[1] for f in made}) <= 1  # only those of the collect, which is the caller's
    assert spark.conf.get(CLEANUP) == "false"


def test_op4_moves_texts_after_its_windows_are_gone(spark):
    docs = spark.createDataFrame(corpus(3), "doc_id long, text string")
    before = shuffle_files(spark)
    kept = kept_words(docs, log_cells=12)
    assert not left_behind(spark, before)
    assert kept.count() == docs.count()
