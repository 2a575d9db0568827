"""The shared work folder, and spreading small scans."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that setting is absent a local temporary folder takes its place, but
    only in local mode, where driver and executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "alertloom")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, unique path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end_with_jobs(spark: SparkSession) -> Iterator[None]:
    """What is written here, and what is collected of data frames made here, drops its
    shuffle files when its job ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


MEASURED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760"}


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What is planned here broadcasts a side of a join only once it has been shuffled and found small.
    The planner's own guess goes by the bytes of compressed, pruned files, which may hold very many rows."""
    before = {k: spark.conf.get(k, None) for k in MEASURED}
    for k, v in MEASURED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_and_read(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back; the shuffle files of the job go at its end."""
    path = new_folder(df.sparkSession, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_end_with_jobs(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row. They pass through a generator: filters on
    them, also those that a join adds, would else go below with a copy of each for every use."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__made")
    return df.select("*", made).select(*df.columns, *[F.col("__made")[n].alias(n) for n in columns])


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy row work on a scan of few small files.

    Only for plain scans and projections of them. A large table already has
    more partitions than the cluster has cores and is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
