"""Structured Streaming jobs: landed files in, versioned tables out.

State that an upsert needs lives in bucketed tables in the shared folder, with a
version per batch id: a replayed batch overwrites its own output, only touched
buckets are read and written, and a hot key is handled by the same chunked plans
as in batch. Watermarks only bound state; late rows still reach the upsert.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom import constants as K
from alertloom.functions import timeops
from alertloom.operators import aggregates as A, identity as I, ingest as G, quality as Q
from alertloom.operators.reports import change_feed
from alertloom.session import measured_broadcasts, new_folder
from alertloom.streaming.store import BUCKET_ROWS, AlertStore, finished, hadoop


def stream_documents(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", max_files: int = 100) -> DataFrame:
    """New files of a landing folder, a bounded number per trigger."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files)
        .parquet(folder))


def stream_dedupe(docs: DataFrame, event_time: str = "retrieved_at", keys=("source", "url", "retrieved_at"),
                  lateness: str = "1 day") -> DataFrame:
    """Drop re-deliveries of one document. Content is not compared: A, B, A
    are three deliveries and must reach the upsert as three versions."""
    return docs.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append",
                  checkpoint: str | None = None) -> StreamingQuery:
    """Process everything that has landed, then stop. Batches join what earlier steps
    wrote as compressed files, so sides are broadcast by their measured size alone."""
    spark = stream.sparkSession
    with measured_broadcasts(spark):
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(each)
            .option("checkpointLocation", checkpoint or new_folder(spark, "stream-state")).trigger(availableNow=True).start())
        query.awaitTermination()
    return query


class SnapshotStore:
    """Numbered table versions below a folder; version = batch id + 1.

    What is there decides: version 0 is written only into an empty folder, and
    a restarted job goes on from the last finished version. A batch reads
    version ``batch_id`` and writes the next one, so a replayed batch repeats
    its own output; older versions are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, initial: DataFrame):
        self.spark, self.folder, self.schema = spark, folder, initial.schema
        if self.last() is None:
            initial.write.mode("overwrite").parquet(self._path(0))

    def _path(self, version: int) -> str:
        return f"{self.folder}/version-{version:012d}"

    def versions(self) -> list[int]:
        """Finished versions, oldest first."""
        return finished(self.spark, self.folder, "version")

    def last(self) -> int | None:
        return max(self.versions(), default=None)

    def before(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._path(batch_id))

    def write(self, batch_id: int, df: DataFrame) -> None:
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self._path(batch_id + 1))
        for old in self.versions():
            if old < batch_id:
                files, path = hadoop(self.spark, self._path(old))
                files.delete(path, True)

    def after(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._path(batch_id + 1))

    def newest(self) -> DataFrame:
        return self.after(self.last() - 1)


class UpsertJob:
    """Versioned upsert per micro-batch: alerts, actions, revisions, changes.

    A second job on the same folder continues the first: the store, its tables
    and the stream's own checkpoint all lie below it.
    """

    def __init__(self, spark: SparkSession, initial: DataFrame, folder: str | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark = spark
        self.folder = folder or new_folder(spark, "upsert")
        self.tables = AlertStore(spark, self.folder, initial, bucket_rows=bucket_rows)
        self.store = self.tables.alerts

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/checkpoint"

    @property
    def last_batch(self) -> int:
        return self.store.last() - 1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        staged = f"{self.folder}/staged/batch={batch_id}"
        batch.write.mode("overwrite").parquet(staged)  # read several times below
        batch = self.spark.read.parquet(staged)
        touched = self.tables.touched(batch_id, batch)
        current = self.tables.before(batch_id, touched)["alerts"]
        marks = f"{self.folder}/actions/batch={batch_id}"
        I.classify(batch, current).write.mode("overwrite").parquet(marks)
        classified = self.spark.read.parquet(marks)
        I.revisions(classified).write.mode("overwrite").parquet(f"{self.folder}/revisions/batch={batch_id}")
        change_feed(classified, batch).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch_id}")
        self.tables.write(batch_id, touched, {"alerts": I.apply_upsert(current, batch, classified)})

    def table(self, name: str) -> DataFrame:
        """actions, revisions or changes over all batches."""
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def snapshot(self) -> DataFrame:
        return self.store.newest()


def stream_upsert(stream: DataFrame, initial: DataFrame, folder: str | None = None) -> UpsertJob:
    job = UpsertJob(stream.sparkSession, initial, folder)
    run_available(stream, job, checkpoint=job.checkpoint)
    return job


DAYS = "day timestamp, hazard_type string, n bigint"


def day_counts(alerts: DataFrame, as_of, time: str = "issued_at", lateness: str = f"{K.WINDOW_DAYS} days") -> DataFrame:
    """Alerts per day and hazard; times more than 15 minutes ahead of ``as_of``
    are dropped. The state of a day goes once the watermark has passed it, and
    rows later than that are lost, as with any watermark."""
    limit = timeops.as_of_column(as_of) + F.expr(f"INTERVAL {K.SKEW_MINUTES} MINUTES")
    return (
        alerts.filter(F.col(time) <= limit).withWatermark(time, lateness)
        .groupBy(F.window(time, "1 day").alias("w"), "hazard_type").agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("day"), "hazard_type", "n"))


def windows_of_days(days: DataFrame, width: int = K.WINDOW_DAYS) -> DataFrame:
    """Rolling windows of ``width`` days, one starting every day, from day counts."""
    back = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("back")
    rows = days.select("day", "hazard_type", "n", back).withColumn("start", F.col("day") - F.make_dt_interval(F.col("back")))
    return rows.groupBy("start", (F.col("start") + F.make_dt_interval(F.lit(width))).alias("end"), "hazard_type").agg(F.sum("n").alias("n"))


def stream_window_counts(alerts: DataFrame, as_of, time: str = "issued_at", days: int = K.WINDOW_DAYS, folder: str | None = None) -> DataFrame:
    """Run to the end of the landed data; returns the final counts.

    Each trigger hands over only the days that changed (update mode); they
    replace their rows in the table of days.
    """
    spark = alerts.sparkSession
    folder = folder or new_folder(spark, "window-counts")
    store = SnapshotStore(spark, f"{folder}/days", spark.createDataFrame([], DAYS))

    def each(batch: DataFrame, batch_id: int) -> None:
        old, new = store.before(batch_id).alias("old"), batch.alias("new")
        same = (F.col("old.day") == F.col("new.day")) & F.col("old.hazard_type").eqNullSafe(F.col("new.hazard_type"))
        store.write(batch_id, old.join(new, same, "left_anti").unionByName(batch))

    run_available(day_counts(alerts, as_of, time, f"{days} days"), each, "update", f"{folder}/checkpoint")
    return windows_of_days(store.newest(), days)


POLLS = "source_id bigint, checked_at timestamp, event_id bigint, ok boolean"


def open_polls(held: DataFrame, polls: DataFrame) -> DataFrame:
    """The polls that still decide a source's health: its last success and every
    failure after it, by time of the poll and not of its arrival. A late success
    ends only the failures before it; a late failure from before the last
    success changes nothing."""
    both = held.unionByName(polls.select(*held.columns))
    at = F.struct("checked_at", "event_id")
    good = both.filter("ok").groupBy("source_id").agg(F.max(at).alias("good_at"))
    return both.join(good, "source_id", "left").filter(F.col("good_at").isNull() | (at >= F.col("good_at"))).select(*held.columns)


def stream_health(polls: DataFrame, folder: str | None = None) -> DataFrame:
    """Health per source after all landed polls, in whatever order they came."""
    spark = polls.sparkSession
    folder = folder or new_folder(spark, "health")
    store = SnapshotStore(spark, f"{folder}/polls", spark.createDataFrame([], POLLS))
    run_available(polls, lambda batch, i: store.write(i, open_polls(store.before(i), batch)), checkpoint=f"{folder}/checkpoint")
    return Q.source_health(store.newest())


class SummaryJob(UpsertJob):
    """Upsert plus the summary row after every trigger, kept up and not counted anew.

    Counts are kept per bucket of the store; a trigger counts the buckets that
    it wrote, and these replace their rows, which takes back what the changed
    alerts stood for before. Districts grow by those of the created alerts.
    """

    def __init__(self, spark: SparkSession, initial: DataFrame, locations: DataFrame, sources: DataFrame, folder: str | None = None,
                 bucket_rows: int = BUCKET_ROWS):
        super().__init__(spark, initial, folder, bucket_rows)
        self.locations, self.sources = locations, sources
        self.counts = SnapshotStore(spark, f"{self.folder}/counts", self._counted(self.store.last(), None))
        ids = self.snapshot().select(F.col("id").alias("alert_id"))
        with measured_broadcasts(spark):
            self.districts = SnapshotStore(spark, f"{self.folder}/districts", A.districts_of(locations, ids))

    def _counted(self, version: int, written: int | None) -> DataFrame:
        """Counts per bucket of a version of the store, of all buckets or of those that one version wrote."""
        rows = self.store.manifest(version)
        buckets = [r["bucket"] for r in rows if written is None or r["version"] == written]
        alerts = self.store.read(version, buckets)
        if "updated_at" not in alerts.columns:
            alerts = alerts.withColumn("updated_at", F.lit(None).cast("timestamp"))
        return A.alert_counts(alerts.withColumn("bucket", self.store.bucket(F.col("id"), rows[0]["buckets"])), "bucket")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        super().__call__(batch, batch_id)
        version = batch_id + 1
        new = self._counted(version, version)
        touched = self.spark.createDataFrame([(r["bucket"],) for r in self.store.manifest(version) if r["version"] == version], "bucket int")
        self.counts.write(batch_id, self.counts.before(batch_id).join(touched, "bucket", "left_anti").unionByName(new))
        created = self.spark.read.parquet(f"{self.folder}/actions/batch={batch_id}").filter("action = 'created'").select("alert_id")
        self.districts.write(batch_id, self.districts.before(batch_id).unionByName(A.districts_of(self.locations, created)).distinct())
        self.summary().write.mode("overwrite").parquet(f"{self.folder}/summary/batch={batch_id}")

    def summary(self) -> DataFrame:
        return A.summary_row(self.counts.newest(), self.districts.newest(), self.sources)


def stream_summary(stream: DataFrame, initial: DataFrame, locations: DataFrame, sources: DataFrame, folder: str | None = None) -> DataFrame:
    """The summary row after all landed rows."""
    job = SummaryJob(stream.sparkSession, initial, locations, sources, folder)
    run_available(stream, job, checkpoint=job.checkpoint)
    return job.summary()


class IngestJob:
    """The whole ingest per micro-batch, children and resolutions included.

    A second job on the same folder continues the first.
    """

    def __init__(self, spark: SparkSession, ix, folder: str | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.ix = spark, ix
        self.folder = folder or new_folder(spark, "ingest")
        empty = G.empty_store(spark)
        self.tables = AlertStore(spark, self.folder, empty.pop("alerts"), empty, bucket_rows)

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/checkpoint"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        staged = f"{self.folder}/staged/batch={batch_id}"
        batch.write.mode("overwrite").parquet(staged)
        made = G.prepare(self.spark.read.parquet(staged), self.ix)
        touched = self.tables.touched(batch_id, made["alerts"])
        out = G.merge(made, self.tables.before(batch_id, touched))
        for name in ("actions", "revisions", "changes"):
            out[name].write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")
        self.tables.write(batch_id, touched, out)

    def snapshot(self, name: str = "alerts") -> DataFrame:
        table = self.tables.alerts if name == "alerts" else self.tables.children[name]
        return table.read(self.tables.alerts.last())


def stream_ingest(stream: DataFrame, ix, folder: str | None = None) -> IngestJob:
    job = IngestJob(stream.sparkSession, ix, folder)
    run_available(stream, job, checkpoint=job.checkpoint)
    return job
