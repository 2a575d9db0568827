"""Keyed, versioned tables: a batch reads and rewrites only the buckets it touches.

A table is cut by the hash of its key. A version is a manifest, one row per
bucket, that names the version whose files hold the bucket. A batch writes the
buckets of its keys and a new manifest; all other buckets are carried over by
name. Buckets have a bounded size on average: a table that has grown doubles
their number and is then written once as a whole. Manifests and sizes are files
that the driver reads and lists; they cost no Spark job.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom.operators import identity as I
from alertloom.session import write_and_read

BUCKET_ROWS = 50_000      # rows of a bucket of a new table
BUCKET_BYTES = 32 << 20  # bytes of a bucket, on average, beyond twice of which the buckets double


def hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def finished(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the finished tables ``prefix-<number>`` below a folder, oldest first."""
    files, at = hadoop(spark, folder)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    numbers = sorted(int(n.rpartition("-")[2]) for n in names if n.startswith(f"{prefix}-"))
    return [n for n in numbers if files.exists(hadoop(spark, f"{folder}/{prefix}-{n:012d}/_SUCCESS")[1])]


def finished_manifests(spark: SparkSession, folder: str) -> list[int]:
    """Versions of the bucketed table in a folder, oldest first: a manifest gets its name when it is whole."""
    files, at = hadoop(spark, folder)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))


class BucketedTable:
    """Numbered versions of a table that is cut by the hash of ``key``; version = batch id + 1.

    What is there decides: version 0 is written only into an empty folder. A
    batch reads version ``batch_id`` and writes the next one, so a replayed batch
    repeats its own output. The two newest versions stay readable; buckets that
    neither of them names are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, initial: DataFrame, key: str,
                 bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> None:
        self.spark, self.folder, self.schema, self.key, self.bucket_bytes = spark, folder, initial.schema, key, bucket_bytes
        if self.last() is None:
            self._write(-1, initial, max(1, -(-initial.count() // bucket_rows)), None)

    def versions(self) -> list[int]:
        """Finished versions, oldest first."""
        return finished_manifests(self.spark, self.folder)

    def last(self) -> int | None:
        return max(self.versions(), default=None)

    def _manifest_path(self, version: int) -> str:
        return f"{self.folder}/manifest-{version:012d}"

    def manifest(self, version: int) -> list[dict]:
        """bucket, version, buckets and bytes of every bucket: bounded by their number, which is the table's size over ``bucket_bytes``."""
        files, path = hadoop(self.spark, self._manifest_path(version))
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_manifest(self, version: int, rows: list[dict]) -> None:
        files, partial = hadoop(self.spark, f"{self.folder}/partial-{version:012d}")
        stream = files.create(partial, True)
        stream.write(bytearray(json.dumps(rows).encode()))
        stream.close()
        _, path = hadoop(self.spark, self._manifest_path(version))
        files.delete(path, False)
        files.rename(partial, path)

    def bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _path(self, row: dict) -> str:
        return f"{self.folder}/data-{row['version']:012d}/bucket={row['bucket']}"

    def touched(self, batch_id: int, keys: DataFrame) -> list[int]:
        """The buckets of ``keys`` (column ``key``) in the version a batch reads."""
        buckets = self.manifest(batch_id)[0]["buckets"]
        if buckets == 1:
            return [0]
        return sorted(r[0] for r in keys.select(self.bucket(F.col(self.key), buckets).alias("b")).distinct().collect())

    def read(self, version: int, buckets: list[int] | None = None) -> DataFrame:
        wanted = None if buckets is None else set(buckets)
        rows = [r for r in self.manifest(version) if r["bytes"] and (wanted is None or r["bucket"] in wanted)]
        if not rows:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*map(self._path, rows))

    def before(self, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        return self.read(batch_id, buckets)

    def after(self, batch_id: int) -> DataFrame:
        return self.read(batch_id + 1)

    def newest(self) -> DataFrame:
        return self.read(self.last())

    def write(self, batch_id: int, df: DataFrame, touched: list[int]) -> None:
        """The next version: ``df`` is what the touched buckets hold from now on."""
        old = self.manifest(batch_id)
        buckets = old[0]["buckets"]
        if touched and sum(r["bytes"] for r in old) > 2 * self.bucket_bytes * buckets:
            rest = sorted({r["bucket"] for r in old} - set(touched))
            self._write(batch_id, df.unionByName(self.read(batch_id, rest)), 2 * buckets, None)
        else:
            self._write(batch_id, df, buckets, touched)

    def _write(self, batch_id: int, df: DataFrame, buckets: int, touched: list[int] | None) -> None:
        version = batch_id + 1
        new = list(range(buckets)) if touched is None else touched
        sizes: dict[str, int] = {}
        if new:
            # Every bucket is one file of bounded size; ids hash evenly, so no task holds more than its share.
            data = f"{self.folder}/data-{version:012d}"
            dealt = df.select(*self.schema.fieldNames(), self.bucket(F.col(self.key), buckets).alias("bucket")).repartition(len(new), "bucket")
            dealt.write.partitionBy("bucket").mode("overwrite").parquet(data)
            files, at = hadoop(self.spark, data)
            for found in files.listStatus(at):
                name = found.getPath().getName()
                if name.startswith("bucket="):
                    sizes[name] = files.getContentSummary(found.getPath()).getLength()
        kept = [] if touched is None else [r for r in self.manifest(batch_id) if r["bucket"] not in set(touched)]
        self._write_manifest(version, kept + [
            {"bucket": b, "version": version, "buckets": buckets, "bytes": sizes.get(f"bucket={b}", 0)} for b in new])
        self._forget(version)

    def _forget(self, version: int) -> None:
        """Deletes manifests before the last two and the buckets that only those name."""
        old = [v for v in self.versions() if v < version - 1]
        if not old:
            return
        named = {self._path(r) for v in (version, version - 1) for r in self.manifest(v)}
        gone = {self._path(r) for v in old for r in self.manifest(v)} - named
        for path in [*gone, *map(self._manifest_path, old)]:
            files, at = hadoop(self.spark, path)
            files.delete(at, True)


def lookups(alerts: DataFrame) -> Column:
    """The keys under which an alert is found: its source's own id, and its source, title and time of issue."""
    return F.array_compact(F.array(I.own_key(), I.slot_key()))


class AlertStore:
    """Alerts, an index of the keys they are matched by, and tables of their children (``alert_id``).

    The alerts table is written last: its last finished version says how far the
    job came. A source's own id stands for one stored alert.
    """

    def __init__(self, spark: SparkSession, folder: str, alerts: DataFrame, children: dict[str, DataFrame] | None = None,
                 bucket_rows: int = BUCKET_ROWS) -> None:
        make = lambda name, df, key: BucketedTable(spark, f"{folder}/{name}", df, key, bucket_rows)
        self.children = {name: make(name, df, "alert_id") for name, df in (children or {}).items()}
        if not finished_manifests(spark, f"{folder}/alerts"):
            alerts = write_and_read(alerts, "store-initial")  # counted and written for the index and the table
        self.index = make("index", alerts.select(F.explode(lookups(alerts)).alias("lookup"), "id").select("lookup", F.col("id").cast("bigint").alias("id")), "lookup")
        self.alerts = make("alerts", alerts, "id")

    def touched(self, batch_id: int, batch: DataFrame) -> dict[str, list[int]]:
        """The buckets of all tables that a batch may read or change: those of the
        alerts it matches and of the ids that its new alerts would get."""
        if all(t.manifest(batch_id)[0]["buckets"] == 1 for t in (self.alerts, *self.children.values())):
            return {"alerts": [0], **{name: [0] for name in self.children}}
        keys = batch.withColumn("lookup", F.coalesce(I.own_key(), I.slot_key())).select(
            "lookup", F.when(F.col("lookup").isNull(), I.row_key()).alias("row")).distinct()
        keys = write_and_read(keys, "store-keys")
        asked = keys.filter("lookup IS NOT NULL").select("lookup")
        found = self.index.before(batch_id, self.index.touched(batch_id, asked)).join(asked, "lookup", "left_semi").select("id")
        fresh = keys.select(I.stable_id(F.coalesce("lookup", "row")).alias("id"))
        ids = found.unionByName(fresh).distinct()
        out = {"alerts": self.alerts.touched(batch_id, ids)}
        as_child = ids.withColumnRenamed("id", "alert_id")
        return out | {name: table.touched(batch_id, as_child) for name, table in self.children.items()}

    def before(self, batch_id: int, touched: dict[str, list[int]]) -> dict[str, DataFrame]:
        tables = {"alerts": self.alerts, **self.children}
        return {name: tables[name].before(batch_id, buckets) for name, buckets in touched.items()}

    def write(self, batch_id: int, touched: dict[str, list[int]], new: dict[str, DataFrame]) -> None:
        entries = lambda df, sign: df.select(F.explode(lookups(df)).alias("lookup"), F.col("id").cast("bigint").alias("id"), F.lit(sign).alias("sign"))
        new = new | {"alerts": write_and_read(new["alerts"], "store-alerts")}  # read by the index and the table
        was, now = self.alerts.before(batch_id, touched["alerts"]), new["alerts"]
        both = entries(was, -1).unionByName(entries(now, 1)).groupBy("lookup", "id").agg(F.sum("sign").alias("sign")).filter("sign <> 0")
        changed = write_and_read(both, "index-changes")
        buckets = [] if changed.isEmpty() else self.index.touched(batch_id, changed)
        if buckets:
            held = self.index.before(batch_id, buckets).join(changed.filter("sign < 0"), ["lookup", "id"], "left_anti")
            self.index.write(batch_id, held.unionByName(changed.filter("sign > 0").drop("sign")), buckets)
        else:
            self.index.write(batch_id, changed.drop("sign"), [])
        for name, table in self.children.items():
            table.write(batch_id, new[name], touched[name])
        self.alerts.write(batch_id, new["alerts"], touched["alerts"])
