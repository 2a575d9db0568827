"""Operator 8: proportional stratified interleaving into shards.

Rows are shuffled by a seeded digest and ranked within their source. Sorted by
fractional rank, all sources advance at the same pace, so every stretch of the
order, and with it every shard cut from it, has the mixture of the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import positions_before
from alertloom.session import write_and_read

SHARDS = 40
SEED = 13
PART_BITS = 33  # monotonically_increasing_id keeps the task's number above these bits


def _numbered(df: DataFrame, order: list[str], keys: list[str], name: str) -> DataFrame:
    """Adds the place of each row among the rows of its keys, in the order of ``order``, which starts with the keys.

    A range sort spreads a hot key over many tasks. The sorted table is written
    once; a row's place is its place in its task plus the rows of its keys in
    earlier tasks.
    """
    held = write_and_read(df.orderBy(*order).withColumn("at__", F.monotonically_increasing_id()), "sorted")
    held = held.withColumn("part__", F.shiftright("at__", PART_BITS))
    parts = held.groupBy(*keys, "part__").agg(F.count(F.lit(1)).alias("n__"), F.min("at__").alias("first__"))
    parts = positions_before(parts, keys, "part__", "n__", "before__").select(
        *keys, "part__", "first__", "before__")
    return held.join(parts, [*keys, "part__"]).withColumn(name, F.col("before__") + F.col("at__") - F.col("first__")).drop(
        "at__", "part__", "first__", "before__")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, stratum: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; shard row counts differ by one at most.

    ``size`` is the UTF-8 length plus 16 (null text: 16). A null source is the
    empty source. Equal digests go by doc_id, then by text; rows equal in all of
    these are interchangeable. Fewer rows than shards leave shards empty, an
    empty table gives no rows. Other columns are not read.
    """
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    rows = rows.withColumn("digest", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    ranked = _numbered(rows, ["stratum", "digest", "doc_id", "text_crc32", "size"], ["stratum"], "rank")
    totals = ranked.groupBy("stratum").agg(F.count(F.lit(1)).alias("of"))
    paced = ranked.join(totals, "stratum").withColumn("pace", (F.col("rank") + 0.5) / F.col("of"))
    placed = _numbered(paced.select("pace", "stratum", "digest", "doc_id", "text_crc32", "size", "rank"), ["pace", "stratum", "rank"], [], "place")
    n = rows.count()
    shard = F.expr(f"int(place * {shards} div {max(n, 1)})")
    begin = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "shard", (F.col("place") - begin).alias("slot"))


def shard_digest(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``interleave`` in the columns of the query: the law is ``rows``, so there is no grown shard."""
    return interleave(docs, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
