"""Operator 2: SimHash near-duplicates, linked through sharded BK-trees."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from alertloom.llm.bktree import Forest, join_labels
from alertloom.llm.common import bodies, in_arrow
from alertloom.llm.graph import components
from alertloom.session import write_and_read

SHINGLE = 4
RADIUS = 4
SEED = 42
TREE_SIZE = 4096  # a shard with more values is cut into trees of about this size
BLOCK_BITS = [11, 11, 11, 11, 10, 10]  # two of six blocks hold none of four differing bits
SHINGLES_AT_ONCE = 1 << 16
QUERIES_AT_ONCE = 512
ROWS_AT_ONCE = 16_384


def windows(body: bytes, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The words in lower case, joined by spaces, with starts and ends of the shingles; a text of fewer words is one."""
    words = body.lower().split()
    if not words:
        return b"", [], []
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(joined)]])
    n = max(1, len(words) - shingle + 1)
    return joined, starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text's word shingles; 0 without words."""
    joined, starts, ends = windows(body, shingle)
    n = len(starts)
    if not n:
        return 0
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at:at + SHINGLES_AT_ONCE], ends[at:at + SHINGLES_AT_ONCE])])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, print): a hash of the text and the fingerprint, both as signed longs."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(b, shingle) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(np.array(found, np.uint64).view(np.int64))],
                ["doc_id", "text_key", "print"])

    held = bodies(docs).withColumn("text_key", F.xxhash64("body"))
    return in_arrow(held, run, "doc_id long, text_key long, print long")


def block_masks(blocks: list[int], equal: int) -> list[int]:
    """Masks of every choice of ``equal`` blocks, as signed longs."""
    at = np.cumsum([0, *blocks])
    own = [((1 << n) - 1) << int(s) for n, s in zip(blocks, at)]
    masks = [sum(chosen) for chosen in combinations(own, equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = RADIUS, blocks: list[int] = BLOCK_BITS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(a, b) pairs of distinct values that together connect all values within ``radius`` of each other.

    Values within the radius agree in at least ``len(blocks) - radius`` blocks,
    so shards are keyed by every choice of so many blocks. A shard of one value
    is dropped. A large shard is cut into trees of ``tree_size``; each pair of
    its cuts is a task of its own, so no task grows with the shard. Within a
    task at most one link per value is returned: enough for components.
    """
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, len(blocks) - radius)])
    keyed = prints.select("print", F.posexplode(masks).alias("choice", "mask")).select(
        "print", "choice", F.col("print").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cuts = F.ceil(F.col("n") / tree_size).cast("int")
    own = F.pmod(F.xxhash64("print"), F.col("cuts")).cast("int")
    members = keyed.join(sizes, ["choice", "key"]).withColumn("cuts", cuts).withColumn("own", own).select(
        "choice", "key", "print", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")).select(
        "choice", "key", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("asked"),
        (F.col("own") <= F.col("other")).alias("planted"), (F.col("own") >= F.col("other")).alias("asks"), "print")
    group = ["choice", "key", "tree", "asked"]
    dealt = members.repartition(*group).sortWithinPartitions(*group, "print")

    def search(number: np.ndarray, planted: np.ndarray, asks: np.ndarray, values: np.ndarray):
        nodes, queries = np.flatnonzero(planted), np.flatnonzero(asks)
        forest = Forest(values[nodes], number[nodes])
        roots = np.array([forest.root_of.get(t, -1) for t in number[queries].tolist()], np.int64)
        queries, roots = queries[roots >= 0], roots[roots >= 0]
        label = np.arange(len(values))
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            block = slice(at, at + QUERIES_AT_ONCE)
            for q, v in forest.search(values[queries[block]], roots[block], radius):
                label = join_labels(label, queries[block][q], nodes[v])
        moved = np.flatnonzero(label != np.arange(len(values)))
        return values[moved].view(np.int64), values[label[moved]].view(np.int64)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table, last: bool):
            """Searches the whole groups; the last one may go on in the next batch."""
            cols = [table.column(c).to_numpy() for c in group]
            change = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
            end = table.num_rows if last else int(np.flatnonzero(change)[-1])
            if end:
                number = np.cumsum(change)[:end]
                a, b = search(number, *(table.column(c).to_numpy()[:end] for c in ("planted", "asks")),
                              table.column("print").to_numpy()[:end].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held[:] = table.slice(end).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
                yield from flush(pa.Table.from_batches(held), False)
        if held:
            yield from flush(pa.Table.from_batches(held), True)

    return in_arrow(dealt, run, "a long, b long")


def _grouped(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """(doc_id, text_key, print, root): root names the component."""
    known = write_and_read(fingerprints(docs, shingle), "fingerprints")
    roots = components(links(known.select("print").distinct(), radius))
    return known.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most ``radius``
    differing bits reach. Texts that are null, empty or without words all have
    fingerprint zero and so share a component, with any other text within the
    radius. Repeated rows and equal texts share a fingerprint. A null doc_id is
    kept and never names a component unless it has no other member. Other
    columns are not read; an empty table gives no rows.
    """
    grouped = _grouped(docs, shingle, radius)
    # Written, so that the join shuffles for itself and Spark can split a large component.
    smallest = write_and_read(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    return grouped.join(smallest, "root").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One document per root of ``grouped(doc_id, text_key, root)``, with all its columns: the smallest doc_id (nulls last); of repeated rows one stays."""
    id_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    first = F.min(F.struct(id_key.alias("id_key__"), F.col("text_key").alias("text_key__"))).alias("first")
    keep = grouped.groupBy("root").agg(first).select("first.*")
    text_key = F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = docs.withColumns({"id_key__": id_key, "text_key__": text_key})
    return keyed.join(keep, ["id_key__", "text_key__"], "left_semi").dropDuplicates(["id_key__", "text_key__"]).select(*docs.columns)


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with all its columns: the smallest doc_id (nulls last); of repeated rows one stays."""
    return keep_first(docs, _grouped(docs, shingle, radius))
