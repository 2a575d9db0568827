"""Near-duplicates by exact Jaccard similarity of word shingles, for the corpus pipeline.

Candidates come from SimHash fingerprints, linked through BK-trees as in
operator 2, and from MinHash bands: texts that share four fifths of their
shingles differ in up to 13 and more of 64 SimHash bits, a radius at which no
block index or BK-tree leaves anything out, so the bands find those that
differ in more bits than the trees search. Every link is then compared shingle
by shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import bodies, in_arrow
from alertloom.llm.graph import components
from alertloom.llm.simhash import SEED, fingerprint, keep_first, links as print_links, windows
from alertloom.session import write_and_read

SHINGLE = 5
SIMILAR = (4, 5)  # the least share of common shingles, 0.8, as a fraction
BANDS, ROWS = 40, 5  # a pair at 0.8 meets in no band with probability 1.2e-7
HASHES_AT_ONCE = 1024
CUT_ROWS, CUT_BYTES = 512, 8 << 20  # a larger group of candidates is cut
HELD_ROWS, HELD_BYTES = 2048, 16 << 20

_RANDOM = np.random.default_rng(SEED).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
_FLIPS, _FACTORS = _RANDOM[0], _RANDOM[1] * np.uint64(2) + np.uint64(1)


def shingles(body: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending hashes of the distinct word shingles; a text without words has one of its own, a short one is one shingle."""
    joined, starts, ends = windows(body, shingle)
    if not starts:
        return np.zeros(1, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts)))


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key per band of the MinHash signature, as signed longs."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), HASHES_AT_ONCE):
        mixed = (own[at:at + HASHES_AT_ONCE, None] ^ _FLIPS) * _FACTORS
        np.minimum(low, (mixed ^ mixed >> np.uint64(32)).min(0), out=low)
    parts = low.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), b) for b, p in enumerate(parts)], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - both)


def connect(sets: list[np.ndarray], planted: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    """Similar pairs, each of a planted and an asking set, that connect all such pairs.

    Similar sets share one of the smallest hashes of each: of n, those that can
    be absent from four fifths of them, and one more. Pairs that are connected
    already are not compared.
    """
    sizes = np.array([len(s) for s in sets])
    heads = [s[:len(s) - -(-SIMILAR[0] * len(s) // SIMILAR[1]) + 1] for s in sets]
    hashes, owner = np.concatenate(heads), np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    label, found = np.arange(len(sets)), []
    for i, head in enumerate(heads):
        low, high = np.searchsorted(hashes, head, "left"), np.searchsorted(hashes, head, "right")
        times = high - low
        others = np.unique(owner[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())])
        others = others[(others < i) & (planted[others] & asks[i] | asks[others] & planted[i])]
        least, most = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        for j in others[least * SIMILAR[1] >= most * SIMILAR[0]].tolist():
            if label[i] != label[j] and similar(sets[i], sets[j]):
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, print, keys): a hash of the text, its SimHash fingerprint as a signed long and its band keys."""

    def run(batches):
        for batch in batches:
            texts = batch.column("body").to_pylist()
            keys = [band_keys(shingles(b)) for b in texts]
            prints = np.array([fingerprint(b, SHINGLE) for b in texts], np.uint64).view(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(prints), lists.cast(pa.list_(pa.int64()))],
                ["doc_id", "text_key", "print", "keys"])

    held = bodies(docs).withColumn("text_key", F.xxhash64("body"))
    return in_arrow(held, run, "doc_id long, text_key long, print long, keys array<long>")


def near_prints(known: DataFrame) -> DataFrame:
    """(a, b) keys of texts that connect all texts of equal fingerprints and those whose fingerprints the BK-trees link."""
    prints = known.groupBy("print").agg(F.min("text_key").alias("low"))
    equal = known.join(prints, "print").select(F.col("text_key").alias("a"), F.col("low").alias("b"))
    linked = print_links(prints.select("print"))
    for end in ("a", "b"):
        linked = linked.join(prints.select(F.col("print").alias(end), F.col("low").alias(f"low_{end}")), end)
    return equal.unionByName(linked.select(F.col("low_a").alias("a"), F.col("low_b").alias("b")))


def links(docs: DataFrame, candidates: DataFrame, cut_rows: int = CUT_ROWS, cut_bytes: int = CUT_BYTES) -> DataFrame:
    """(a, b) keys of similar texts that connect all similar texts of each group of ``candidates(node, root)``.

    A group is cut by rows and bytes; each pair of its cuts is a task of its
    own, as in the search of SimHash values, so no task grows with the group.
    """
    texts = bodies(docs).select(F.xxhash64("body").alias("node"), "body").join(candidates, "node").dropDuplicates(["node"])
    held = write_and_read(texts, "candidates")
    size = F.greatest(F.count(F.lit(1)) / cut_rows, F.sum(F.octet_length("body")) / cut_bytes)
    cuts = held.groupBy("root").agg(F.ceil(size).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    group = ["root", "tree", "asked"]
    members = held.join(cuts, "root").withColumn("own", own).select(
        "root", "node", "own", "body", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")).select(
        "root", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("asked"),
        (F.col("own") <= F.col("other")).alias("planted"), (F.col("own") >= F.col("other")).alias("asks"), "node", "body")
    dealt = members.repartition(*group).sortWithinPartitions(*group, "node")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table, last: bool):
            """Searches the whole groups; the last one may go on in the next batch."""
            cols = [table.column(c).to_numpy() for c in group]
            change = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
            edges = [*np.flatnonzero(change).tolist(), *([table.num_rows] if last else [])]
            node, planted, asks = (table.column(c).to_numpy() for c in ("node", "planted", "asks"))
            for start, end in zip(edges, edges[1:]):
                if end - start > 1:
                    sets = [shingles(b.as_py()) for b in table.column("body").slice(start, end - start)]
                    pairs = np.array(connect(sets, planted[start:end], asks[start:end]), np.int64).reshape(-1, 2) + start
                    yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], ["a", "b"])
            held[:] = table.slice(edges[-1]).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_ROWS or sum(b.nbytes for b in held) >= HELD_BYTES:
                yield from flush(pa.Table.from_batches(held), False)
        if held:
            yield from flush(pa.Table.from_batches(held), True)

    return in_arrow(dealt, run, "a long, b long")


def drop_similar(docs: DataFrame, cut_rows: int = CUT_ROWS, cut_bytes: int = CUT_BYTES) -> DataFrame:
    """One document of each component of texts with Jaccard similarity 0.8 or more: the smallest doc_id (nulls last).

    Shingles are five words, ASCII letters in lower case; a shorter text is one
    shingle, and all texts without words are alike. Texts are told apart by 64
    bits of hash. Of repeated rows one stays; all columns are kept. A null text is
    an empty one; an empty table gives no rows.
    """
    known = write_and_read(signatures(docs), "signatures")
    keyed = known.dropDuplicates(["text_key"]).select(F.col("text_key").alias("node"), F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "low")
    in_bands = keyed.join(hubs, "key").select(F.col("node").alias("a"), F.col("low").alias("b"))
    near = components(near_prints(known).unionByName(in_bands))
    roots = components(links(docs, near, cut_rows, cut_bytes)).withColumnRenamed("node", "text_key")
    grouped = known.select("doc_id", "text_key").join(roots, "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    return keep_first(docs, grouped)
