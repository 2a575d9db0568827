"""Operator 9: benchmark decontamination with suffix arrays over the training texts.

Every Arrow batch of documents is one shard: its words become numbers of the
benchmark's vocabulary, a suffix array is built over the runs of known words,
and all test suffixes are binary-searched in it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.llm.common import in_arrow
from alertloom.session import write_and_read

WINDOW = 10
BLOCK_WORDS = 1_000_000  # benchmark words that tasks hold at a time

# Bytes of words stay (A-Z as a-z), all others separate.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(body: bytes) -> list[bytes]:
    return body.translate(WORD_BYTES).split()


@dataclass
class TestBlock:
    """Part of the benchmark: its vocabulary and its distinct test suffixes, by number of compared words."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    suffixes: dict[int, np.ndarray] = field(default_factory=dict)
    owners: dict[int, list[list[str]]] = field(default_factory=dict)


def make_block(items: list[tuple[str | None, list[bytes]]], window: int) -> TestBlock:
    block = TestBlock()
    number = block.vocabulary
    rows: dict[int, dict[tuple, set]] = {}
    for item, words in items:
        ids = [number.setdefault(w, len(number) + 1) for w in words]
        size = min(window, len(ids))
        for i in range(len(ids) - size + 1) if size else ():
            owners = rows.setdefault(size, {}).setdefault(tuple(ids[i:i + size]), set())
            if item is not None:
                owners.add(item)
    for size, found in rows.items():
        order = sorted(found)
        block.suffixes[size] = np.array(order, np.int32)
        block.owners[size] = [sorted(found[k]) for k in order]
    return block


def blocks_of(benchmark: DataFrame, window: int, block_words: int) -> Iterator[TestBlock]:
    """The benchmark in blocks of bounded size; the driver never holds more than one block of it."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    for row in rows.toLocalIterator():
        words = words_of(bytes(row["body"]))
        if held and size + len(words) > block_words:
            yield make_block(held, window)
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    yield make_block(held, window)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Start positions ordered by the ``depth`` words that follow, by doubling the compared length."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < depth and n > 1:
        after = np.zeros(n, np.int64)
        after[:-reach or None] = rank[reach:] + 1 if reach < n else 0
        values, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        if len(values) == n:
            break
        reach *= 2
    return np.argsort(rank, kind="stable")


def search(seq: np.ndarray, order: np.ndarray, tests: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all tests at once: the first place in the order that is not below (or is above) each."""
    size = tests.shape[1]
    padded = np.concatenate([seq, np.zeros(size, seq.dtype)])
    low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(order), np.int64)
    every, steps = np.arange(len(tests)), np.arange(size)
    while (active := low < high).any():
        middle = (low + high) // 2
        found = padded[order[np.minimum(middle, len(order) - 1)][:, None] + steps]
        differs = found != tests
        first = differs.argmax(1)
        same = ~differs[every, first]
        up = active & np.where(same, upper, found[every, first] < tests[every, first])
        low = np.where(up, middle + 1, low)
        high = np.where(active & ~up, middle, high)
    return low


def scan_shard(texts: list[bytes], block: TestBlock) -> tuple[np.ndarray, np.ndarray, list[set[str]], list[list[tuple[int, int]]]]:
    """Per text: words, words inside an occurrence of a test suffix, items that occur, and the hit spans (start, words)."""
    number = block.vocabulary.get
    found = []
    for body in texts:
        words = words_of(body)
        found.append(np.fromiter(map(number, words, repeat(0)), np.int32, len(words)))
    sizes = np.array([len(x) for x in found], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    flat = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int32)  # a 0 after each text ends every match
    for at, ids in zip(starts, found):
        flat[at:at + len(ids)] = ids
    n_hit = np.zeros(len(texts), np.int64)
    items: list[set[str]] = [set() for _ in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not block.suffixes:
        return sizes, n_hit, items, spans

    # Only runs of known words can hold a match; the array is built over those alone.
    known = np.concatenate([[False], flat != 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= min(block.suffixes)]
    if not len(edges):
        return sizes, n_hit, items, spans
    take = np.concatenate([np.arange(a, b + 1) for a, b in edges])
    seq = flat[take]
    order = suffix_array(seq, max(block.suffixes))

    cover = np.zeros(len(flat) + 1, np.int64)
    for size, tests in block.suffixes.items():
        low, high = search(seq, order, tests, False), search(seq, order, tests, True)
        times = high - low
        if not times.any():
            continue
        which = np.repeat(np.arange(len(tests)), times)
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = take[order[low[which] + inside]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        text = np.searchsorted(starts, at, "right") - 1
        for t, k in np.unique(np.stack([text, which], 1), axis=0):
            items[t].update(block.owners[size][k])
    hit = np.cumsum(cover) > 0
    below = np.concatenate([[0], np.cumsum(hit)])
    n_hit = below[starts + sizes] - below[starts]
    for t in np.flatnonzero(n_hit):
        own = np.concatenate([[False], hit[starts[t]:starts[t] + sizes[t]], [False]])
        spans[t] = [(int(a), int(b - a)) for a, b in np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2)]
    return sizes, n_hit, items, spans


HITS = "n_words long, spans array<struct<start: long, words: long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, words in sorted([*a, *b]):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + words - out[-1][0])
        else:
            out.append([start, words])
    return [(s, n) for s, n in out]


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, spans (word positions of verbatim benchmark passages) and items (their item ids, as strings).

    A benchmark of any size is taken in blocks of ``block_words``; between two
    blocks the table is written to the shared folder. ``docs`` needs a text
    column; its columns come back first (clashing names: the new ones replace
    them). A null text has no words; an item without words matches nothing; a
    null item_id marks words but names no item; repeated rows and items count
    like any other, item names once each; empty tables are fine.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    held = docs.select(*kept)
    schema = held.schema
    many = [f.name for f in schema]

    def passing(block_value, first: bool):
        def run(batches):
            block = block_value.value
            for batch in batches:
                column = batch.column("text").to_pylist()
                sizes, _, items, spans = scan_shard([(t or "").encode() for t in column], block)
                if not first:
                    spans = [_merged([(s["start"], s["words"]) for s in old], new) for old, new in zip(batch.column("spans").to_pylist(), spans)]
                    items = [own | set(old) for old, own in zip(batch.column("items").to_pylist(), items)]
                spans = [[{"start": s, "words": n} for s, n in own] for own in spans]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in many), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS),
                     pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    [*many, "n_words", "spans", "items"])
        return run

    spark: SparkSession = docs.sparkSession
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [HITS])
    first = True
    for block in blocks_of(benchmark, window, block_words):
        if not first:
            held = write_and_read(held, "decontaminate")
        held = in_arrow(held, passing(spark.sparkContext.broadcast(block), first), out_schema)
        first = False
    return held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_matches(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark passage.

    Null and empty texts hold none and stay, repeated rows share their fate, an
    empty benchmark removes nothing and an empty table gives no rows.
    """
    names = [c if c == "text" else f"c{i}__" for i, c in enumerate(docs.columns)]  # no clash with the new columns
    return find_matches(docs.toDF(*names), benchmark, window).filter(F.size("spans") == 0).select(*names).toDF(*docs.columns)


def longest_in(doc: list[int], item: list[int], spans: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """(document word, item word, words) of the longest matches of ``least`` words and more that start in the spans.

    Every document suffix is binary-searched in the item's suffix array; its two
    neighbours there share most with it. What the match before it covers is left out.
    """
    order = suffix_array(np.array(item), len(item)).tolist()
    out = []
    for start, n in spans:
        before = 0
        for i in range(start, start + n):
            tail = doc[i:i + len(item)]
            at = bisect_left(order, tail, key=lambda j: item[j:])
            best, place = 0, 0
            for j in order[max(at - 1, 0):at + 1]:
                same = 0
                while same < len(tail) and j + same < len(item) and tail[same] == item[j + same]:
                    same += 1
                if same > best:
                    best, place = same, j
            if best >= least and best >= before:
                out.append((i, place, best))
            before = best
    return out


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_words: verbatim passages at their full length, with their places in both texts.

    One row per document word at which a passage of ``window`` words or more (a
    shorter item: all of it) of an item starts and does not just go on from the
    word before; of equally long ones in an item one is named. Only documents and
    items that share a window meet. Items without an id are left out; nulls,
    empty texts and tables give no rows, repeated rows give theirs again.
    """
    found = find_matches(docs.select("doc_id", F.col("text")), benchmark, window).filter(F.size("items") > 0)
    pairs = found.select("doc_id", "text", "spans", F.explode("items").alias("item_id")).join(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("item_text")), "item_id")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                item = words_of((r["item_text"] or "").encode())
                number: dict[bytes, int] = {}
                ids = [number.setdefault(w, len(number) + 1) for w in item]
                doc = [number.get(w, 0) for w in words_of(r["text"].encode())]
                spans = [(x["start"], x["words"]) for x in r["spans"]]
                out += [(r["doc_id"], r["item_id"], *m) for m in longest_in(doc, ids, spans, min(window, len(ids)))]
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "doc_start", "item_start", "n_words"])

    pairs = pairs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans", "item_id", "item_text")
    return in_arrow(pairs, run, "doc_id long, item_id string, doc_start long, item_start long, n_words long")


_WORDS_SQL = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
              r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
CONTAMINATION_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS_SQL} AS words FROM benchmark),
sized AS (SELECT item_id, words, least({WINDOW}, len(words)) AS size FROM items WHERE len(words) > 0),
tests AS (
  SELECT DISTINCT item_id, size, array_to_string(words[start:start + size - 1], ' ') AS body
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS start FROM sized)),
docs AS (SELECT doc_id, {_WORDS_SQL} AS words FROM documents),
places AS (
  SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS start FROM docs, (SELECT DISTINCT size FROM tests) AS sizes),
hits AS (
  SELECT p.doc_id, p.start, p.size, t.item_id FROM (
    SELECT doc_id, start, size, array_to_string(words[start:start + size - 1], ' ') AS body FROM places) p
  JOIN tests t ON p.size = t.size AND p.body = t.body),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(start, start + size)) AS place FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named i ON d.doc_id = i.doc_id
"""
