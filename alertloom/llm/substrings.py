"""Operator 4: substring dedup with a count-min prefilter.

A window is a run of words. Its anchor is the leftmost smallest hash among its
short grams, so equal windows have equal anchors, and a window's anchor occurs
at least as often as the window itself. Anchors are counted in a count-min
sketch of as many segments as the texts need: both cells of an anchor lie in its
segment, which is filled and asked in one task, so the sketch never
underestimates, does not fill up on a larger input and is never sent around.
Only windows whose anchor may repeat are grouped, by 128-bit keys. Of equal
whole texts only the first is looked at; the others repeat all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import bodies, in_arrow
from alertloom.session import shuffles_end_with_jobs, write_and_read

WINDOW = 20
GRAM = 8
LOG_CELLS = 20  # cells of each of the two sketch rows of a segment
ROOM = 8  # cells a row for each anchor of a segment, as expected
ANCHOR_BYTES = 40  # bytes of text for each anchor, about
KEYS_AT_ONCE = 1 << 18  # window keys of a segment, about
LOG_FIRSTS = 27  # bits of the bitmap of first copies, 16 MB
BITMAP_BITS = 32_768  # of one of Spark's bitmaps
HASHES_AT_ONCE = 500_000
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # any odd multipliers
NULL_ID = -(2**63)  # a null doc_id sorts first


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def rolling(hashes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of every ``width`` consecutive values, modulo 2**64."""
    n = len(hashes)
    up, down = _powers(base, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up)])
    return (sums[width:] - sums[:n - width + 1]) * down[:n - width + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in every ``width`` consecutive ones."""
    at, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        reach += step
    return at


class Windows:
    """All windows of a batch of texts: where they start, their anchors and their keys."""

    def __init__(self, texts: list[bytes], window: int, gram: int) -> None:
        split = [t.split() for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        total = int(sizes.sum())
        digests = b"".join([xxhash.xxh3_128_digest(w) for words in split for w in words])
        self.halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
        self.text = np.repeat(np.arange(len(texts)), np.maximum(sizes - window + 1, 0))
        inside = np.arange(len(self.text)) - np.repeat(
            np.cumsum(np.maximum(sizes - window + 1, 0)) - np.maximum(sizes - window + 1, 0), np.maximum(sizes - window + 1, 0))
        self.start = inside
        self.at = self.begin[self.text] + inside
        self.window = window
        self.anchor = np.zeros(0, np.uint64)
        self.run = np.zeros(0, np.int64)
        if total >= window and len(self.at):
            grams = mixed(rolling(np.ascontiguousarray(self.halves[:, 0]), gram, ODD[0]))
            place = leftmost_minima(grams, window - gram + 1)[self.at]
            new = np.concatenate([[True], place[1:] != place[:-1]])
            self.anchor = grams[place[new]]  # one per occurrence of an anchor
            self.run = np.diff(np.concatenate([np.flatnonzero(new), [len(place)]]))

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[chosen]
        return tuple(rolling(np.ascontiguousarray(self.halves[:, k]), self.window, ODD[k])[at] for k in (0, 1))


def cells_of(anchors: np.ndarray, log_cells: int) -> np.ndarray:
    """The cell of each anchor in both rows; the second row follows the first."""
    spread = mixed(anchors)
    mask = np.uint64((1 << log_cells) - 1)
    return np.stack([spread & mask, ((spread >> np.uint64(32)) & mask) + np.uint64(1 << log_cells)]).astype(np.int64)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each hash; it does not follow from the cells."""
    return (mixed(hashes ^ ODD[1]) % np.uint64(segments)).astype(np.int64)


def _by_segment(segment: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row per segment, with its part of each column as bytes."""
    order = np.argsort(segment, kind="stable")
    segment = segment[order]
    edges = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]])) if len(segment) else np.zeros(1, np.int64)
    cut = lambda values: pa.array([values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(segment[edges[:-1]], pa.int64()), *(cut(values[order]) for values in columns.values())], ["segment", *columns])


def in_segments(source: DataFrame, hashed, cut, merge, kinds: dict[str, str], out: str) -> DataFrame:
    """What the segments answer. ``hashed(batch)`` gives arrays, which go to ``cut`` some
    hundred thousand at a time; it gives (segments, columns) twice: of rows to be asked, and of
    rows whose answer is known, with the first column left out. ``merge`` gets all the columns of a segment."""
    names, first = list(kinds), next(iter(kinds))

    def ship(batches):
        held, size = [], 0

        def rows():
            asked, known = cut(*(np.concatenate(x) for x in zip(*held)))
            yield _by_segment(*asked)
            empty = {n: np.zeros((len(known[0]), 0), np.uint8) if n not in known[1] else known[1][n] for n in names}
            yield _by_segment(known[0], empty)

        for batch in batches:
            held.append(hashed(batch))
            size += len(held[-1][0])
            if size >= HASHES_AT_ONCE:
                yield from rows()
                held, size = [], 0
        if size:
            yield from rows()

    def gather(batches):
        now, parts = None, []

        def done():
            return merge(*(np.frombuffer(b"".join(x), kinds[n]) for n, x in zip(names, zip(*parts))))

        for batch in batches:
            for segment, *values in zip(*(batch.column(c).to_pylist() for c in ("segment", *names))):
                if not values[names.index(first)]:  # known
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.frombuffer(v, kinds[n])) for n, v in zip(names, values) if n in answer], answer)
                    continue
                if segment != now:
                    if parts:
                        yield done()
                    now, parts = segment, []
                parts.append(values)
        if parts:
            yield done()

    answer = [c.split()[0] for c in out.split(", ")]
    parts = in_arrow(source, ship, "segment long, " + ", ".join(f"{n} binary" for n in names))
    return in_arrow(parts.repartition("segment").sortWithinPartitions("segment"), gather, out)


def _keyed(docs: DataFrame) -> DataFrame:
    return bodies(docs).select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("id_key"), F.xxhash64("body").alias("text_key"),
        F.xxhash64(F.lit(1), "body").alias("text_key2"), "doc_id", "body")


def _doc_key():
    """Tells documents apart for the prefilter; two that share it only ask for more windows."""
    return F.xxhash64("id_key", "text_key").alias("doc_key")


def first_texts(docs: DataFrame) -> DataFrame:
    """(text_key, text_key2, first_id): per distinct text the smallest doc_id."""
    return _keyed(docs).groupBy("text_key", "text_key2").agg(F.min("id_key").alias("first_id"))


def _place(id_key: str, text_key: str):
    """The bit of a document: from 1, as Spark's bitmaps count."""
    return F.pmod(F.xxhash64(id_key, text_key), F.lit(1 << LOG_FIRSTS)) + 1


def bitmap_of_firsts(firsts: DataFrame) -> np.ndarray:
    """A bitmap that holds the place of every first copy; other documents seldom fall on a set bit."""
    size = BITMAP_BITS >> 3
    bits = np.zeros((1 << LOG_FIRSTS) >> 3, np.uint8)
    with shuffles_end_with_jobs(firsts.sparkSession):
        at = firsts.select(_place("first_id", "text_key").alias("at")).select(
            F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
        found = at.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # at most the bitmap itself
    for row in found:
        bits[(row["bucket"] - 1) * size:row["bucket"] * size] = np.frombuffer(row["bits"], np.uint8)
    return bits


def candidates(docs: DataFrame, window: int, gram: int, log_cells: int) -> DataFrame:
    """(doc_key, start): the runs of windows with one anchor that the sketch can't prove unique, by their first window.

    Later copies of a whole text take no part. An anchor that is met again
    among those that a task holds is counted there, and its later runs are not asked for.
    """
    context = docs.sparkSession.sparkContext
    firsts = context.broadcast(bitmap_of_firsts(first_texts(docs)))
    source = _keyed(docs).select(_doc_key(), "body", (_place("id_key", "text_key") - 1).alias("place"))
    length = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    segments = 1 + length * ROOM // (ANCHOR_BYTES << log_cells)

    def hashed(batch):
        place = batch.column("place").to_numpy()
        known = (firsts.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1  # surely later copies are left empty
        found = Windows([b if k else b"" for b, k in zip(batch.column("body").to_pylist(), known)], window, gram)
        begin = np.cumsum(found.run) - found.run
        return found.anchor, batch.column("doc_key").to_numpy()[found.text[begin]], found.start[begin].astype(np.int32)

    def cut(anchor, doc_key, start):
        order = np.argsort(anchor, kind="stable")
        new = np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]])
        one, more = order[new], order[~new]
        times = np.minimum(np.diff(np.concatenate([np.flatnonzero(new), [len(order)]])), 2).astype(np.uint8)
        return ((segment_of(anchor[one], segments), {"anchor": anchor[one], "times": times, "doc_key": doc_key[one], "start": start[one]}),
                (segment_of(doc_key[more].view(np.uint64), segments), {"doc_key": doc_key[more], "start": start[more]}))

    def merge(anchor, times, doc_key, start):
        cells = cells_of(anchor, log_cells)
        counts = np.bincount(cells.ravel(), np.concatenate([times, times]), 2 << log_cells)
        stays = counts[cells].min(0) > 1
        return pa.RecordBatch.from_arrays([pa.array(doc_key[stays]), pa.array(start[stays])], ["doc_key", "start"])

    return in_segments(source, hashed, cut, merge, {"anchor": "<u8", "times": "u1", "doc_key": "<i8", "start": "<i4"}, "doc_key long, start int")


def later_windows(docs: DataFrame, runs: DataFrame, window: int, gram: int) -> DataFrame:
    """(id_key, text_key, start): the windows of ``runs`` whose words also start earlier.

    A key goes once from each lot of windows, by its first start there; the other
    windows of the lot start later, so that a passage in very many texts is not the work of one task.
    """
    segments = 1 + 4 * runs.count() // KEYS_AT_ONCE
    wanted = runs.groupBy("doc_key").agg(F.collect_list("start").alias("starts"))
    source = _keyed(docs).withColumn("doc_key", _doc_key()).join(wanted, "doc_key").select("id_key", "text_key", "body", "starts")

    def hashed(batch):
        found = Windows(batch.column("body").to_pylist(), window, gram)
        begin = np.cumsum(found.run) - found.run
        starts = batch.column("starts")
        asked = (np.repeat(np.arange(len(starts)), starts.value_lengths().to_numpy()) << 32) | starts.flatten().to_numpy()
        chosen = np.flatnonzero(np.repeat(np.isin((found.text[begin] << 32) | found.start[begin], asked), found.run))
        k0, k1 = found.keys(chosen) if len(chosen) else (np.zeros(0, np.uint64),) * 2
        text = found.text[chosen]
        return k0, k1, batch.column("id_key").to_numpy()[text], batch.column("text_key").to_numpy()[text], found.start[chosen].astype(np.int32)

    def first_of(k0, k1, id_key, text_key, start):
        """An order by key and start, and in it: is it the first start of its key, is it another row than the one before?"""
        order = np.lexsort((text_key, start, id_key, k1, k0))
        differs = lambda *columns: np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in columns], 0)])
        new = differs(k0, k1)
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        return order, (id_key[order] == id_key[head]) & (start[order] == start[head]), new | differs(id_key, start, text_key)

    def cut(k0, k1, id_key, text_key, start):
        order, first, other = first_of(k0, k1, id_key, text_key, start)
        one, more = order[first & other], order[~first & other]
        place = lambda at: {"id_key": id_key[at], "text_key": text_key[at], "start": start[at]}
        return ((segment_of(k0[one], segments), {"k0": k0[one], "k1": k1[one]} | place(one)),
                (segment_of(text_key[more].view(np.uint64), segments), place(more)))

    def merge(k0, k1, id_key, text_key, start):
        order, first, _ = first_of(k0, k1, id_key, text_key, start)
        later = order[~first]
        return pa.RecordBatch.from_arrays([pa.array(c[later]) for c in (id_key, text_key, start)], ["id_key", "text_key", "start"])

    return in_segments(source, hashed, cut, merge, {"k0": "<u8", "k1": "<u8", "id_key": "<i8", "text_key": "<i8", "start": "<i4"},
                       "id_key long, text_key long, start int")


def repeated_starts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, log_cells: int = LOG_CELLS) -> DataFrame:
    """(id_key, text_key, copy, starts): per text the windows that also start earlier, or that all of it is a later copy."""
    later = later_windows(docs, write_and_read(candidates(docs, window, gram, log_cells), "repeated-anchors"), window, gram)
    copies = _keyed(docs).drop("body").join(first_texts(docs), ["text_key", "text_key2"]).filter("id_key > first_id")
    marks = later.unionByName(copies.select("id_key", "text_key", F.lit(None).cast("int").alias("start")))
    return marks.groupBy("id_key", "text_key").agg(F.bool_or(F.col("start").isNull()).alias("copy"), F.collect_list("start").alias("starts"))


KEPT = "doc_id long, n_words long, n_removed long, kept binary"


def kept_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, log_cells: int = LOG_CELLS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and ``kept``, its kept words joined by one space.

    A word goes if a window over it has the same words as a window that starts
    earlier: in a smaller doc_id (null before all), or in the same document
    further left. Null, empty and short texts have no windows and keep all
    words. Rows that repeat a doc_id and its text get the same result; a
    window at the same start of the same doc_id is not earlier. Other columns
    are not read; an empty table gives no rows. The repeated starts are written
    first, so that their shuffles are gone from the disk when the texts are moved.
    """
    repeated = write_and_read(repeated_starts(docs, window, gram, log_cells), "repeated-starts")
    marked = _keyed(docs).join(repeated, ["id_key", "text_key"], "left")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for body, copy, starts in zip(batch.column("body").to_pylist(), batch.column("copy").to_pylist(), batch.column("starts")):
                words = body.split()
                gone = 0
                if copy and len(words) >= window:
                    gone = len(words)
                    out[2].append(b"")
                elif starts.is_valid and len(starts):
                    step = np.zeros(len(words) + 1, np.int64)
                    begin = starts.values.to_numpy()
                    np.add.at(step, begin, 1)
                    np.add.at(step, begin + window, -1)
                    stays = np.cumsum(step)[:-1] == 0
                    gone = len(words) - int(stays.sum())
                    out[2].append(b" ".join([words[i] for i in np.flatnonzero(stays)]))
                else:
                    out[2].append(b" ".join(words))
                out[0].append(len(words))
                out[1].append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept"])

    return in_arrow(marked.select("doc_id", "body", "copy", "starts"), run, KEPT)


def substring_digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, log_cells: int = LOG_CELLS) -> DataFrame:
    """``kept_words`` with the SHA-256 of the kept text in its place."""
    return kept_words(docs, window, gram, log_cells).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SUBSTRING_SQL = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW} + 2)) AS start FROM split),
windows AS (SELECT doc_id, start, array_to_string(words[start:start + {WINDOW} - 1], ' ') AS body FROM places),
later AS (
  SELECT doc_id, start FROM (
    SELECT doc_id, start, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, start + k AS place FROM later, range({WINDOW}) AS steps(k)),
single AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split),
kept AS (
  SELECT s.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS body FROM single s ANTI JOIN gone g USING (doc_id, place) GROUP BY s.doc_id)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, (len(s.words) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.body, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
