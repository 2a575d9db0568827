"""Operator 5: best-fit packing with large-item matching.

The packing is worked out on the histogram of piece lengths, which has at most
``capacity`` rows whatever the size of the corpus; every piece then looks up
its own place from its length and its number among the pieces of that length.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import bodies, in_arrow, positions_before
from alertloom.session import write_and_read

CAPACITY = 2048
END_ID = 0
KEPT_WORDS = 300_000  # words whose ids a Python worker keeps; others are encoded again
RANK_BITS = 48
LONE_SPACE = re.compile(r"\s (?!\S)")

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest follow from code 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return table


class _Encoder:
    """Token ids of a byte-level BPE vocabulary file, as little-endian unsigned 32-bit values.

    A space with a visible character on either side always starts a new token,
    so a text that has no other spaces is encoded word by word and frequent
    words are remembered. Texts that hold the string of a special token go to
    the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        chars = _byte_of_char()
        ranks = {bytes(chars[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.plain = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.full = Tokenizer.from_file(path)
        encode = self.plain

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = np.array(encode(" " + word), "<u4").tobytes()
                if len(self) < KEPT_WORDS:
                    self[word] = ids
                return ids

        self.words = Words()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if LONE_SPACE.search(text):
            return np.array(self.plain(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.plain(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


_ENCODERS: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """One encoder per Python process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces with their task's number and their number among that task's pieces of equal length."""

    def run(batches):
        encode = encoder(path)
        seen = [0] * (capacity + 1)
        part = TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                ids = encode(body.decode("utf-8")) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start:4 * (start + length)]
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(own), part, seen[length], own)):
                        column.append(value)
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
            n = 8 if with_ids else 7
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out[:n], kinds)], names[:n])

    return in_arrow(bodies(docs), run, PIECES + (", ids binary" if with_ids else ""))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Packs ``counts[length]`` pieces of each length.

    Returns runs (length, first rank, first bin, pieces per bin, offset): the
    pieces of that length from that rank on, up to the next run of the length,
    fill consecutive bins. Pieces above a third of the capacity come first: the
    longest pairs with the longest partner that still fits. The others follow
    from long to short, each into the smallest gap that holds it.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (first bin, number of bins)
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    used = [0] * (capacity + 1)
    bins = 0

    def take(length: int, n: int, first_bin: int, per_bin: int, offset: int) -> None:
        runs.append((length, used[length], first_bin, per_bin, offset))
        used[length] += n
        left[length] -= n

    large = capacity // 3 + 1

    def partner_of(long: int) -> int:
        """The longest piece left that fits beside ``long``; 0 if none does."""
        fits = range(min(long, capacity - long), large - 1, -1)
        return next((p for p in fits if left[p] >= (2 if p == long else 1)), 0)

    for long in range(capacity, large - 1, -1):
        while left[long]:
            partner = partner_of(long)
            if partner == long:
                n = left[long] // 2
                take(long, 2 * n, bins, 2, 0)
            else:
                n = min(left[long], left[partner]) if partner else left[long]
                take(long, n, bins, 1, 0)
                if partner:
                    take(partner, n, bins, 1, long)
            gaps[capacity - long - partner].append((bins, n))
            bins += n

    for length in range(large - 1, 0, -1):
        while left[length]:
            gap = next((g for g in range(length, capacity + 1) if gaps[g]), None)
            if gap is None:
                n = -(-left[length] // (capacity // length))
                gaps[capacity].append((bins, n))
                bins += n
                continue
            first, n = gaps[gap].pop()
            each = min(gap // length, left[length])
            full = min(n, left[length] // each)
            take(length, full * each, first, each, capacity - gap)
            gaps[gap - each * length].append((first, full))
            if full < n:
                gaps[gap].append((first + full, n - full))
    return runs


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` token ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and ``ids``, the bytes of the piece, ``with_ids``). Null and empty
    texts are one piece that holds only the end id. A null doc_id stays null,
    repeated rows are packed once each, an empty table gives no rows, other
    columns are not read. Ties between equal lengths go by task and row order.
    """
    found = write_and_read(pieces(docs, path, capacity, with_ids), "pieces")
    counts = found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    total = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(sorted(plan_bins(total, capacity)), np.int64).reshape(-1, 5)
    keys = (runs[:, 0] << RANK_BITS) | runs[:, 1]
    ranked = found.join(positions_before(counts, ["length"], "part", "n", "before").drop("n"), ["part", "length"])

    def place(batches):
        for batch in batches:
            length, before, nth = (batch.column(c).to_numpy() for c in ("length", "before", "nth"))
            rank = before + nth
            at = np.searchsorted(keys, (length << RANK_BITS) | rank, "right") - 1
            k = rank - runs[at, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(runs[at, 2] + k // runs[at, 3]), pa.array(runs[at, 4] + k % runs[at, 3] * length)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                columns, names = [*columns, batch.column("ids")], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_arrow(ranked, place, PLACED + (", ids binary" if with_ids else ""))
