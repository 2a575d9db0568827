"""Operator 11: BPE encoding by tree concatenation, and decoding.

Short texts are encoded word by word in one Arrow pass. A long text is cut into
leaves of equal length wherever that falls, inside words too. Leaves are rows and
are encoded in parallel; the leaves of one text then meet again and are joined in
a binary tree. At a join the words around it are found anew in a window that
grows until a word starts where one starts on the right, and the pieces of a long
word that crosses it are encoded anew in a window that grows until its first and
last piece are those of the two sides. A sequence of pieces is what BPE makes of a
word exactly if every two neighbours are, so nothing outside the window changes.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, models

from alertloom.llm.common import in_arrow
from alertloom.session import write_and_read

LEAF = 32_768        # code points of a leaf; texts up to this length are not cut
LONG_WORD = 64       # code points from which a word that crosses a join is joined piece by piece
AHEAD = 3            # code points that finding a word looks at beyond its start: the longest contraction
FIRST_WINDOW = 16
KEPT_WORDS = 500_000

# The word pattern for lower-case text of the first 256 code points, where it needs no tables. Fixed values.
LATIN_SPACE = r"\t-\r \x85\xa0"
LATIN_LETTER = r"a-zªµºß-öø-ÿ"
LATIN_DIGIT = r"0-9²³¹¼-¾"
LATIN_WORD = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTER}]+|[{LATIN_DIGIT}]|[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_DIGIT}]+")
BEYOND_LATIN = re.compile("[^\x00-\xff]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin bytes are themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    letter = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letter[b] for b in range(256)]


class Node:
    """The encoding of ``text[begin:end]`` on its own: word bounds, pieces per word, piece ids."""

    __slots__ = ("begin", "end", "starts", "ends", "first", "ids")

    def __init__(self, begin: int, end: int, starts: list[int], ends: list[int], counts, ids: np.ndarray) -> None:
        self.begin, self.end, self.starts, self.ends, self.ids = begin, end, starts, ends, ids
        self.first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def counts(self, a: int, b: int) -> np.ndarray:
        return np.diff(self.first[a:b + 1])

    def pieces(self, word: int) -> np.ndarray:
        return self.ids[self.first[word]:self.first[word + 1]]


class Codec:
    """One vocabulary file in one Python process."""

    def __init__(self, path: str) -> None:
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must match plain text")
        if model["end_of_word_suffix"] is None or model["continuing_subword_prefix"] or spec["decoder"] is not None:
            raise ValueError("the vocabulary must mark word ends and have no decoder")
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.closed = self.full.model
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.open = models.BPE(vocab=model["vocab"], merges=merges)
        self.suffix = model["end_of_word_suffix"]
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        top = max([*model["vocab"].values(), *self.special.values()])
        self.token = [""] * (top + 1)
        for text, i in [*model["vocab"].items(), *self.special.items()]:
            self.token[i] = text
        self.token_bytes = [t.encode() for t in self.token]
        self.ends_word = np.array([t.endswith(self.suffix) for t in self.token])
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = outer.ids_of(word).tobytes()
                if len(self) < KEPT_WORDS and len(word) <= LONG_WORD:
                    self[word] = ids
                return ids

        self.words = Words()

    def in_letters(self, word: str) -> str:
        return "".join(map(self.letters.__getitem__, word.encode()))

    def ids_of(self, word: str) -> np.ndarray:
        return np.array([t.id for t in self.closed.tokenize(self.in_letters(word))], "<u4")

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text between special tokens, and those: (normalised text, None) or ("", id)."""
        found = self.at_special.split(text) if "<" in text or not all(s.startswith("<") for s in self.special) else [text]
        return [("", self.special[p]) if k % 2 else (self.normalised(p), None) for k, p in enumerate(found) if p]

    def normalised(self, text: str) -> str:
        """Code points up to 255 are composed already, and spaces end words whichever they are."""
        return self.full.normalizer.normalize_str(text) if BEYOND_LATIN.search(text) else text.lower()

    def spans(self, text: str) -> tuple[list[int], list[int]]:
        """Starts and ends of the words of normalised text."""
        if BEYOND_LATIN.search(text):
            found = [span for _, span in self.full.pre_tokenizer.pre_tokenize_str(text)]
        else:
            found = [m.span() for m in LATIN_WORD.finditer(text)]
        return [a for a, _ in found], [b for _, b in found]

    def encode(self, text: str) -> bytes:
        """Ids of a short text as little-endian 32-bit integers."""
        out = []
        for part, special in self.parts(text):
            if special is not None:
                out.append(np.array([special], "<u4").tobytes())
            elif BEYOND_LATIN.search(part):
                out += [self.words[part[a:b]] for a, b in zip(*self.spans(part))]
            else:
                out += map(self.words.__getitem__, LATIN_WORD.findall(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """What the library's ``decode`` gives without a decoder: the pieces' names, a space between them."""
        return b" ".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def leaf_ids(self, text: str) -> bytes:
        """Ids of a stretch of normalised text on its own."""
        return b"".join([self.words[text[a:b]] for a, b in zip(*self.spans(text))])

    def leaf(self, text: str, begin: int, ids: bytes | None = None) -> Node:
        """A leaf; its positions count from the start of the whole text. Every word ends with a piece that says so."""
        starts, ends = self.spans(text)
        own = np.frombuffer(self.leaf_ids(text) if ids is None else ids, "<u4")
        counts = np.diff(np.flatnonzero(self.ends_word[own]), prepend=-1)
        return Node(begin, begin + len(text), [begin + a for a in starts], [begin + b for b in ends], counts, own)

    def join(self, text: str, left: Node, right: Node) -> Node:
        """The encoding of two neighbouring stretches of ``text`` as one."""
        cut = left.end
        i = max(bisect_right(left.starts, cut - AHEAD) - 1, 0)
        size = FIRST_WINDOW
        while True:
            at = left.starts[i] if left.starts else left.begin
            upto = min(cut + size, right.end)
            starts, ends = self.spans(text[at:upto])
            starts, ends = [at + a for a in starts], [at + b for b in ends]
            # Words that the end of the window may have cut are not known yet.
            known = len(starts) if upto == right.end else bisect_right(starts, upto - AHEAD)
            while known and upto < right.end and ends[known - 1] >= upto:
                known -= 1
            j, n = len(right.starts), known
            for k in range(bisect_left(starts, cut), known):
                r = bisect_left(right.starts, starts[k])
                if r < len(right.starts) and right.starts[r] == starts[k]:
                    j, n = r, k
                    break
            if j < len(right.starts) or upto == right.end:
                break
            size *= 2
        words = [self.rejoined(text, left, right, a, b) for a, b in zip(starts[:n], ends[:n])]
        ids = [left.ids[:left.first[i]], *words, right.ids[right.first[j]:]]
        counts = np.concatenate([left.counts(0, i), np.array([len(w) for w in words], np.int64), right.counts(j, len(right.starts))])
        return Node(
            left.begin, right.end, left.starts[:i] + starts[:n] + right.starts[j:], left.ends[:i] + ends[:n] + right.ends[j:],
            counts, np.concatenate(ids))

    def rejoined(self, text: str, left: Node, right: Node, a: int, b: int) -> np.ndarray:
        """Pieces of the word ``text[a:b]`` near a join, out of the pieces of both sides where it is long."""
        cut = left.end
        if b - a <= LONG_WORD or a >= cut:
            return np.frombuffer(self.words[text[a:b]], "<u4")
        k = bisect_left(left.starts, a)
        own = k < len(left.starts) and left.starts[k] == a
        if own and left.ends[k] == b:
            return left.pieces(k)
        if b <= cut:
            return self.ids_of(text[a:b])
        before = left.pieces(k) if own and left.ends[k] == cut else self.ids_of(text[a:cut])
        whole = bool(right.ends) and right.starts[0] == cut and right.ends[0] == b
        return self.join_pieces(before, right.pieces(0) if whole else self.ids_of(text[cut:b]))

    def plain(self, ids: np.ndarray) -> str:
        """The letters of pieces, without marks of word ends."""
        names = [self.token[i] for i in ids.tolist()]
        return "".join(n[:-len(self.suffix)] if n.endswith(self.suffix) else n for n in names)

    def join_pieces(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pieces of a word out of those of two stretches of it, each encoded as a word of its own."""
        size = 2
        while True:
            before, after = min(size, len(left)), min(size, len(right))
            window = self.plain(left[len(left) - before:]) + self.plain(right[:after])
            model = self.closed if after == len(right) else self.open
            ids = np.array([t.id for t in model.tokenize(window)], "<u4")
            agree_left = before == len(left) or ids[0] == left[len(left) - before]
            agree_right = after == len(right) or ids[-1] == right[after - 1]
            if agree_left and agree_right:
                return np.concatenate([left[:len(left) - before], ids, right[after:]])
            size *= 2

    def joined(self, text: str, nodes: list[Node]) -> Node:
        while len(nodes) > 1:
            nodes = [self.join(text, *nodes[k:k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return nodes[0]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per Python process and vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


IDS = "doc_id long, ids binary"
LEAVES = "doc_id long, task int, row long, part int, at long, special long, body string"
NODES = "doc_id long, task int, row long, node struct<part: int, at: long, special: long, body: string, ids: binary>"


def _encode_short(path: str):
    def run(batches):
        encode = codec(path).encode
        for batch in batches:
            ids = [encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _cut(path: str, leaf: int):
    """Long texts into normalised leaves; a row's key is its task and its number there."""

    def run(batches):
        parts = codec(path).parts
        task, row = TaskContext.get().partitionId(), 0
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                out: list[tuple] = []
                for k, (part, special) in enumerate(parts(text)):
                    out += [(doc_id, task, row, k, at, special, part[at:at + leaf]) for at in range(0, max(len(part), 1), leaf)]
                row += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], [
                    "doc_id", "task", "row", "part", "at", "special", "body"])

    return run


def _encode_leaves(path: str):
    def run(batches):
        encode_leaf = codec(path).leaf_ids
        for batch in batches:
            ids = [
                encode_leaf(body) if special is None else np.array([special], "<u4").tobytes()
                for body, special in zip(batch.column("body").to_pylist(), batch.column("special").to_pylist())]
            names = ["part", "at", "special", "body"]
            node = pa.StructArray.from_arrays([*map(batch.column, names), pa.array(ids, pa.binary())], [*names, "ids"])
            keys = ["doc_id", "task", "row"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), node], [*keys, "node"])

    return run


def _join_leaves(path: str):
    """The leaves of a text, which are bounded by that one row, into its ids."""

    def run(batches):
        make, join = codec(path).leaf, codec(path).joined
        for batch in batches:
            for doc_id, nodes in zip(batch.column("doc_id").to_pylist(), batch.column("nodes").to_pylist()):
                by_part: dict[int, list] = {}
                for node in sorted(nodes, key=lambda x: (x["part"], x["at"])):
                    by_part.setdefault(node["part"], []).append(node)
                out = []
                for _, held in sorted(by_part.items()):
                    if held[0]["special"] is not None:
                        out.append(held[0]["ids"])
                        continue
                    made = [make(x["body"], x["at"], x["ids"]) for x in held]
                    out.append(join("".join(x["body"] for x in held), made).ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.array([b"".join(out)], pa.binary())], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and ``ids``, the piece ids of the whole text as little-endian unsigned 32-bit integers, per row.

    The ids are those of the tokenizers library without added special tokens;
    the names of special tokens in a text are those tokens. Null and empty texts
    have no ids. A null doc_id stays null, repeated rows are encoded once each,
    an empty table gives no rows, other columns are not read. Rows keep no order.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = in_arrow(rows.where(F.length("text") <= leaf), _encode_short(path), IDS)
    # Written, since the key of a long row must not change when a lost task runs again.
    leaves = write_and_read(in_arrow(rows.where(F.length("text") > leaf), _cut(path, leaf), LEAVES), "leaves")
    nodes = in_arrow(leaves.repartition("task", "row", "part", "at"), _encode_leaves(path), NODES)
    whole = nodes.groupBy("task", "row").agg(F.first("doc_id").alias("doc_id"), F.collect_list("node").alias("nodes"))
    return short.unionByName(in_arrow(whole.select("doc_id", "nodes"), _join_leaves(path), IDS))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text that the library's ``decode`` makes of ``ids``; no ids give the empty text."""

    def run(batches):
        back = codec(path).decode
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            text = pa.array([back(x) for x in batch.column(at).to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "decoded"])

    return in_arrow(encoded, run, IDS + ", decoded string")


def token_digest(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """``encode`` and ``decode`` in the columns of the query."""
    return decode(encode(docs, path, leaf), path).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
