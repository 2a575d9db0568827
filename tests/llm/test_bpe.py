import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from alertloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, decoded int, task int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_tree(codec, text, leaf):
    out = []
    for part, special in codec.parts(text):
        if special is not None:
            out.append(special)
        else:
            out += codec.joined(part, [codec.leaf(part[a:a + leaf], a) for a in range(0, max(len(part), 1), leaf)]).ids.tolist()
    return out


POOLS = [
    [chr(i) for i in range(256)], list("abcdeftinghs'' .,12"), list("'srtevmld "), list("aàÀßÞ×÷́İΣςσÅﬁ中文😀  \x1c\x85  xyz'S'RE"),
    ["the", "ing", "an", " ", "'", "<|endoftext|>", "<|startoftext|>", "<|", "x"], ["the", "ing", "an", "er", "at", "a"], list("!?.-'"), list("éèaß")]


@pytest.mark.parametrize("seed", range(4))
def test_every_cut_gives_the_same_ids(library, monkeypatch, seed):
    monkeypatch.setattr(bpe, "LONG_WORD", 64 if seed % 2 else 4)
    codec, rnd = bpe.Codec(PATH), random.Random(seed)
    for _ in range(500):
        pool = rnd.choice(POOLS)
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 120)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == want
        assert by_tree(codec, text, rnd.choice([1, 2, 3, 5, 8, 17, 50])) == want
        assert codec.decode(codec.encode(text)).decode() == library.decode(want, skip_special_tokens=False)


def test_windows_stay_small_in_a_long_word(library, monkeypatch):
    codec, rnd, seen = bpe.Codec(PATH), random.Random(5), []
    text = "".join(rnd.choice(["the", "ing", "an", "er", "at", "a", "qu"]) for _ in range(20_000))
    plain = codec.plain
    monkeypatch.setattr(codec, "plain", lambda ids: seen.append(len(ids)) or plain(ids))
    assert by_tree(codec, text, 4096) == library.encode(text, add_special_tokens=False).ids
    assert seen and max(seen) <= 64


def test_rows_of_every_kind(spark, library):
    long_word, prose = "theingan" * 3000, "It's 'quoted' text, we'll see 42 times. Größe Straße " * 900
    texts = [None, "", " \n\t ", "a", long_word, prose, prose + long_word + "!" * 20_000 + "'s", "<|endoftext|>" + prose + "<|startoftext|>", "Ⅷ ﬁ İ" * 4000]
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(texts)] + [(None, prose, "x", 1, 2), (4, long_word, "x", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, bpe.token_digest(docs, PATH, leaf=5000).collect()), key=str)
    want = []
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    whole = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(r.decoded for r in whole.where("doc_id = 3").collect()) == ["a</w>"]
    assert bpe.token_digest(docs.limit(0), PATH).count() == 0


def test_all_documents_against_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(docs, PATH, leaf=1000).collect()}
    assert got == {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
