import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from alertloom.llm.packing import cut, encoder, pack, plan_bins

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_possible(counts, capacity):
    return -(-sum(n * c for n, c in counts.items()) // capacity)


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64, 2048])
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, capacity + 1), min(capacity, rng.randint(1, 25)))}
    runs = sorted(plan_bins(counts, capacity))
    bins = {}
    for i, (length, rank, first, per_bin, offset) in enumerate(runs):
        end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
        for k in range(end - rank):
            bins.setdefault(first + k // per_bin, []).append((offset + k % per_bin * length, length))
    assert sum(map(len, bins.values())) == sum(counts.values())
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    large = sum(c for n, c in counts.items() if n > capacity // 2)
    assert max(best_possible(counts, capacity), large) <= len(bins) <= 1.25 * max(best_possible(counts, capacity), large) + 1


def test_encoder_equals_tokenizer():
    exact = Tokenizer.from_file(PATH)
    own = encoder(PATH)
    rng = random.Random(5)
    texts = ["", " ", "a", "  a", "a\n \nb", "a \n b", "x   y", "don't we'll", "<|endoftext|> a<|endoftext|>", "é \U0001f600 12 3",
             "a\t \tb ", "\n \n", " \n"]
    texts += ["".join(rng.choice([" ", "\n", "\t", "a", "the", "é", "1", ".", "'s", " ", "\r\n"]) for _ in range(60)) for _ in range(400)]
    for text in texts:
        assert np.frombuffer(own(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, text


def test_cut():
    assert cut(5, 5) == [(0, 5)]
    assert cut(11, 5) == [(0, 1), (1, 5), (6, 5)]
    assert cut(10, 5) == [(0, 5), (5, 5)]


def test_pack_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "gamma", "été", "x\n"]) for _ in range(rng.choice([0, 1, 5, 300, 900, 4000]))), "s", 7)
            for i in range(60)]
    rows += [(100, None, "s", 1), (100, None, "s", 1), (None, "lost", None, None), (101, "", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, length long").repartition(5)
    out = pack(docs, PATH, with_ids=True).collect()
    exact = Tokenizer.from_file(PATH)
    want = sorted(([i, exact.encode(t or "", add_special_tokens=False).ids + [0]] for i, t, _, _ in rows), key=str)
    by_doc = {}
    for r in out:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    whole = []
    for doc, own in by_doc.items():
        if doc == 100:
            assert [(r.piece, r.length) for r in own] == [(0, 1), (0, 1)]
            whole += [[100, [0]], [100, [0]]]
            continue
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 2048 for r in own[1:])
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        whole.append([doc, np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist()])
    assert sorted(whole, key=str) == want
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= 1.05 * sum(r.length for r in out) / 2048 + 1


def test_pack_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
