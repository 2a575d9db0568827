"""Each stage against a plain version on the rows that it gets."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from alertloom.llm.quality import quality_scores
from tests.llm.test_decontaminate import words
from tests.llm.test_jaccard import kept as kept_of
from tests.llm.test_lines import brute as brute_lines

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in quality_scores(docs, labels).collect() if r.predicted}
    first = steps["quality_classifier"](spark, docs, FOLDER)
    assert first.columns == columns and sorted(first.collect()) == sorted(rows[d] for d in good) and len(good) < len(rows)

    second = steps["line_dedup"](spark, first, FOLDER)
    texts = {d: t for d, _, _, t in brute_lines([(d, rows[d].text) for d in good])}
    got = {r.doc_id: r for r in second.collect()}
    assert second.columns == columns and {d: r.text for d, r in got.items()} == texts
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (rows[d].lang, rows[d].source) for d, r in got.items())

    third = steps["simhash_near_dedup"](spark, second, FOLDER)
    kept = set(kept_of(list(texts.items())))
    assert third.columns == columns and sorted(third.collect()) == sorted(got[d] for d in kept) and len(kept) < len(good)

    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {(n, *w[i:i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {w[0] for w in windows}

    def dirty(text):
        w = words(text)
        return any((n, *w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    clean = {d for d in kept if not dirty(texts[d])}
    fourth = steps["benchmark_decontamination"](spark, third, FOLDER)
    assert fourth.columns == columns and {r.doc_id for r in fourth.collect()} == clean and len(clean) < len(kept)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(corpus_pipeline.packing(spark, fourth, FOLDER).collect(), {d: texts[d] for d in clean}, tokenizer)


def check_packing(pieces, texts, tokenizer):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = np.array(tokenizer.encode(texts[d], add_special_tokens=False).ids + [0], "<u4")
        for r in own:
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        assert sum(r.length for r in own) == len(ids)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
