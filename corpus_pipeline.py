"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Every stage reads a null text as an empty one, sorts a null doc_id as its operator
says, gives nothing for an empty table and keeps all columns of its documents, but
for the last, whose rows are token pieces. Repeated rows stay together, except that
the near-duplicate stage keeps one. Ties are settled in the operators' docstrings.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from alertloom.llm.common import table
from alertloom.llm.decontaminate import decontaminate
from alertloom.llm.jaccard import drop_similar
from alertloom.llm.lines import drop_repeated_lines
from alertloom.llm.packing import pack
from alertloom.llm.quality import keep_good
from alertloom.session import write_and_read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that occur earlier go; every document stays, if need be with an empty text."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of texts that share 0.8 or more of their five-word shingles the document with the smallest doc_id stays."""
    return drop_similar(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left and their places in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", contamination), ("best_fit_packing", packing)]

# Fingerprints, model and tokenizer have no SQL form; tests/llm/test_pipeline.py runs a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
