"""Operator 6: URL verdicts by host and path rules, else by gradient-boosted trees on lexical features."""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from alertloom.session import write_and_read

# Rules of the query: verdict by host and path.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SAMPLE = 20_000  # labelled URLs that the fit sees at most
TREES, DEPTH, STEP, SEED = 20, 3, 0.2, 11
CUT = 0.5
FOLDS = 5
PRIOR = 20.0  # weight of the overall share in a suffix's share

FEATURES = ["length", "host_length", "host_labels", "host_hyphens", "host_entropy", "depth", "path_length", "path_entropy", "digits", "symbols",
            "parameters", "query_length", "fragment", "longest_label", "suffix_share", "suffix_seen"]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for a null."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is the host or a parent domain and whose path starts the path; else null.

    The list is an argument held in the plan, meant for hundreds of rules.
    """
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own_host, own_path = re.fullmatch(r"(?s)([^/]*)(/?.*)", rule).groups()
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def _count(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in a character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the lexical features of url, host and path, and the suffix (the host's last label)."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query, labels = F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.split(host, r"\.")
    found = {
        "length": F.length(url), "host_length": F.length(host), "host_labels": F.size(labels), "host_hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"))),
        "host_entropy": _entropy(host), "depth": F.length(path) - F.length(F.replace(path, F.lit("/"))), "path_length": F.length(path), "path_entropy": _entropy(path),
        "digits": _count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), "symbols": _count(url, "[^A-Za-z0-9]") / F.greatest(F.length(url), F.lit(1)),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")), "query_length": F.length(query),
        "fragment": F.contains(url, F.lit("#")).cast("int"), "longest_label": F.array_max(F.transform(labels, F.length))}
    return pages.withColumns({k: v.cast("double") for k, v in found.items()} | {"suffix": F.element_at(labels, -1)})


def with_suffix_share(pages: DataFrame, shares: DataFrame, overall: float) -> DataFrame:
    return pages.join(shares, "suffix", "left").fillna({"suffix_share": overall, "suffix_seen": 0.0})


def _shares(ones: Column, seen: Column, overall: float) -> list[Column]:
    return [((ones + PRIOR * overall) / (seen + PRIOR)).alias("suffix_share"), F.log1p(seen).alias("suffix_seen")]


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[GBTClassificationModel | None, DataFrame, float]:
    """Fits on ``labelled(url, host, path, y)``: the trees, the suffix shares and the share of y = 1.

    Suffix statistics count every labelled row; the trees see at most
    ``sample`` of them, those of the smallest URL hashes. What a tree sees of a
    row's suffix comes from other hosts alone: hosts are dealt into folds, and the
    labels of the row's own fold are left out. Without both labels there are no
    trees.
    """
    own = labelled.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    counted = [F.sum("y").alias("ones"), F.count(F.lit(1)).cast("double").alias("seen")]
    by_fold = write_and_read(own.groupBy("suffix", "fold").agg(*counted), "suffixes")
    by_suffix = by_fold.groupBy("suffix").agg(F.sum("ones").alias("ones"), F.sum("seen").alias("seen"))
    total = by_fold.agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0.0))).first()
    overall = float(total[0]) / total[1] if total[1] else 0.0
    shares = by_suffix.select("suffix", *_shares(F.col("ones"), F.col("seen"), overall))
    elsewhere = by_fold.join(by_suffix.select("suffix", F.col("ones").alias("all_ones"), F.col("seen").alias("all_seen")), "suffix").select(
        "suffix", "fold", *_shares(F.col("all_ones") - F.col("ones"), F.col("all_seen") - F.col("seen"), overall))
    chosen = own.orderBy(F.xxhash64("url"), "url", "y").limit(sample)
    known = lexical(chosen.drop("suffix")).join(elsewhere, ["suffix", "fold"])
    rows = write_and_read(known.select(*FEATURES, F.col("y").cast("double").alias("y")), "labelled")
    kinds = rows.agg(F.countDistinct("y")).first()[0]
    if kinds < 2:
        return None, shares, overall
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.coalesce(2))
    model = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, checkpointInterval=-1).fit(vectors)
    return model, shares, overall


def probability(urls: DataFrame, model: GBTClassificationModel | None, shares: DataFrame, overall: float) -> DataFrame:
    """Adds ``p``, the probability of y = 1, to rows with url, host and path."""
    if model is None:
        return urls.withColumn("p", F.lit(1.0 if overall > 0 else 0.0))
    inputs = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_suffix_share(lexical(urls), shares, overall))
    return model.transform(inputs).withColumn("p", vector_to_array("probability")[1])


def held_out(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """url, y, p of one fold of hosts, scored by what the other hosts teach: no host is on both sides."""
    out = F.pmod(F.xxhash64(F.lit("held out"), "host"), F.lit(FOLDS)) == 0
    return probability(labelled.filter(out), *train(labelled.filter(~out), sample)).select("url", "y", "p")


def judge(pages: DataFrame, rules: dict[str, str] = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for every page.

    ``labelled(url, y)`` holds URLs to learn from (y = 1: block); left out, the
    pages that a rule decides are the labelled URLs. A page without a rule is
    blocked if the trees give it a probability of at least ``CUT``; without
    labels of both kinds, the kind there is decides (allow if none). p_block
    is null for pages with a rule. Null URLs have an empty host and path and
    are judged like any other. Rows and ids repeat as they come; other columns
    are not read; an empty table gives no rows.
    """
    url = F.col("url")
    parted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parted.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else None
    by_rule = verdicts[F.col("rule")] if rules else F.lit(None).cast("string")
    if labelled is None:
        known = ruled.filter("rule IS NOT NULL").select("url", "host", "path", (by_rule == "block").cast("int").alias("y"))
    else:
        known = labelled.select("url", host_of(url).alias("host"), path_of(url).alias("path"), F.col("y").cast("int").alias("y")).dropna(subset=["url", "y"])
    scored = probability(ruled, *train(known, sample))
    verdict = F.coalesce(by_rule, F.when(F.col("p") >= CUT, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("p")).alias("p_block"))
