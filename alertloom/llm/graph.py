"""Connected components as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from alertloom.session import write_and_read


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``: root is the smallest node that can be reached.

    Alternating star contraction: first every larger neighbour of a node, then
    every smaller one is linked to the node's smallest neighbour, until only
    stars are left. Minima are combined before the shuffle and joined back, so
    that a node with very many neighbours is never gathered in one task. Every
    round is written to the shared folder; a lost executor repeats one round.
    """
    edges = write_and_read(
        links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        edges = write_and_read(small.select("e.*").filter("a != b").distinct(), "links")
        digest = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == tuple(digest):
            break
        state = tuple(digest)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
