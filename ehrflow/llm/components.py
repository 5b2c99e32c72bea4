"""Connected components of a table of links, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrflow.llm._shared import written


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, root): root is the smallest node that
    can be reached. Nodes are those of the links; a link of a node to itself
    counts as none.

    Alternating large-star and small-star steps: each node hands its larger
    neighbours, then itself and its smaller ones, to its smallest neighbour.
    It ends when a round changes nothing, after about the logarithm of the
    longest chain. The smallest neighbours are written before they are joined,
    so that a node with very many links is split between tasks."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .filter("u <> v").distinct(), "stars")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = large.join(least, "u")
        edges = written(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
