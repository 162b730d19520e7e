"""Connected components by alternating stars: minimum labels travel by joins that split skewed nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def forest(edges: DataFrame, scratch: Scratch, name: str, most: int | None = None) -> DataFrame:
    """Edges (a, b), b < a, that connect what edges(a, b) connect: after enough rounds each node's goes to its component's smallest node.

    Large and small stars in turn (Kiveris and others, 2014). No node's neighbours are gathered in one
    place: a minimum is aggregated and joined back. `most` ends after so many rounds: what shares a b is connected then too."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    k, before = 0, None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = scratch.keep(small.where("a <> b").distinct(), f"{name}-{k}", small=True)
        if k:
            scratch.drop(f"{name}-{k - 1}")
        k += 1
        if most == k:
            return now
        if most is None:
            state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == before:
                return now
            before = state


def labels(edges: DataFrame) -> DataFrame:
    """node, label of a forest's nodes: one label each, of their component; after too few rounds perhaps not the smallest, or not one for all. A node that isn't named is its own label."""
    return edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
