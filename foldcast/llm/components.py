"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.llm.common import staged

#: A node's links beyond those dealt to one task of a round; hubs are spread over salts of their neighbours.
SALTS = 16


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``(id, label)`` of each node of ``edges(a, b)``: the smallest id that it is linked with, directly or not.

    Each round links every node and its neighbours to the smallest of them
    (large star, then small star); edges shrink to stars around the
    smallest ids in about the logarithm of the longest path. Minima are taken
    before they are shuffled, a hub's links are joined by salts, and
    each round is a written table.
    """
    edges = staged(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), tag)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger=True)
        small = staged(_star(large, larger=False), tag)
        if _same(edges, small):
            return small.select(F.col("v").alias("id"), F.col("u").alias("label")).unionByName(
                small.select(F.col("u").alias("id"), F.col("u").alias("label")).distinct()
            )
        edges = small


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Link each node's neighbours (those above it, or those below it and itself) to the smallest node among them and itself.

    ``larger`` takes links in both directions, else each as (smaller, larger).
    """
    near = links if larger else links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    salted = near.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = salted.join(spread, ["u", "salt"]).withColumn("m", F.least("m", "u"))
    if larger:
        made = joined.where("v > u").select(F.col("m").alias("u"), "v")
    else:
        made = joined.select(F.col("m").alias("u"), "v").unionByName(least.select(F.least("m", "u").alias("u"), F.col("u").alias("v")))
    return made.where("u < v").distinct()


def _same(a: DataFrame, b: DataFrame) -> bool:
    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    return digest(a) == digest(b)
