"""Connected components of a large edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b): root is the smallest
    node reachable.  Alternating large-star and small-star rounds; each is a join
    and an aggregation of the edges, written down before the next, so hubs neither
    meet in one task's memory nor make lineage grow.
    """
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    before = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        # Large star: each larger neighbour of u links to u's smallest neighbour.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large.where("u <> v"), tag)
        # Small star: u and its smaller neighbours link to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = durable(small.where("u <> v").distinct(), tag)
    nodes = e.groupBy("u").agg(F.min("v").alias("root"))
    roots = e.select(F.col("v").alias("u")).distinct().join(e.select("u"), "u", "left_anti").select("u", F.col("u").alias("root"))
    return nodes.unionByName(roots).withColumnRenamed("u", "node")
