"""Connected components of a table of links, by alternating large and small stars.

Every step is a grouping and a join on light rows; no component is held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(pairs: DataFrame) -> DataFrame:
    """Written before it is joined, so that a join with a frequent ``a`` can be split."""
    return cut(pairs.groupBy("a").agg(F.min("b").alias("least")))


def _flat(edges: DataFrame) -> bool:
    """Every node has one edge, to a node that has none."""
    up = edges.select(F.col("a").alias("node"), F.lit(1).alias("edges"), F.lit(False).alias("met"))
    down = edges.select(F.col("b").alias("node"), F.lit(0).alias("edges"), F.lit(True).alias("met"))
    nodes = up.unionByName(down).groupBy("node").agg(F.sum("edges").alias("edges"), F.max("met").alias("met"))
    return nodes.where("edges > 1 OR edges = 1 AND met").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> node, root (the least node of its component) for every node but the roots."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)
    while not _flat(edges):
        # large star: the larger neighbours of a node are tied to the least one around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        large = cut(large)
        # small star: a node and its smaller neighbours are tied to the least of them
        tied = large.join(_least(large), "a").select(F.col("b").alias("x"), F.col("least").alias("b"), F.col("a").alias("y"))
        small = tied.select(F.explode(F.array("x", "y")).alias("a"), "b").where("a <> b").distinct()
        edges = cut(small)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
