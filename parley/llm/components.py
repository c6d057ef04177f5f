"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import keep


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour, itself included."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is linked to one root and no root to another: then the steps would move nothing."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                             F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    ups, downs = F.sum("up"), F.max("down")
    told = edges.select(ends.alias("e")).select("e.*").groupBy("node").agg(((ups > 1) | ((ups > 0) & (downs > 0))).alias("moves"))
    return not told.agg(F.max("moves")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """Links (u, v) -> (node, root) of every node that is not a root itself; a root is its component's least node.

    `links` is a written table. Each round is written and read back. The steps shorten all paths and stop when only stars
    are left, after a number of rounds that grows with the logarithm of the longest path.
    """
    edges = links.select("u", "v")
    while True:
        edges = keep(_small(_large(edges)), "edges")
        if _stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
