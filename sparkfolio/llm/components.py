"""Connected components of a graph given as an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours go to the smallest node around it.  Small star: a
    node and its smaller neighbours go to the smallest of them.  The smallest is found with
    partial aggregates, and the join back is one that Spark can split at a hot node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).withColumn("m", F.least("node", "m"))
    moved = both.join(least, F.col("u") == F.col("node"))
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v: long) but the roots; root is the smallest
    node of the component.  Each round is written; rounds grow with the logarithm of the
    longest path.  Null ends and loops are ignored, an empty table gives an empty result."""
    edges = written(edges.select("u", "v").filter("u <> v").distinct())
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = None
    while (now := print_of(edges)) != before and now[0]:
        before = now
        edges = written(_star(_star(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
