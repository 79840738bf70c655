"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graderoom.llm.common import materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``v`` (long) -> node, root: the smallest node that each node is connected with.

    Alternates large-star and small-star steps until nothing changes. Each node's smallest neighbour
    is a partial aggregation; it meets the edges in a join, which Spark can split where one node has
    very many edges. No neighbour list is gathered. Nodes without an edge to another do not appear.
    """
    now = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "cc-edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lower.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u <> v").distinct(), "cc-small")
        mark, last = _mark(now), mark
        if mark == last:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
