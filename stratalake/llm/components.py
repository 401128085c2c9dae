"""Connected components by alternating star contraction, on edges that stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.exchange import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node's neighbours are linked to its least neighbour instead."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(back) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = around.join(least, "u")
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (least node of its component) of all nodes that are no root.

    ``edges`` has two columns of one orderable type. Each round moves every link to
    the least neighbour on both sides; rounds grow with the logarithm of the longest path,
    and a hub's links are only ever aggregated or joined, never gathered.
    """
    a, b = edges.columns
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        now = stored(_star(_star(now, True), False), "links")
