"""Connected components by alternating star operations, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import shared_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, component): the smallest node that each linked node reaches.

    Large-star and small-star rounds, written to the shared folder, until the links are stars whose centre is the smallest
    node.  Nodes without links, and links of a node with itself, give no rows.  A node with very many links is counted
    with combining, and only its own links follow it; Spark splits such a partition of the join.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = shared_table(edges, "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.join(least, "u").where("v > u AND v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        joined = large.join(least, "u")
        small = joined.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            least.select("u", F.col("least").alias("v"))).where("u <> v").distinct()
        edges = shared_table(small, "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    centres = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
