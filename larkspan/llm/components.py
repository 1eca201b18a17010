"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.scratch import materialize


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()


#: Edges that one task writes.
EDGES_A_TASK = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to (node, component): the smallest node that can be reached. Nodes without an edge
    to another node are left out. Only a count and a checksum reach the driver; by the count, a few edges are written by few tasks."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    last = _signature(edges)
    while last[0]:
        tasks = 1 + 2 * last[0] // EDGES_A_TASK
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.coalesce(tasks), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small.coalesce(tasks), "edges")
        now = _signature(edges)
        if now == last:
            break
        last = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select("v", "v").distinct().toDF("node", "component")).distinct()
