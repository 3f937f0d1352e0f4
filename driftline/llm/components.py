"""Connected components of an edge table, by alternating large and small stars.

Each round hangs every node on the smallest node it knows of; the rounds needed
grow with the logarithm of a component's length. Neither nodes nor edges leave
the executors: the driver sees a row count and a checksum a round. The minimum
of each node is cut off as a durable table before it is joined back, so that
Spark may split the rows of a node with very many edges between tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import durable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node reachable.

    Loops, repeated edges and edges with a null end add nothing. An empty table
    gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u != v").distinct()
    pairs, before = durable(pairs), None
    while True:
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] == 0 or now == before:
            break
        before = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = durable(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = durable(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
