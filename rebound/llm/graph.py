"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregation and one join over slim rows; no node's
neighbours are ever collected, and each step's edges are written to the shared
folder, so lineage stays short and a lost executor costs one step.  The edges of
the step before, and the shuffles between them, are removed as soon as they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebound.session import drop_stored, shared_path, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: links every larger neighbour of a node to the smallest of node and neighbours.
    Small star: links a node and its smaller neighbours to the smallest of them."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


#: Edges in a partition of a round's table, about: rounds over few edges write few files.
PART_EDGES = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; a component's name is its smallest node."""
    spark = edges.sparkSession
    path = shared_path(spark, "edges")
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct(), path)
    mark = None
    while True:
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark, parts = seen, max(1, -(-seen[0] // PART_EDGES))
        for large in (True, False):
            read, path = path, shared_path(spark, "edges")
            now = stored(_star(now.coalesce(parts), large).coalesce(parts), path)
            drop_stored(spark, read)
    # All edges are now (node, smallest node); the smallest nodes themselves are named by them.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
