"""Connected components over an edge table by alternating large-star and small-star steps.

Each step is an aggregate and a join on DataFrames; nothing is collected but a row count and two checksums of 64 bits. A vertex with
very many edges is a skewed join key, which adaptive execution splits; the minimum is combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above u join the least neighbour. Small star: u and its neighbours below do."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = around.join(least, "u")
    if large:
        tied = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return tied.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of edges (u, v): root is the least vertex it is connected with.

    u and v have one orderable type. Edges with a null end and loops are ignored; repeated edges count once; no edges
    give no rows.
    """
    now = staged(edges.select("u", "v").filter("u != v").distinct(), "edges")
    hashed, mark = F.xxhash64("u", "v"), None
    while True:
        sums = (F.count("*").alias("n"), F.sum(hashed.cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64(hashed)).alias("xor"))
        seen = tuple(now.agg(*sums).first())
        if not seen[0] or seen == mark:
            break
        mark, half = seen, staged(_stars(now, True), "stars")
        dropped(now)
        now = staged(_stars(half, False), "stars")
        dropped(half)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "vertex")
    return roots.union(now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
