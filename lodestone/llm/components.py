"""Connected components of an edge table, by alternating large and small stars.

Every step is a join and a partially aggregated minimum, so neither a node's neighbours nor
the links are ever gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import Scratch

EDGES_A_FILE = 200_000


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges(a, b) -> (node, comp) for each node of an edge; comp is the smallest node reachable."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    files = 2 + edges.count() // EDGES_A_FILE
    now = scratch.keep(now, f"{name}-0", files)
    step = 0
    before = None
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        # Large star: neighbours above a node go to the least of its neighbourhood.
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its neighbours below go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = scratch.keep(small, f"{name}-{step + 1}", files)
        mark = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        scratch.drop(f"{name}-{step}")
        step += 1
        now = after
        if mark == before:
            break
        before = mark
    # At the end every edge is a star's: node to least.
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
