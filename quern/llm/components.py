"""Connected components with DataFrame operations only.

Alternating large-star and small-star steps: every step hangs a node's neighbours on the smallest node it knows, until all
trees are stars.  Minima are pre-aggregated before each shuffle and joined back with plain equi-joins, whose skewed partitions
adaptive execution can split, so a hub with a third of all links is neither collected nor windowed in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _signature(e: DataFrame):
    return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links ``edges`` (src, dst); a component is named by its smallest node.

    Links with a null end and loops are ignored; repeated links count once; no links give no rows.  Only a row count and a
    checksum of each round reach the driver.
    """
    a, b = F.col("src"), F.col("dst")
    e = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut(e)
    before = _signature(e)
    for _ in range(rounds if before[0] else 0):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
