"""Connected components of an edge list, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), whose edge count never grows beyond the
    input's, until the edges no longer change.  Each round is written to the shared folder; nothing goes to the
    driver but one count and one sum.  The joins are on node ids with both sides shuffled, so that adaptive
    execution can split a hub.
    """
    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}0")
    state, turn = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        turn += 1
        now = scratch.keep(small, f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
        # stars only: no node is both a root and a leaf, and the edges are those of the round before
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or seen[0] == 0:
            break
        state = tuple(seen)
    roots = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    tops = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return roots.unionByName(tops)
