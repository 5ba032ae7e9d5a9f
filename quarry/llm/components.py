"""Connected components by alternating stars on a table of (child, parent) edges, parent < child."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of edges (lo, hi); component is the smallest node that can be reached.

    A round hooks every parent of a node to the node's smallest parent, then moves every edge up to the smallest
    parent of its parent. Rounds are logarithmic in the longest chain. Minima are written before they are joined,
    so both sides of a join are plain scans and adaptive execution may split a hub's partition.
    """
    at = scratch.put(edges.filter("lo <> hi").select(F.greatest("lo", "hi").alias("child"), F.least("lo", "hi").alias("parent")).distinct(), "edges")
    while True:
        low = scratch.put(at.groupBy("child").agg(F.min("parent").alias("low"), F.count(F.lit(1)).alias("n")), "low")
        roots = low.select(F.col("child").alias("parent"))
        if low.filter("n > 1").isEmpty() and at.join(roots, "parent", "left_semi").isEmpty():
            return low.select(F.col("child").alias("node"), F.col("low").alias("component")).unionByName(low.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
        hooked = at.join(low, "child").select(
            F.explode(
                F.when(F.col("parent") == F.col("low"), F.array(F.struct("child", F.col("low").alias("parent")))).otherwise(
                    F.array(F.struct("child", F.col("low").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("low").alias("parent")))
                )
            ).alias("e")
        )
        flat = scratch.put(hooked.select("e.child", "e.parent").distinct(), "hooked")
        up = scratch.put(flat.groupBy("child").agg(F.min("parent").alias("low")), "up").select(F.col("child").alias("parent"), F.col("low").alias("grand"))
        raised = flat.join(up, "parent", "left").select("child", F.coalesce("grand", "parent").alias("parent")).distinct()
        old, at = at, scratch.put(raised, "raised")
        scratch.drop(old, low, flat)
