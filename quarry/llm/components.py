"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, space: Workspace, label: str = "star") -> DataFrame:
    """``edges(a, b)`` of any orderable type -> (node, root): root is the least node reachable.

    Each round joins every edge with the least neighbour of its end; sums over a
    hub's edges are combined before the shuffle and the join may split a hub.
    Rounds are written to the shared folder; their number grows with the logarithm of the longest path.
    """
    now = space.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0")
    turn = 0
    while True:
        turn += 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every u now points only at lesser ones
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = space.table(small, f"{label}-{turn}")
        same = after.count() == now.count() and after.exceptAll(now).isEmpty()
        space.drop(f"{label}-{turn - 1}")
        now = after
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
