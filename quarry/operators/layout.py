"""What a viewer of the graph is given: colours, sizes, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors
from ..plans.lineage import cut, numbered

PALETTE = 10


def color_index(community: Column) -> Column:
    return community % PALETTE


def node_size(degree: Column) -> Column:
    """3 + 0.7 for each edge, within 3..14."""
    return F.least(F.greatest(3 + 0.7 * degree, F.lit(3.0)), F.lit(14.0))


def community_size(members: Column) -> Column:
    return F.least(F.greatest(5 + 0.8 * members, F.lit(5.0)), F.lit(30.0))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol_id, layer: nodes without incoming edges first, then what only they lead to; a cycle's rest shares the last layer."""
    left = cut(nodes.select("symbol_id"))
    live = cut(edges.select("source_id", "target_id").where("source_id <> target_id").distinct())
    out, k = None, 0
    while not left.isEmpty():
        free = left.join(live.select(F.col("target_id").alias("symbol_id")), "symbol_id", "left_anti")
        free = cut(free)
        if free.isEmpty():
            free = left
        own = free.withColumn("layer", F.lit(k).cast("long"))
        out = own if out is None else out.unionByName(own)
        left = cut(left.join(free, "symbol_id", "left_anti"))
        live = cut(live.join(free.withColumnRenamed("symbol_id", "source_id"), "source_id", "left_anti").select("source_id", "target_id"))
        k += 1
    return out if out is not None else nodes.select("symbol_id", F.lit(0).cast("long").alias("layer"))


#: Sizes of a tree's boxes: fixed values.
BOX_HEIGHT, BOX_GAP, LEVEL_WIDTH, TOP = 36, 6, 180, 20
LETTER_WIDTH, LABEL_PAD, LEAST_WIDTH, LEAST_ROOT = 7.5, 32, 140, 120


def tree_positions(files: DataFrame, root: str = "root") -> DataFrame:
    """path, depth, x, y, width, height of every directory and file, and of the root (path '').

    Files are stacked in the order of the tree (directories first, then by name); a directory stands in the middle of the files
    below it, so its place follows from the first and the last of them: one aggregate over the ancestors of all files.
    """
    steps = F.split("path", "/")
    last = F.size(steps) - 1
    key = F.array_join(F.transform(steps, lambda s, i: F.concat(F.when(i < last, "0").otherwise("1"), s)), "\u0001")
    leaves = numbered(files.select("path", key.alias("key")), ["key"], "nth").select("path", (F.col("nth") - 1).alias("nth"))
    above = leaves.select(F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("path"), "nth").groupBy("path").agg(F.min("nth").alias("a"), F.max("nth").alias("b"))
    nodes = above.unionByName(leaves.select("path", F.col("nth").alias("a"), F.col("nth").alias("b")))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))).cast("long")
    label = F.when(F.col("path") == "", root).otherwise(F.element_at(F.split("path", "/"), -1))
    step = BOX_HEIGHT + BOX_GAP
    return nodes.select(
        "path",
        depth.alias("depth"),
        (depth * LEVEL_WIDTH).alias("x"),
        (TOP + (F.col("a") + F.col("b")) * step / 2.0).alias("y"),
        F.greatest(F.length(label) * LETTER_WIDTH + LABEL_PAD, F.when(F.col("path") == "", float(LEAST_ROOT)).otherwise(float(LEAST_WIDTH))).alias("width"),
        F.lit(float(BOX_HEIGHT)).alias("height"),
    )
