"""Directory trees and rollups over file paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors
from ..plans.lineage import numbered


def _parent(path) -> F.Column:
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def directory_rollup(dominant: DataFrame) -> DataFrame:
    """``dominant(path, community_id)`` -> dir, n_files, community_id of most files below it (ties to the lesser id), at every level."""
    flat = dominant.select(F.explode(ancestors(F.col("path"))).alias("dir"), "community_id")
    counts = flat.groupBy("dir", "community_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("dir").agg(F.sum("n").alias("n_files"), F.min_by("community_id", F.struct(-F.col("n"), "community_id")).alias("community_id"))


def schematic(files: DataFrame, symbols: DataFrame | None = None, depth: int = 3) -> DataFrame:
    """node_type, path, parent, depth, label, n_children down to ``depth``: directories, files and, if given, symbols."""
    base = files.select("path", F.size(F.split("path", "/")).alias("depth"))
    dirs = base.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("depth", F.size(F.split("path", "/")))
    cols = lambda kind: [F.lit(kind).alias("node_type"), F.col("path"), _parent(F.col("path")).alias("parent"), F.col("depth").cast("long").alias("depth"), F.element_at(F.split("path", "/"), -1).alias("label")]
    out = dirs.select(*cols("directory")).unionByName(base.select(*cols("file")))
    if symbols is not None:
        own = symbols.select(F.concat("path", F.lit("#"), "symbol_id").alias("path"), F.col("path").alias("parent"), F.size(F.split("path", "/")).cast("long").alias("depth"), F.col("name").alias("label"))
        out = out.unionByName(own.select(F.lit("symbol").alias("node_type"), "path", "parent", "depth", "label"))
    counts = out.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n_children"))
    return out.where(F.col("depth") <= depth).join(counts, "path", "left").select("node_type", "path", "parent", "depth", "label", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))


def expand(files: DataFrame, folder: str) -> DataFrame:
    """Direct children of a directory: node_type, path, label."""
    below = files.where(F.col("path").startswith(f"{folder}/")).select("path", F.substring("path", len(folder) + 2, 1 << 20).alias("rest"))
    head = F.split("rest", "/")[0]
    kind = F.when(F.col("rest").contains("/"), "directory").otherwise("file")
    return below.select(kind.alias("node_type"), F.concat(F.lit(f"{folder}/"), head).alias("path"), head.alias("label")).distinct()


def file_tree(files: DataFrame, indent: str = "  ") -> DataFrame:
    """place, line of the indented tree, directories before files, then by name."""
    rows = schematic(files, None, 1 << 20).select("node_type", "path", "depth", "label")
    steps = F.split("path", "/")
    last = F.size(steps) - 1
    # every step above the last is a directory; the last is marked by what the row is
    key = F.array_join(F.transform(steps, lambda s, i: F.concat(F.when((i < last) | (F.col("node_type") == "directory"), "0").otherwise("1"), s)), "\u0001")
    line = F.concat(F.repeat(F.lit(indent), F.col("depth").cast("int") - 1), "label", F.when(F.col("node_type") == "directory", "/").otherwise(""))
    return numbered(rows.select(key.alias("key"), line.alias("line")), ["key"], "place").select("place", "line")


def common_prefix(paths: DataFrame) -> DataFrame:
    """prefix: longest directory prefix that all paths share; that of the least and the greatest path."""
    ends = paths.agg(F.min("path").alias("a"), F.max("path").alias("b"))
    size = F.least(F.length("a"), F.length("b"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda k: F.substring(F.col("a"), F.lit(1), k) == F.substring(F.col("b"), F.lit(1), k)))
    return ends.select(F.regexp_replace(F.substring(F.col("a"), F.lit(1), same), "[^/]*$", "").alias("prefix"))


def printed_tree(files: DataFrame, style: str = "default") -> DataFrame:
    """place, line of a tree drawn in a style: default and extended (branches), compact (a bar) or minimal (indents); directories first, then by name.

    The first level has no branch and its children no indent.  Whether a node is its parent's last child is one aggregate a parent.
    """
    rows = schematic(files, None, 1 << 20).select("node_type", "path", "parent", "depth", "label")
    mark = F.when(F.col("node_type") == "directory", "0").otherwise("1")
    rows = rows.withColumn("own", F.concat(mark, "label"))
    last = rows.groupBy("parent").agg(F.max("own").alias("own")).withColumn("last", F.lit(True))
    flags = rows.join(last, ["parent", "own"], "left").select("path", "depth", F.coalesce("last", F.lit(False)).alias("last"))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    lines = rows.select("node_type", "path", "label", F.explode(above).alias("step"))
    way = lines.join(flags.withColumnRenamed("path", "step"), "step").groupBy("node_type", "path", "label").agg(F.array_sort(F.collect_list(F.struct("depth", "last"))).alias("way"))
    inner = F.slice("way", 2, F.greatest(F.size("way") - 2, F.lit(0)))  # the levels between the first and the node's own
    tail = F.concat("label", F.when(F.col("node_type") == "directory", "/").otherwise(""))
    deep = F.size("way") > 1
    if style == "compact":
        line = F.concat(F.repeat(F.lit("  "), F.size(inner)), F.when(deep, "| ").otherwise(""), tail)
    elif style == "minimal":
        line = F.concat(F.repeat(F.lit("  "), F.size(inner)), tail)
    else:
        bars = F.array_join(F.transform(inner, lambda x: F.when(x["last"], "    ").otherwise("│   ")), "")
        line = F.concat(bars, F.when(~deep, "").when(F.element_at("way", -1)["last"], "└── ").otherwise("├── "), tail)
    n = F.size(steps) - 1
    key = F.array_join(F.transform(steps, lambda s, i: F.concat(F.when((i < n) | (F.col("node_type") == "directory"), "0").otherwise("1"), s)), "\u0001")
    return numbered(way.select(key.alias("key"), line.alias("line")), ["key"], "place").select("place", "line")


def collapse(nodes: DataFrame, folder: str) -> DataFrame:
    """Tree rows without the descendants of ``folder``, which itself stays."""
    return nodes.where(~F.col("path").startswith(f"{folder}/"))


def matching(files: DataFrame, text: str) -> DataFrame:
    """node_type, path of the files whose path holds ``text``, letter case apart, and of every directory above one."""
    hits = files.where(F.lower("path").contains(text.lower())).select("path")
    dirs = hits.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return hits.select(F.lit("file").alias("node_type"), "path").unionByName(dirs.select(F.lit("directory").alias("node_type"), "path"))


def enriched(files: DataFrame, dominant: DataFrame, labels: DataFrame, progress: DataFrame, chapters: DataFrame, colors: int = 10) -> DataFrame:
    """node_type, path, community_id, label, color, chapter_id, done, total of every file and directory.

    ``dominant(path, community_id)`` gives a file's community, :func:`directory_rollup` a directory's; ``chapters(community_id, chapter_id)``
    and ``progress(chapter_id, done, total)`` say how far its chapter is.
    """
    own = files.select("path").join(dominant.select("path", "community_id"), "path", "left").select(F.lit("file").alias("node_type"), "path", "community_id")
    dirs = directory_rollup(dominant).select(F.lit("directory").alias("node_type"), F.col("dir").alias("path"), "community_id")
    out = own.unionByName(dirs).join(labels, "community_id", "left").join(chapters, "community_id", "left").join(progress, "chapter_id", "left")
    label = F.when(F.col("community_id").isNotNull(), F.coalesce("label", F.concat(F.lit("community_"), "community_id")))
    return out.select("node_type", "path", "community_id", label.alias("label"), (F.col("community_id") % colors).alias("color"), "chapter_id", "done", "total")


def of_community(files: DataFrame, symbols: DataFrame, members: DataFrame, community: int) -> DataFrame:
    """The files that hold a symbol of a community, each once."""
    held = symbols.select("symbol_id", "file_id").join(members.where(F.col("community_id") == community), "symbol_id", "left_semi")
    return files.join(held, "file_id", "left_semi")


def expand_file(symbols: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The symbols of a file, and every edge that touches one."""
    from .lookups import touching

    own = symbols.where(F.col("path") == path)
    return own.select("symbol_id", "name", "kind", "start_line", "end_line"), touching(edges, own.select("symbol_id"))


def node_detail(symbols: DataFrame, edges: DataFrame, members: DataFrame, labels: DataFrame, chapters: DataFrame, progress: DataFrame, symbol: int, most: int = 20) -> DataFrame:
    """A symbol's row with its community's label, the ``most`` least ids that lead to it and that it leads to, and its chapter's progress."""

    def side(own: str, other: str, name: str) -> DataFrame:
        ids = edges.where(F.col(own) == symbol).select(F.col(other).alias("o")).distinct().orderBy("o").limit(most)
        return ids.agg(F.nullif(F.array_join(F.array_sort(F.collect_list("o")), ","), F.lit("")).alias(name))  # one row

    own = symbols.where(F.col("symbol_id") == symbol).select("symbol_id", "name", "kind", "path")
    out = own.join(members, "symbol_id", "left").join(labels, "community_id", "left").join(chapters, "community_id", "left").join(progress.select("chapter_id", "done", "total"), "chapter_id", "left")
    out = out.crossJoin(side("target_id", "source_id", "callers")).crossJoin(side("source_id", "target_id", "callees"))
    return out.select("symbol_id", "name", "kind", "path", "label", "callers", "callees", "chapter_id", "done", "total")
