"""Parameterised reads: lists, pages, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, key: str, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """A page in order of ``key``; the limit is held between 1 and ``most``."""
    return df.orderBy(key).offset(max(0, offset)).limit(min(max(1, limit), most))


def prefix_search(symbols: DataFrame, query: str) -> DataFrame:
    """Names that begin like ``query``, letter case apart; % and _ in it stay wildcards."""
    return symbols.where(F.lower("name").like(query.lower() + "%"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("symbol_id")
    return edges.join(ids.withColumnRenamed("symbol_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("symbol_id", "target_id"), "target_id", "left_semi")


_ROLES = {"CALLS": ("callee", "caller"), "IMPORTS": ("imports", "imported_by"), "EXTENDS": ("extends", "extended_by"), "IMPLEMENTS": ("implements", "implemented_by")}


def neighbours(edges: DataFrame, symbol: int, kind: str | None = None) -> DataFrame:
    """symbol_id, role of what an edge joins to ``symbol``, from either side; ``kind`` in any letter case."""
    own = edges.where(F.lower("kind") == kind.lower()) if kind else edges
    role = lambda side: F.coalesce(*[F.when(F.col("kind") == k, r[side]) for k, r in _ROLES.items()], F.lit("other"))
    out = own.where(F.col("source_id") == symbol).select(F.col("target_id").alias("symbol_id"), role(0).alias("role"))
    return out.unionByName(own.where(F.col("target_id") == symbol).select(F.col("source_id").alias("symbol_id"), role(1).alias("role")))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ``ids``: two semi joins, each edge once."""
    a = edges.join(ids.withColumnRenamed("symbol_id", "source_id"), "source_id", "left_semi")
    b = edges.join(ids.withColumnRenamed("symbol_id", "target_id"), "target_id", "left_semi")
    return a.unionByName(b).dropDuplicates(["edge_id"]).select("edge_id", "source_id", "target_id", "kind", "confidence")


def related(symbols: DataFrame, members: DataFrame, edges: DataFrame, symbol: int, peers: int = 20, ends: int = 10) -> DataFrame:
    """relation, symbol_id: up to ``peers`` of its community, ``ends`` targets and ``ends`` sources, least ids first."""
    home = members.where(F.col("symbol_id") == symbol).select("community_id")
    near = members.join(home, "community_id", "left_semi").where(F.col("symbol_id") != symbol).select("symbol_id").orderBy("symbol_id").limit(peers)
    out = edges.where(F.col("source_id") == symbol).select(F.col("target_id").alias("symbol_id")).distinct().orderBy("symbol_id").limit(ends)
    into = edges.where(F.col("target_id") == symbol).select(F.col("source_id").alias("symbol_id")).distinct().orderBy("symbol_id").limit(ends)
    parts = [near.withColumn("relation", F.lit("community")), out.withColumn("relation", F.lit("calls")), into.withColumn("relation", F.lit("called_by"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("relation", "symbol_id")


def tests_for(symbols: DataFrame, edges: DataFrame, symbol: int, marks: tuple[str, ...] = ("test", "spec")) -> DataFrame:
    """Sources of edges into ``symbol`` whose name has the first mark, or whose path has any."""
    into = edges.where(F.col("target_id") == symbol).select(F.col("source_id").alias("symbol_id")).distinct()
    path = sum((F.lower("path").contains(m).cast("int") for m in marks), F.lit(0)) > 0
    return symbols.join(into, "symbol_id", "left_semi").where(F.lower("name").contains(marks[0]) | path).select("symbol_id", "name", "path")


def community_context(symbols: DataFrame, members: DataFrame, edges: DataFrame, community: int) -> DataFrame:
    """edge_id, source_id, target_id, is_internal of edges that leave the community's members."""
    own = members.where(F.col("community_id") == community).select("symbol_id")
    out = edges.join(own.withColumnRenamed("symbol_id", "source_id"), "source_id", "left_semi")
    flag = own.select(F.col("symbol_id").alias("target_id"), F.lit(True).alias("inside"))
    return out.join(flag, "target_id", "left").select("edge_id", "source_id", "target_id", F.coalesce("inside", F.lit(False)).alias("is_internal"))


def top_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, state of ``new`` files against ``old`` (path, mtime): new, changed or unchanged; an unknown time counts as changed."""
    both = new.join(old.select("path", F.col("mtime").alias("before")), "path", "left").join(old.select("path", F.lit(True).alias("known")), "path", "left")
    state = F.when(F.col("known").isNull(), "new").when(F.col("mtime").isNull() | F.col("before").isNull() | (F.col("mtime") > F.col("before")), "changed").otherwise("unchanged")
    return both.select("path", state.alias("state"))


def latest_state(runs: DataFrame) -> DataFrame:
    """Last status of each (repo_path, step_name) of an append-only run table."""
    return runs.groupBy("repo_path", "step_name").agg(F.max_by(F.struct("status", "error_message"), "ts").alias("s")).select("repo_path", "step_name", "s.*")
