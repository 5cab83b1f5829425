"""Tables of an analysed corpus: written, replaced, merged by key, cleared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, numbered

#: Tables of one analysis, in the order in which they depend on each other.
ANALYSIS = ("files", "symbols", "edges", "communities", "community_members", "processes", "process_steps", "file_metrics", "patterns", "narratives", "chapters", "chapter_sections", "quiz_questions", "progress")


def number_files(parsed: DataFrame) -> DataFrame:
    """``parsed`` files with file_id by path from 1; paths alone are dealt by ranges and numbered, contents stay where they are.

    ``parsed`` is written first, as it is read three times: to find the ranges, to number, and by the join; a parser must not run for each.
    """
    parsed = cut(parsed)
    return parsed.join(numbered(parsed.select("path"), ["path"], "file_id"), "path")


def number_symbols(files: DataFrame) -> DataFrame:
    """symbol_id, file_id, name, kind, start_line, end_line, signature: ids by file, then by place; no task sees all of them."""
    flat = files.select("file_id", F.posexplode("symbols").alias("i", "x")).select("file_id", "i", "x.*")
    return numbered(flat, ["file_id", "start_line", "name", "i"], "symbol_id").select("symbol_id", "file_id", "name", "kind", "start_line", "end_line", "signature")


def save(frames: dict[str, DataFrame], folder: str) -> None:
    """Replace tables under ``folder``; each goes to a new place first, so a failed write leaves the old one."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/_new_{name}")
    for name in frames:
        _move(next(iter(frames.values())).sparkSession, f"{folder}/_new_{name}", f"{folder}/{name}")


def load(spark: SparkSession, folder: str, tables: tuple[str, ...] = ANALYSIS) -> dict[str, DataFrame]:
    """Readers of the tables that are there."""
    out = {}
    for name in tables:
        fs, path = _fs(spark, f"{folder}/{name}")
        if fs.exists(path):
            out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _move(spark: SparkSession, a: str, b: str) -> None:
    fs, source = _fs(spark, a)
    _, target = _fs(spark, b)
    fs.delete(target, True)
    fs.rename(source, target)


def clear(spark: SparkSession, folder: str, tables: tuple[str, ...] = ANALYSIS) -> None:
    """Delete the tables of an analysis, users' own ones not."""
    for name in tables:
        fs, path = _fs(spark, f"{folder}/{name}")
        fs.delete(path, True)


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in or replaced by key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def ignore_known(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it has not."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(old.columns))


def toggle(annotations: DataFrame, id_: int) -> DataFrame:
    """Annotations with the flag of one turned over."""
    return annotations.withColumn("flagged", F.when(F.col("id") == id_, ~F.col("flagged")).otherwise(F.col("flagged")))


def by_target(annotations: DataFrame) -> DataFrame:
    """target_type, target_id, n, any_flagged, contents (flagged first, then newest) of annotated things."""
    order = F.array_sort(F.collect_list(F.struct((~F.col("flagged")).alias("k"), (-F.unix_micros("created_at")).alias("t"), "content")))
    return annotations.groupBy("target_type", "target_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("flagged").alias("any_flagged"), F.transform(order, lambda x: x["content"]).alias("contents"))
