"""Analysis of a corpus that is kept up to date.

A run compares the files as they are with those that earlier runs have seen, parses the new and changed ones, and resolves again only what they touch:
their own calls, imports and bases, and those of other files that name a symbol that came, went or moved, or
may import a path that did.  All relations are partitioned by run and only ever added to:

* ``touched/run=``: path, language, mtime, state (new, changed or gone) of the files that a run took;
* ``parsed/run=``: those files as the parsers give them, nested;
* ``linked/run=``: path of every file whose edges a run resolved; ``edges/run=``: these edges;
* ``done/run=``: a row of counts, written last.

A file's rows in force are those of its last run.  A run that broke off has no ``done`` row, so the next one takes its number and replaces what it
wrote.  Symbols are known by (path, start_line, name), so ids never change; their order takes the place of that of ids.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.code import PARSED, flat, parse_sources
from . import lookups, resolve

_TOUCHED = "path string, language string, mtime timestamp, state string, run bigint"
_PARSED = f"{PARSED}, run bigint"
_ID = "struct<path: string, start_line: bigint, name: string>"
_LINKED, _EDGES, _DONE = "path string, run bigint", f"path string, source {_ID}, target {_ID}, kind string, confidence double, run bigint", "n_touched bigint, n_parsed bigint, n_linked bigint, n_edges bigint, run bigint"


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _begin(spark: SparkSession, root: str) -> None:
    """Make the relations' folders, before the first run."""
    for name, schema in (("touched", _TOUCHED), ("parsed", _PARSED), ("linked", _LINKED), ("edges", _EDGES), ("shown", "n int, run bigint"), ("done", _DONE)):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("run").parquet(f"{root}/{name}")


def _put(df: DataFrame, root: str, name: str, run: int) -> int:
    """Write ``df`` as a run's whole part of a relation, in place of one that broke off; the number of rows."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/{name}/run={run}")
    return seen.get["n"]


def _work(df: DataFrame, root: str, name: str) -> DataFrame:
    """``df`` written as a table of this run alone, which the next one replaces, so that what reads it twice computes it once."""
    df.write.mode("overwrite").parquet(f"{root}/work/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/work/{name}")


def _known(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """path, run, language, mtime of the files in force, as of the finished runs below ``before``."""
    done = _read(spark, root, "done", _DONE).select("run")
    rows = _read(spark, root, "touched", _TOUCHED).join(done, "run", "left_semi")
    rows = rows if before is None else rows.where(F.col("run") < before)
    last = rows.groupBy("path").agg(F.max_by(F.struct("run", "language", "mtime", "state"), "run").alias("v"))
    return last.where("v.state <> 'gone'").select("path", "v.run", "v.language", "v.mtime")


def last_run(spark: SparkSession, root: str, mark: str = "done") -> int | None:
    """The last run that has the mark, or None."""
    return _read(spark, root, mark, "run bigint").agg(F.max("run")).first()[0]


def mark(spark: SparkSession, root: str, name: str, run: int) -> None:
    """Leave a mark of a caller's own on a run."""
    _put(spark.createDataFrame([(1,)], "n int"), root, name, run)


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, language, mtime, sloc of the files in force; sloc is null where a file does not parse."""
    sizes = _read(spark, root, "parsed", _PARSED).select("path", "run", "sloc")
    return _known(spark, root).join(sizes, ["path", "run"], "left").select("path", "language", "mtime", "sloc")


def parsed(spark: SparkSession, root: str) -> DataFrame:
    """Parsed files in force."""
    return _read(spark, root, "parsed", _PARSED).join(_known(spark, root).select("path", "run"), ["path", "run"], "left_semi").drop("run")


def edges(spark: SparkSession, root: str) -> DataFrame:
    """path, source, target, kind, confidence in force; ``path`` is the file that gives rise to an edge."""
    done = _read(spark, root, "done", _DONE).select("run")
    last = _read(spark, root, "linked", _LINKED).join(done, "run", "left_semi").groupBy("path").agg(F.max("run").alias("run"))
    return _read(spark, root, "edges", _EDGES).join(last, ["path", "run"], "left_semi").drop("run")


def identified(parsed: DataFrame) -> DataFrame:
    """Symbols of parsed files, known by their places: symbol_id, file_id (the path), path, language, name, kind, start_line, end_line, signature."""
    own = flat(parsed, "symbols")
    return own.select(F.struct("path", "start_line", "name").alias("symbol_id"), F.col("path").alias("file_id"), "*")


def _modules(parsed: DataFrame) -> DataFrame:
    return flat(parsed, "imports").select("path", "language", "module").distinct()


def _endings(paths: DataFrame) -> DataFrame:
    """how, candidate: what an import can call a path."""
    steps = F.split("path", "/")
    ends = paths.select(F.lit("suffix").alias("how"), F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, k, F.size(steps)), "/"))).alias("candidate"))
    return paths.select(F.lit("exact").alias("how"), F.col("path").alias("candidate")).unionByName(ends).distinct()


def _resolved(now: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    """Edges that the files of ``paths`` give rise to in the corpus ``now``; only symbols that they name are indexed."""
    own = now.join(paths, "path", "left_semi")
    calls, kin = flat(own, "calls").select("path", "caller", "callee"), flat(own, "heritage").select("path", "child", "parent", "relation")
    named = calls.select(F.explode(F.array("caller", "callee")).alias("name")).union(kin.select(F.explode(F.array("child", "parent")).alias("name"))).distinct()
    targets = _work(resolve.import_edges(_modules(own), now.select(F.col("path").alias("file_id"), "path")), root, "targets")
    whole = paths.union(targets.select("target_file")).distinct()  # files whose first symbol counts
    symbols = identified(now).join(named.withColumn("named", F.lit(True)), "name", "left").join(whole.withColumn("whole", F.lit(True)), "path", "left").where("named or whole")
    symbols = _work(symbols.select("symbol_id", "file_id", "path", "name"), root, "symbols")
    parts = [
        resolve.call_edges(calls, symbols, keep=["path"]),
        resolve.promote_imports(targets, symbols).withColumn("path", F.col("source_id.path")),
        resolve.heritage_edges(kin, symbols, keep=["path"]),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("path", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "kind", "confidence")


def update(files: DataFrame, root: str) -> dict[str, int]:
    """Take ``files(path, language, mtime, content)``, the whole corpus as it stands, into the relations below ``root``; the run's numbers.

    A file is taken if its path is new, its mtime is later than the one known, or either is unknown; a path that is no longer
    there is retracted.  Only rows not older than the oldest of the taken files are read with their content, a
    filter that reaches the scan.  A path must stand in one row; a null path counts as absent; a file that does not parse or has no content is known, but has no symbols.
    Without any change nothing is written.
    """
    spark = files.sparkSession
    _begin(spark, root)
    last = last_run(spark, root)
    run = 0 if last is None else last + 1
    here = files.where("path is not null")
    known = _work(_known(spark, root, run), root, "known")
    listing = here.select("path", "language", F.col("mtime").cast("timestamp").alias("mtime"))
    came = lookups.changed(known, listing).where("state <> 'unchanged'").join(listing, "path").select("path", "language", "mtime", "state")
    left = known.join(listing.select("path"), "path", "left_anti").select("path", "language", "mtime", F.lit("gone").alias("state"))
    counts = {"touched": _put(came.unionByName(left), root, "touched", run), "parsed": 0, "linked": 0, "edges": 0}
    if not counts["touched"]:
        return counts
    touched = _read(spark, root, "touched", _TOUCHED).where(F.col("run") == run)
    taken = touched.where("state <> 'gone'")

    oldest, unknown = taken.agg(F.min("mtime"), F.count_if(F.col("mtime").isNull())).first()
    late = here.where("true" if unknown else F.col("mtime") >= F.lit(oldest)) if oldest is not None or unknown else here.limit(0)
    counts["parsed"] = _put(parse_sources(late.join(taken.select("path"), "path", "left_semi")), root, "parsed", run)

    all_parsed = _read(spark, root, "parsed", _PARSED)
    new = all_parsed.where(F.col("run") == run).drop("run")
    standing = all_parsed.join(known.select("path", "run"), ["path", "run"], "left_semi").drop("run")
    paths = touched.select("path")
    old, rest = standing.join(paths, "path", "left_semi"), standing.join(paths, "path", "left_anti")
    now = rest.unionByName(new)
    was, is_ = identified(old).select("symbol_id"), identified(new).select("symbol_id")
    moved = was.exceptAll(is_).union(is_.exceptAll(was)).select("symbol_id.name").distinct()
    linked = paths
    if run:
        by_name = flat(rest, "calls").select("path", F.explode(F.array("caller", "callee")).alias("name")).union(flat(rest, "heritage").select("path", F.explode(F.array("child", "parent")).alias("name")))
        by_path = resolve.candidates(_modules(rest)).join(_endings(paths), ["how", "candidate"], "left_semi").select("path")
        linked = paths.union(by_name.join(moved, "name", "left_semi").select("path")).union(by_path).distinct()
    counts["linked"] = _put(linked, root, "linked", run)
    linked = _read(spark, root, "linked", _LINKED).where(F.col("run") == run).select("path")
    counts["edges"] = _put(_resolved(now, linked, root), root, "edges", run)
    _put(spark.createDataFrame([tuple(counts.values())], "n_touched bigint, n_parsed bigint, n_linked bigint, n_edges bigint"), root, "done", run)
    return counts
