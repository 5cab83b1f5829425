"""Ignore files: ordered patterns of nested folders, with negation, as joins on the folders above a path."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compile_rule(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression of paths below the file's folder, negated, folders only) of a line of an ignore file; None for comments and blanks."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.removeprefix("!")
    folders, line = line.endswith("/"), line.rstrip("/")
    if not line:
        return None
    anchored, line = "/" in line, line.lstrip("/")
    out, at = "", 0
    while at < len(line):
        if m := re.match(r"(?:(?<=/)|^)\*\*/", line[at:]) if at == 0 or line[at - 1] == "/" else None:
            out, at = out + "(?:[^/]+/)*", at + m.end()
        elif line.startswith("/**", at) and at + 3 == len(line):
            out, at = out + "/.+", at + 3
        elif line[at] == "*":
            out, at = out + "[^/]*", at + len(re.match(r"\*+", line[at:])[0])
        elif line[at] == "?":
            out, at = out + "[^/]", at + 1
        elif m := re.match(r"\[(!?)([^\]]+)\]", line[at:]):
            out, at = out + f"[{'^' if m[1] else ''}{m[2]}]", at + m.end()
        else:
            at += line[at] == "\\" and at + 1 < len(line)
            out, at = out + re.escape(line[at]), at + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}$", negated, folders


def rules(files: DataFrame) -> DataFrame:
    """folder, depth, nth, regex, negated, folders_only of ignore files ``files(folder, content)``; the root folder is ''."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for folder, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for nth, line in enumerate((content or "").split("\n")):
                    if rule := compile_rule(line):
                        rows.append((folder, folder.count("/") + 1 if folder else 0, nth, *rule))
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["folder", "depth", "nth", "regex", "negated", "folders_only"])

    return files.where("folder is not null").select("folder", "content").mapInArrow(run, "folder string, depth int, nth int, regex string, negated boolean, folders_only boolean")


def _steps(path, least: int, less: int):
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(least), F.size(steps) - less), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))


def unignored(paths: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """Rows of ``paths(path, ...)`` that no ignore file leaves out.

    Of the rules that match a path the last one of the deepest folder decides; below a folder that is left out nothing comes back. Each folder
    is judged once, however many files it holds.  Null paths go; hidden names are as good as others.
    """
    known = rules(ignore_files)
    own = paths.select("path").where("path is not null").distinct()
    places = own.select(F.explode(_steps(F.col("path"), 1, 0)).alias("place"), "path").select("place", (F.col("place") != F.col("path")).alias("folder_is")).groupBy("place").agg(F.bool_or("folder_is").alias("is_folder"))
    above = places.select("place", "is_folder", F.explode(F.concat(F.array(F.lit("")), F.filter(_steps(F.col("place"), 1, 0), lambda x: x != F.col("place")))).alias("folder"))
    rest = F.when(F.col("folder") == "", F.col("place")).otherwise(F.expr("substring(place, length(folder) + 2)"))
    hits = above.join(known, "folder").where((F.col("is_folder") | ~F.col("folders_only")) & F.regexp_like(rest, F.col("regex")))
    out = hits.groupBy("place").agg(F.max_by("negated", F.struct("depth", "nth")).alias("back")).where("not back").select("place")
    gone = own.select("path", F.explode(_steps(F.col("path"), 1, 0)).alias("place")).join(out, "place", "left_semi").select("path").distinct()
    return paths.where("path is not null").join(gone, "path", "left_anti")
