"""Keeps the analysis of a code corpus up to date: each run parses the files that changed since the last one.

    python jobs/analyse_code.py --config jobs/analyse_code.json --reader tree --source /data/checkout --target /data/analysis

Input, by ``reader``: ``tree``, a folder of source files; ``files``, a Parquet table of path, language, mtime, content; ``tables``, the
star-schema tables that stand for a corpus.  What earlier runs have seen is known from the relations below ``target``, with the
time of each file as its mark; then ``target/edges``, by kind, and ``target/symbols``, by language, are written anew from the
relations in force.  A run without changes leaves them alone; what a run that broke off had not finished, the next one does again.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import incremental
from quarry.plans.shared import new_folder
from quarry.sources import adapter, code

DEFAULTS = {"source": "", "target": "", "reader": "tree", "most_bytes": 20 << 20}
log = logging.getLogger("analyse_code")


def read(spark: SparkSession, source: str, reader: str, most_bytes: int) -> DataFrame:
    """path, language, mtime, content of the corpus as it stands."""
    if reader == "tree":
        return code.walk(spark, source, most_bytes).select("path", "language", "mtime", "content")
    if reader == "files":
        return spark.read.parquet(source).select("path", "language", "mtime", "content").where(F.octet_length("content") <= most_bytes)
    if reader == "tables":
        return adapter.code_files(adapter.symbols(spark, source), adapter.edges(spark, source))
    raise ValueError(f"no reader is called {reader}")


def run(spark: SparkSession, source: str, target: str, reader: str = "tree", most_bytes: int = 20 << 20) -> dict[str, int]:
    """Bring the analysis below ``target`` up to date with ``source``; the numbers of this run."""
    state = f"{target}/state"
    counts = incremental.update(read(spark, source, reader, most_bytes), state)
    log.info("%s: %s files came, changed or went, %s parsed, edges of %s resolved anew", source, counts["touched"], counts["parsed"], counts["linked"])
    last, shown = incremental.last_run(spark, state), incremental.last_run(spark, state, "shown")
    if last is not None and (shown is None or shown < last):
        edges = incremental.edges(spark, state).select("path", *[F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("source", "target") for c in ("path", "start_line", "name")], "kind", "confidence")
        symbols = code.flat(incremental.parsed(spark, state), "symbols")
        for name, table, by in (("edges", edges, "kind"), ("symbols", symbols, "language")):
            table.write.mode("overwrite").partitionBy(by).parquet(f"{target}/{name}")
            log.info("wrote %s, by %s, as of run %s", f"{target}/{name}", by, last)
        incremental.mark(spark, state, "shown", last)
    return counts


def job2_analyse_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job twice over the tables as a corpus of code, into one folder; the edges as they stand afterwards."""
    folder = new_folder(spark, "job2")
    for _ in range(2):
        run(spark, sf_dir, folder, "tables")
    return spark.read.parquet(f"{folder}/edges")


SQL = f"""
WITH RECURSIVE {adapter.CTE}{adapter.PARSED_CTE},
by_file AS (SELECT name, path, max(nth) AS in_file FROM placed GROUP BY ALL), by_name AS (SELECT name, min(nth) AS first, count(*) AS n FROM placed GROUP BY name), heads AS (SELECT path, min(nth) AS head FROM placed GROUP BY path),
e AS (
  SELECT a.path, coalesce(f1.in_file, n1.first) AS s, coalesce(f2.in_file, n2.first) AS t, 'CALLS' AS kind, CASE WHEN f2.in_file IS NOT NULL THEN 1.0 WHEN n2.n = 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence
  FROM (SELECT source_id, target_id FROM edges WHERE kind = 'CALLS') JOIN symbols a ON a.symbol_id = source_id JOIN symbols b ON b.symbol_id = target_id
  LEFT JOIN by_file f1 ON f1.name = a.name AND f1.path = a.path LEFT JOIN by_name n1 ON n1.name = a.name LEFT JOIN by_file f2 ON f2.name = b.name AND f2.path = a.path LEFT JOIN by_name n2 ON n2.name = b.name
  UNION ALL SELECT i.path, x.head, y.head, 'IMPORTS', 0.6::DOUBLE FROM own_imports i JOIN heads x ON x.path = i.path JOIN heads y ON y.path = i.target)
SELECT e.path, x.path AS source_path, x.start_line AS source_start_line, x.name AS source_name, y.path AS target_path, y.start_line AS target_start_line, y.name AS target_name, e.kind, e.confidence FROM e JOIN placed x ON x.nth = s JOIN placed y ON y.nth = t
"""

if __name__ == "__main__":
    from jobs.common import main

    main("analyse-code", run, DEFAULTS, __doc__)
