"""Keeps a full-text index of a table of texts: each run takes the files that came since the last one.

    python jobs/text_index.py --config jobs/text_index.json --source /data/documents --target /data/index --checkpoint /data/index-mark

Input: a folder of Parquet files with an id, and columns of text (a single file will do).  A file stream whose checkpoint
knows which files were taken hands the new ones over, each batch becomes a batch of the stored index (partitioned by batch
and by bucket of the term), and a text whose id came before replaces the older one.  A run without new files changes nothing; one that
broke off is repeated by the next run under the same batch number, in the place of what it had written.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import text_store
from quarry.plans.shared import new_folder

DEFAULTS = {"source": "", "target": "", "checkpoint": "", "id": "doc_id", "columns": "lang,text", "buckets": text_store.BUCKETS, "files_per_batch": 1000}
log = logging.getLogger("text_index")


def listed(path: str) -> str:
    """``path`` as a pattern that matches it alone, so that a file stream takes a single file as well as a folder."""
    path = path.rstrip("/")
    return path[:-1] + f"[{path[-1]}]"


def run(spark: SparkSession, source: str, target: str, checkpoint: str, id: str = "doc_id", columns: str = "lang,text", buckets: int = text_store.BUCKETS, files_per_batch: int = 1000) -> dict[str, int]:  # noqa: A002
    """Take what is new below ``source`` into the index below ``target``; the numbers of this run."""
    names, sums = columns.split(","), {"batches": 0, "texts": 0, "postings": 0, "replaced": 0}

    def take(batch: DataFrame, number: int) -> None:
        wrote = text_store.add_batch(batch, names, target, number, buckets)
        log.info("batch %s: read %s texts, wrote %s postings, replaced %s texts", number, wrote["texts"], wrote["postings"], wrote["replaced"])
        for k, v in (wrote | {"batches": 1}).items():
            sums[k] += v

    schema = spark.read.parquet(source).select(F.col(id).alias("id"), *names).schema
    fields = ", ".join(f"`{id if f.name == 'id' else f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    new = spark.readStream.schema(fields).option("maxFilesPerTrigger", files_per_batch).parquet(listed(source)).select(F.col(id).alias("id"), *names)
    query = new.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %s batches, %s texts, %s postings into %s", source, sums["batches"], sums["texts"], sums["postings"], target)
    return sums


def job1_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job twice over all documents into one folder; the postings in force afterwards, places joined by commas."""
    folder = new_folder(spark, "job1")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/mark")
    return text_store.stored(spark, f"{folder}/index", 2).select("term", "id", "len", *[F.array_join(f"p{k}", ",").alias(f"p{k}") for k in range(2)])


def _words(column: str) -> str:
    from quarry.operators.search import _FROM, _TO

    return rf"list_filter(regexp_split_to_array(translate(lower({column}), '{_FROM}', '{_TO}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


SQL = f"""
WITH x AS (SELECT doc_id AS id, {_words("lang")} AS l, {_words("text")} AS t FROM documents),
y AS (SELECT id, CAST(len(l) + len(t) AS BIGINT) AS len, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS p, 0 AS k FROM x UNION ALL SELECT id, CAST(len(l) + len(t) AS BIGINT), unnest(t), generate_subscripts(t, 1) - 1, 1 FROM x)
SELECT term, id, len, coalesce(string_agg(p, ',' ORDER BY p) FILTER (k = 0), '') AS p0, coalesce(string_agg(p, ',' ORDER BY p) FILTER (k = 1), '') AS p1 FROM y GROUP BY term, id, len
"""

if __name__ == "__main__":
    from jobs.common import main

    main("text-index", run, DEFAULTS, __doc__)
