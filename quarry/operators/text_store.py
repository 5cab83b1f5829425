"""A stored full-text index that grows by batches.

Folders below one root, all partitioned Parquet:

* ``postings/batch=/bucket=``: term, id, len and the places of the term in each column; a bucket is a hash of the term, so a
  search lists and reads the buckets of its own terms;
* ``lengths/batch=``: id, len of every text;
* ``gone/batch=``: id, was, len: texts of the batch ``was`` that this batch replaces;
* ``totals/batch=``: docs, tokens, buckets; written last, so a batch without it is not read.

Writing a batch again replaces it, so a run that broke off is repeated without harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import search

BUCKETS = 16
#: Tokens that a task sorts, and ids that are sent to all executors rather than joined by shuffles, at most.
TOKENS, FEW = 1_000_000, 100_000
_LENGTHS, _GONE, _TOTALS = "id bigint, len bigint, batch bigint", "id bigint, was bigint, len bigint, batch bigint", "docs bigint, tokens bigint, buckets int, batch bigint"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _put(df: DataFrame, path: str, batch: int, by: str | None = None) -> int:
    """Write ``df`` as a batch's whole part of a table, in place of one that broke off; the number of rows."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/batch={batch}")
    return seen.get["n"]


def _finished(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Rows of a table's finished batches."""
    return spark.read.schema(schema).parquet(f"{root}/{name}").join(F.broadcast(spark.read.schema(_TOTALS).parquet(f"{root}/totals").select("batch")), "batch", "left_semi")


def _postings_schema(columns: int) -> str:
    return "term string, id bigint, len bigint, " + "".join(f"p{k} array<int>, " for k in range(columns)) + "batch bigint, bucket int"


def _one_an_id(own: DataFrame, names: list[str]) -> DataFrame:
    """Of rows that share an id the one of the greatest hash; only texts of such ids are shuffled, unless these are very many."""
    twice = cut(own.groupBy("id").count().where("count > 1").select("id"))
    n = twice.count()
    if n == 0:
        return own
    twice = F.broadcast(twice) if n <= FEW else twice
    best = own.join(twice, "id", "left_semi").groupBy("id").agg(F.max_by(F.struct(*names), F.xxhash64(*names)).alias("v")).select("id", "v.*")
    return own.join(twice, "id", "left_anti").unionByName(best)


def _dealt(index: DataFrame, bucket: str, buckets: int, tokens: int) -> DataFrame:
    """Rows with a bucket, dealt so that a task has one bucket and some ``TOKENS`` tokens: a frequent term's bucket is cut by id."""
    slices = max(1, math.ceil(tokens / buckets / TOKENS))
    return index.repartitionById(buckets * slices, (F.col(bucket) * slices + F.pmod(F.xxhash64("id"), F.lit(slices))).cast("int"))


def _without(df: DataFrame, dead: DataFrame) -> DataFrame:
    """``df`` without the replaced texts ``dead(id, batch)``; its rows stay where they are unless these are very many."""
    n = dead.count()
    if n == 0:
        return df
    return df.join(F.broadcast(dead) if n <= FEW else dead, ["id", "batch"], "left_anti")


def add_batch(docs: DataFrame, columns: list[str], root: str, batch: int, buckets: int = BUCKETS) -> dict[str, int]:
    """Index ``docs(id, ...)`` as a batch; its numbers.  A text whose id an earlier batch has replaces that one.

    Null columns are empty; a text without tokens has a length and no postings; of rows of one batch that share an id the one of the greatest
    hash counts; rows without an id can't be found again and are left out.  A batch's number must be above all earlier ones, or the last one again.
    """
    spark = docs.sparkSession
    own = docs.where("id is not null").select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("string").alias(f"_c{k}") for k, c in enumerate(columns)])
    names = [f"_c{k}" for k in range(len(columns))]
    own = _one_an_id(own, names)
    sizes = [F.size(search.tokens(F.coalesce(F.col(n), F.lit("")))) for n in names]
    texts = _put(own.select("id", sum(sizes[1:], sizes[0]).cast("long").alias("len")), f"{root}/lengths", batch)
    tokens = spark.read.schema(_LENGTHS).parquet(f"{root}/lengths").where(F.col("batch") == batch).agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    index = _dealt(search.postings(own, names, lambda term: bucket_of(term, buckets)), "grp", buckets, tokens)
    index = search.unpacked(index, len(names)).withColumnRenamed("grp", "bucket").sortWithinPartitions("bucket", "term", "id")

    wrote = {"postings": _put(index, f"{root}/postings", batch, "bucket"), "texts": texts}
    before = spark.read.schema(_LENGTHS).parquet(f"{root}/lengths")
    now = before.where(F.col("batch") == batch)
    old = before.where(F.col("batch") < batch).withColumnRenamed("batch", "was").join(now.select("id"), "id", "left_semi")
    if batch > 0:
        dead = spark.read.schema(_GONE).parquet(f"{root}/gone").where(F.col("batch") < batch).select("id", "was")
        old = old.join(dead, ["id", "was"], "left_anti")
    wrote["replaced"] = _put(old.select("id", "was", "len"), f"{root}/gone", batch)
    totals = now.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).select("docs", "tokens", F.lit(buckets).alias("buckets"))
    _put(totals, f"{root}/totals", batch)
    return wrote


def stored(spark: SparkSession, root: str, columns: int, words: list[str] | None = None) -> DataFrame:
    """Postings in force, with their batch; given ``words``, of these terms only, from their buckets."""
    totals = spark.read.schema(_TOTALS).parquet(f"{root}/totals")
    index = spark.read.schema(_postings_schema(columns)).parquet(f"{root}/postings")
    if words is not None:
        buckets = totals.agg(F.max("buckets")).first()[0]
        index = index.where(F.col("bucket").isin(*[bucket_of(F.lit(w), buckets) for w in words]) & F.col("term").isin(*words))
    dead = _finished(spark, root, "gone", _GONE).select("id", F.col("was").alias("batch"))
    return _without(index.join(F.broadcast(totals.select("batch")), "batch", "left_semi"), dead).drop("bucket")  # totals have a row a batch


def stored_totals(spark: SparkSession, root: str) -> DataFrame:
    """One row, docs and tokens of the texts in force."""
    less = _finished(spark, root, "gone", _GONE).agg(F.count(F.lit(1)).alias("less_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("less_tokens"))
    held = spark.read.schema(_TOTALS).parquet(f"{root}/totals").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return held.crossJoin(less).select((F.col("docs") - F.col("less_docs")).alias("docs"), (F.col("tokens") - F.col("less_tokens")).alias("tokens"))  # one row each


def search_stored(spark: SparkSession, root: str, query: str, columns: int, limit: int = 10) -> DataFrame:
    """id, score as :func:`search.bm25` gives them over the texts in force; only the buckets of the query's terms are read."""
    words = sorted({t for w in search.sanitize(query) for t in search.terms(w)})
    return search.search_index(stored(spark, root, columns, words), stored_totals(spark, root), query, limit)


def merge(spark: SparkSession, root: str, into: str, columns: int) -> int:
    """Write the texts in force as the one batch of a new index ``into``, without what is gone; the number of postings.

    ``into`` must be another folder: readers of ``root`` go on reading it until they are pointed at the new one.
    """
    totals = spark.read.schema(_TOTALS).parquet(f"{root}/totals")
    buckets, last = totals.agg(F.max("buckets"), F.max("batch")).first()
    index = stored(spark, root, columns).drop("batch").withColumn("bucket", bucket_of(F.col("term"), buckets))
    index = _dealt(index, "bucket", buckets, stored_totals(spark, root).first()["tokens"]).sortWithinPartitions("bucket", "term", "id")
    n = _put(index, f"{into}/postings", last, "bucket")
    dead = _finished(spark, root, "gone", _GONE).select("id", F.col("was").alias("batch"))
    lengths = _without(_finished(spark, root, "lengths", _LENGTHS), dead)
    _put(lengths.select("id", "len"), f"{into}/lengths", last)
    _put(spark.createDataFrame([], "id bigint, was bigint, len bigint"), f"{into}/gone", last)
    _put(stored_totals(spark, root).select("docs", "tokens", F.lit(buckets).alias("buckets")), f"{into}/totals", last)
    return n
