"""Importance resampling of documents towards a target distribution.

Features are runs of words, hashed into a fixed number of buckets.  Two passes over Arrow batches:

1. Every partition counts its features into one vector (``np.bincount``); ``treeReduce`` adds the vectors, so the driver
   receives few of them however many partitions there are.  The same is done for the target texts.
2. A bucket's gain is the logarithm of its smoothed share in the target over that in the documents.  Gains (one number a
   bucket) are broadcast; a document's weight is the sum of its features' gains, by ``np.bincount`` with weights.

A Gumbel number that only depends on seed and doc_id is added to each weight, and the documents of the highest sums are drawn:
a sample without replacement in proportion to the weights' exponentials.  Sums are ordered by ranges, never in one task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stretches import stretches
from .tokens import slices
from .workspace import Workspace, partitions

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of words, A-Z lower-cased; everything else is a space.  All bytes of other than ASCII characters belong to words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Features are handed on in chunks of some so many.
_CHUNK = 1 << 20


class Buckets(dict):
    """feature -> its bucket, remembered for the short ones within a bound."""

    def __init__(self, buckets: int, most: int = 300_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        k = zlib.crc32(feature) % self.buckets
        if len(feature) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[feature] = k
        return k


def features(texts: list, bucket: Buckets, longest: int, n_words: np.ndarray):
    """Chunks (numbers of texts, buckets) of all features of ``texts`` (bytes or None); adds each text's words to ``n_words``."""
    numbers, lengths, own, held = [], [], [], 0
    for k, text in enumerate(texts):
        before: list[bytes] = []  # last words of the stretch before, for runs that begin there
        for part in stretches((text or b"").translate(_WORD_BYTES), (b" ",)):
            words = part.split()
            n_words[k] += len(words)
            runs = list(map(bucket.__getitem__, words))
            for n in range(2, longest + 1):
                line = before[max(0, len(before) - n + 1) :] + words
                runs += [bucket[b" ".join(line[i : i + n])] for i in range(len(line) - n + 1)]
            before = (before + words)[max(0, len(before) + len(words) - longest + 1) :] if longest > 1 else before
            numbers.append(k)
            lengths.append(len(runs))
            own.append(np.array(runs, np.int64))
            held += len(runs)
            if held >= _CHUNK:
                yield np.repeat(numbers, lengths), np.concatenate(own)
                numbers, lengths, own, held = [], [], [], 0
    if own:
        yield np.repeat(numbers, lengths), np.concatenate(own)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features in each bucket over the column ``text`` of all rows."""

    def count(batches):
        import pyarrow as pa

        total, bucket = np.zeros(buckets, np.int64), Buckets(buckets)
        for batch in slices(batches):
            for _, own in features(batch.column(0).to_pylist(), bucket, longest, np.zeros(batch.num_rows, np.int64)):
                total += np.bincount(own, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(np.add, depth=max(2, math.ceil(math.log(parts, 32))))  # so some 32 vectors meet in one place


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed share in the target / smoothed share in the documents)) of each bucket."""
    size, all_own, all_target = len(own), float(own.sum() + len(own)), float(target.sum() + len(own))
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * all_own / ((float(own[b]) + 1) * all_target))) for b in range(size)], np.float64)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``; ``rank`` is null for what is not drawn.

    A null, empty or wordless text has no features and weight 0; a text of fewer than ``min_words`` words is scored but
    never drawn.  A very long text is read whole, a stretch at a time.  Ties in score go to the smaller doc_id (a null one last;
    its seed text is that of an empty id), then to fewer features; repeated rows are drawn each, in the order they are read.
    An empty table gives no rows, an empty target flat gains; other columns are ignored.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "resampling")
    gains = spark.sparkContext.broadcast(bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest)))  # a number a bucket

    def weigh(batches):
        import pyarrow as pa

        own, bucket = gains.value, Buckets(buckets)
        for batch in slices(batches):
            rows = batch.num_rows
            n_words, n, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
            for at, found in features(batch.column(1).to_pylist(), bucket, longest, n_words):
                n += np.bincount(at, minlength=rows)
                weight += np.bincount(at, own[found], rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n), pa.array(weight.astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    weighed = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = space.table(weighed.withColumns({"score": F.col("weight") + luck, "nth": F.monotonically_increasing_id()}), "scored")  # so texts are read once more only

    able = F.when(F.col("n_words") >= min_words, 0).otherwise(1)
    order = [F.col("late"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("nth")]
    dealt = scored.withColumn("late", able).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = space.table(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "dealt")
    space.drop("scored")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("late") == 0).alias("able")).collect()  # a row a partition
    most = sum(r["able"] for r in counts) * percent // 100
    firsts, at = [], 1
    for part, n in sorted((r["part"], r["n"]) for r in counts):
        firsts.append((part, at - (part << 33)))  # generated ids of a partition begin there
        at += n
    first = F.broadcast(spark.createDataFrame(firsts, "part int, first long"))  # a row a partition
    place = F.col("at") + F.col("first")
    return dealt.join(first, "part").select("doc_id", "n_words", "n_features", "weight", "score", F.when((F.col("late") == 0) & (place <= most), place).alias("rank"))


#: The same for single words, with crc32 by its table; text for ``BUCKETS``, ``MIN_WORDS``, ``PERCENT`` and ``SEED`` as they stand.
SQL = rf"""
WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY ALL),
names AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bytes AS (SELECT w, list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bs FROM names),
hashed AS (SELECT w, xor(list_reduce(list_concat([4294967295], bs), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS k FROM bytes, tab),
s AS (SELECT k, sum(n) AS s FROM dw JOIN hashed USING (w) GROUP BY k), t AS (SELECT k, sum(n) AS t FROM bw JOIN hashed USING (w) GROUP BY k),
z AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS sa, coalesce((SELECT sum(t) FROM t), 0) AS ta),
g AS (SELECT k, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(sa + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(ta + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (k), z),
w AS (SELECT rid, CAST(sum(n * g) AS BIGINT) AS weight FROM dw JOIN hashed USING (w) JOIN g USING (k) GROUP BY rid),
a AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || left(sha256('{SEED}:' || doc_id), 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (rid)),
c AS (SELECT rid, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM a),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, n_features, rid) AS rank FROM c WHERE n_features >= {MIN_WORDS} QUALIFY rank <= (SELECT {PERCENT} * count(*) // 100 FROM c WHERE n_features >= {MIN_WORDS}))
SELECT doc_id, n_features, weight, score, CAST(rank AS BIGINT) AS rank FROM c LEFT JOIN r USING (rid)
"""
