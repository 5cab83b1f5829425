"""Vector bin packing of documents into shards.

Groups (equal texts) are vectors of bytes, tokens and rows.  Each group, largest first, goes to the shard
where its dot product with the shard's residual capacity is highest.  The law that
holds is ``bytes``: shards' sizes come out near equal; tokens and rows are balanced with them at lower weights.

Three levels keep every task and the driver bounded:

* giants, groups above 1/1024 of all bytes, tokens or rows (so 3,072 at most), are packed on the
  driver; one that nearly fills a shard is cut into pieces;
* the others are dealt by hash into buckets of about ``PER_BUCKET`` groups, each packed in its own task
  against its share of the capacity that the giants leave;
* a reserve of small groups is packed last, against what all of that left over, and evens it out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, partitions

PER_BUCKET, GIANT, RESERVE, STRETCH = 4096, 1024, 8, 4096
#: Weights of bytes, tokens and rows in the dot product, each measured in shards' capacities.
WEIGHTS = np.array([1.0, 0.1, 0.02])
_PLACED = "h1 long, h2 long, first long, n long, shard int, bucket long, start long"


def place(sizes: np.ndarray, residual: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Shard of each vector, in the given order; ``residual`` (a row a shard) is drawn down."""
    scale = WEIGHTS / np.maximum(capacity, 1e-9) ** 2
    out = np.zeros(len(sizes), np.int32)
    for k, v in enumerate(sizes):
        out[k] = s = int(((residual * scale) @ v).argmax())
        residual[s] -= v
    return out


def _starts(shard: np.ndarray, rows: np.ndarray, shards: int) -> np.ndarray:
    """Rows placed in the same shard before each."""
    out = np.zeros(len(shard), np.int64)
    for s in range(shards):
        own = np.flatnonzero(shard == s)
        out[own] = np.cumsum(rows[own]) - rows[own]
    return out


def _pack_buckets(groups: DataFrame, bucket, share: np.ndarray, shards: int) -> DataFrame:
    """Pack each bucket against ``share``: of each shard its part of the whole capacity, by dimension."""

    def fill(table):
        import pyarrow as pa

        table = table.sort_by([("bytes", "descending"), ("h1", "ascending"), ("h2", "ascending")])
        sizes = np.stack([table.column(c).to_numpy() for c in ("bytes", "tokens", "rows")], 1).astype(float)
        residual = share * sizes.sum(0)
        shard = place(sizes, residual, sizes.sum(0) / shards)
        rows = table.column("rows").to_numpy()
        names = ["h1", "h2", "first", "n", "shard", "bucket", "start"]
        cols = [table.column("h1"), table.column("h2"), pa.array(np.zeros(len(rows), np.int64)), pa.array(rows), pa.array(shard), table.column("bucket"), pa.array(_starts(shard, rows, shards))]
        return pa.table(dict(zip(names, cols)))

    return groups.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(fill, _PLACED)


def _giants(rows: list, total: np.ndarray, shards: int) -> tuple[list[tuple], np.ndarray]:
    """Pieces of the giants, and the residual capacity after them."""
    capacity = total / shards
    pieces = []
    for r in rows:
        one = np.array([r["bytes"], r["tokens"], r["rows"]], float)
        parts = 1
        if (one > 0.9 * capacity).any() and r["rows"] > 1:
            parts = int(min(r["rows"], np.ceil((one / np.maximum(capacity, 1e-9)).max() * 8)))
        cuts = np.linspace(0, r["rows"], parts + 1).astype(np.int64)
        pieces += [(one * (b - a) / r["rows"], r["h1"], r["h2"], int(a), int(b - a)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    pieces.sort(key=lambda p: (-p[0][0], p[1], p[2], p[3]))
    residual = np.tile(capacity, (shards, 1))
    shard = place(np.array([p[0] for p in pieces]).reshape(-1, 3), residual, capacity)
    start = _starts(shard, np.array([p[4] for p in pieces], np.int64), shards)
    return [(h1, h2, a, n, int(s), -1, int(at)) for (_, h1, h2, a, n), s, at in zip(pieces, shard, start)], residual


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs(doc_id, text)``.

    size: UTF-8 bytes of the text (null: none) plus 1.  Equal texts share a shard unless together
    they nearly fill one; null is a text of its own.  ``tokens`` are runs without white space, a stand-in that needs no
    tokenizer: a long run, or a script without spaces, counts as one.  A very long text is a giant and placed whole; of groups
    alike in size the least hash goes first, of shards alike the least number.  ``slot`` numbers a shard's rows from 0 without gaps.
    Repeated rows take a slot each.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "sharding")
    salts = max(64, 2 * partitions(spark))
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit("second"), "text").alias("h2"),
    )
    base = space.table(base.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(salts)).cast("int")), "base")
    # a group's rows in cells, so that no group of copies is numbered by one task
    cells = base.groupBy("h1", "h2", "salt").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"))
    cells = space.table(cells, "cells")
    groups = space.table(cells.groupBy("h1", "h2").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")), "groups")
    sums = groups.agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows"), F.count(F.lit(1))).first()
    if not sums[2]:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    total = np.array([float(x) for x in sums[:3]])
    giant = (F.col("bytes") * GIANT > int(total[0])) | (F.col("tokens") * GIANT > int(total[1])) | (F.col("rows") * GIANT > int(total[2]))
    pieces, residual = _giants(groups.where(giant).collect(), total, shards)  # at most 3 * GIANT groups
    placed = space.table(spark.createDataFrame(pieces, _PLACED), "giants")

    rest = groups.where(~giant)
    kept_back = (F.pmod(F.xxhash64("h2"), F.lit(RESERVE)) == 0) & (F.col("bytes") <= int(total[0] / sums[3]))
    for turn, part in enumerate((rest.where(~kept_back), rest.where(kept_back))):
        count = part.count()
        if not count:
            continue
        buckets = -(-count // PER_BUCKET)
        bucket = F.pmod("h1", F.lit(buckets)) + F.lit(turn * (1 << 40))
        room = np.maximum(residual, 0)
        share = room / np.maximum(room.sum(0), 1e-9)
        own = space.table(_pack_buckets(part, bucket, share, shards), f"placed-{turn}")
        placed = placed.union(own)
        if turn == 0:
            loads = own.join(part, ["h1", "h2"]).groupBy("shard").agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows")).collect()  # a row a shard
            for r in loads:
                residual[r[0]] -= np.array([float(x) for x in r[1:]])
    # rows of a shard in the buckets before each: first between stretches of buckets, then within a stretch, so a task sums some thousands
    own = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("own")).withColumn("stretch", F.floor(F.col("bucket") / STRETCH))
    past = own.groupBy("shard", "stretch").agg(F.sum("own").alias("all"))
    past = past.select("shard", "stretch", (F.sum("all").over(Window.partitionBy("shard").orderBy("stretch")) - F.col("all")).alias("past"))
    inner = F.sum("own").over(Window.partitionBy("shard", "stretch").orderBy("bucket")) - F.col("own")
    before = own.withColumn("inner", inner).join(past, ["shard", "stretch"]).select("shard", "bucket", (F.col("past") + F.col("inner")).alias("before"))
    placed = placed.join(before, ["shard", "bucket"]).select("h1", "h2", "first", "n", "shard", (F.col("before") + F.col("start")).alias("slot0"))
    ahead = F.sum("rows").over(Window.partitionBy("h1", "h2").orderBy("salt")) - F.col("rows")  # of at most ``salts`` cells
    spans = cells.withColumn("ahead", ahead).join(placed, ["h1", "h2"]).where("first < ahead + rows and ahead < first + n")
    spans = spans.select("h1", "h2", "salt", "ahead", "first", "n", "shard", "slot0")
    nth = F.row_number().over(Window.partitionBy("h1", "h2", "salt").orderBy("doc_id")) - 1
    rows = base.withColumn("nth", nth).join(spans, ["h1", "h2", "salt"]).withColumn("at", F.col("ahead") + F.col("nth")).where("at >= first and at < first + n")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot0") + F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
