"""Cutting lineage in iterative plans, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> None:
    """Name a checkpoint folder where the session has none; only local masters may go without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = f"{tempfile.gettempdir()}/quarry-checkpoints"
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept where a lost executor does not matter."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a long column ``name`` from 1 in the order of the columns ``order``, which should name a row.

    Rows are dealt by ranges and counted by range; only one count a partition reaches the driver, and no task sees all rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = cut(dealt.withColumns({"_q_part": F.spark_partition_id(), "_q_nth": F.monotonically_increasing_id()}))
    begins, at = [], 1
    for part, count in sorted(tuple(r) for r in held.groupBy("_q_part").count().collect()):
        begins.append((part, at - (part << 33)))  # the generated ids of a partition begin there
        at += count
    if not begins:
        return df.withColumn(name, F.lit(None).cast("long"))
    first = spark.createDataFrame(begins, "_q_part int, _q_first long")  # a row a partition
    return held.join(F.broadcast(first), "_q_part").withColumn(name, F.col("_q_nth") + F.col("_q_first")).drop("_q_part", "_q_nth", "_q_first")
