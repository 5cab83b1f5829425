"""Points and the spans that hold them, joined by equality.

A span of lines is cut into the fewest intervals whose length is a power of two and whose start is a multiple of it; a
point lies in one such interval of each length.  So "start <= line <= end" is an equi-join on (path, length, start): a span gives
some 2 log2(its length) rows, a point log2(the longest span), and every pair that meets is a pair that belongs together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces(lo: Column, hi: Column, levels: int) -> Column:
    """array<struct<level, at>> of the intervals that make up lo..hi (both in); empty where lo > hi or either is null."""

    def step(acc: Column, level: Column) -> Column:
        live = acc["lo"] <= acc["hi"]
        low, high = live & (acc["lo"] % 2 == 1), live & (acc["hi"] % 2 == 0)
        own = lambda at: F.array(F.struct(level.alias("level"), at.alias("at")))
        none = F.array().cast("array<struct<level: int, at: bigint>>")
        out = F.concat(acc["out"], F.when(low, own(acc["lo"])).otherwise(none), F.when(high, own(acc["hi"])).otherwise(none))
        up = lambda end: F.when(live, F.call_function("shiftright", end, F.lit(1))).otherwise(end)  # noqa: E731  (what has ended stays so)
        return F.struct(up(acc["lo"] + low.cast("long")).alias("lo"), up(acc["hi"] - high.cast("long")).alias("hi"), out.alias("out"))

    begin = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.array().cast("array<struct<level: int, at: bigint>>").alias("out"))
    return F.when(lo <= hi, F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), begin, step, lambda acc: acc["out"]))


def containing(points: DataFrame, spans: DataFrame, how: str = "inner") -> DataFrame:
    """``points(path, at, ...)`` joined to the ``spans(path, lo, hi, ...)`` that hold them; the longest span's length is looked up first."""
    longest = spans.where("lo <= hi").agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0] or 1
    levels = int(longest).bit_length()
    cut = spans.withColumn("_q", F.explode(pieces(F.col("lo"), F.col("hi"), levels))).select("*", F.col("_q.level").alias("_q_level"), F.col("_q.at").alias("_q_at")).drop("_q")
    own = points.withColumn("_q_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("_q_at", F.call_function("shiftright", F.col("at").cast("long"), F.col("_q_level")))
    return own.join(cut, ["path", "_q_level", "_q_at"], how).drop("_q_level", "_q_at")


def innermost(points: DataFrame, spans: DataFrame, keep: list[str]) -> DataFrame:
    """``points(path, at, ...)`` with a struct ``inner`` of the columns ``keep`` of the shortest span around each, or null.

    Of spans alike in length the one that begins first is taken, then the one of the least ``keep``.  Every line is looked up once,
    however many points lie on it; points outside all spans, or with a null path or line, have a null.
    """
    places = points.select("path", "at").distinct()
    pairs = containing(places, spans.select("path", "lo", "hi", F.struct(*keep).alias("_q_span")), "left")
    inner = pairs.groupBy("path", "at").agg(F.min_by("_q_span", F.when(F.col("lo").isNotNull(), F.struct(F.col("hi") - F.col("lo"), "lo", "_q_span"))).alias("inner"))
    return points.join(inner, ["path", "at"], "left")
