"""Event persistence in micro-batches, model streams folded, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config
from ..plans.lineage import numbered

BATCH, SECONDS = 50, 2
#: Answers that are notices of the service and not text: fixed values.
GARBAGE = ("Credit balance", "credit balance", "rate limit", "Rate limit", "rate_limit", "too many requests", "Too many requests", "billing", "quota exceeded", "insufficient_quota", "overloaded", "capacity", "try again later", "exceeded your", "usage limit", "account balance")


def persist(events: DataFrame, path: str, checkpoint: str, seconds: int = SECONDS, available_now: bool = False):
    """Start writing a stream of events to ``path`` every ``seconds``; exactly once through the checkpoint."""
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def bus(spark, path: str, schema, files: int = 1) -> DataFrame:
    """Events dropped as files into a folder, read as a stream of at most ``files`` files a batch; every reader has a place of its own."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def bridge(events: DataFrame, path: str, checkpoint: str, config: Config, available_now: bool = False):
    """Writes the bus to ``path`` if the configuration asks for it; else nothing starts."""
    return persist(events, path, checkpoint, config.batch_flush_secs, available_now) if config.persist_events else None


def progress(events: DataFrame, total: int) -> DataFrame:
    """files_done, total, percent of a run from its ``file_parsed`` events."""
    return events.where("type = 'file_parsed'").agg(F.count(F.lit(1)).alias("files_done")).select("files_done", F.lit(total).cast("long").alias("total"), F.floor(100 * F.try_divide(F.col("files_done"), F.lit(total)) + 0.5).cast("long").alias("percent"))


def batches(events: DataFrame, size: int = BATCH) -> DataFrame:
    """batch_id, n, first_id, last_id, and how many of each batch by count; ids in order of (ts, event_id), dealt by ranges."""
    own = numbered(events.select("event_id", "ts"), ["ts", "event_id"], "nth").select("event_id", F.floor((F.col("nth") - 1) / size).cast("long").alias("batch_id"))
    return own.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n over tumbling windows; on a stream a watermark of ``late`` bounds the state."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


_LINE = "type string, message struct<content: array<struct<type: string, text: string>>>, result string, usage struct<output_tokens: bigint>, delta struct<type: string, text: string>, name string"


def read_line(line) -> F.Column:
    """struct<delta, complete, tokens, tool> of one JSON line of a model's stream; other lines give nulls."""
    v = F.from_json(line, _LINE)
    said = F.array_join(F.transform(F.filter(v["message"]["content"], lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
    delta = F.when((v["type"] == "assistant") & (said != ""), said).when((v["type"] == "content_block_delta") & (v["delta"]["type"] == "text_delta"), v["delta"]["text"])
    return F.struct(delta.alias("delta"), F.when(v["type"] == "result", F.coalesce(v["result"], F.lit(""))).alias("complete"), F.when(v["type"] == "result", F.coalesce(v["usage"]["output_tokens"], F.lit(0))).alias("tokens"), F.when(v["type"] == "tool_use", v["name"]).alias("tool"))


def fold(stream: DataFrame) -> DataFrame:
    """``stream(stream_id, seq, line)`` -> stream_id, text, tokens, garbage: deltas joined in order unless a final text came;
    tokens of the final line, else bytes / 4."""
    own = stream.select("stream_id", "seq", read_line(F.col("line")).alias("e"))
    sums = own.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("e.delta").isNotNull(), F.struct("seq", F.col("e.delta").alias("t"))))), lambda s: s["t"]), "").alias("joined"), F.max_by(F.col("e.complete"), F.when(F.col("e.complete") != "", F.col("seq"))).alias("final"), F.max_by(F.col("e.tokens"), F.when(F.col("e.complete").isNotNull(), F.col("seq"))).alias("told"))
    text = F.when(F.coalesce("final", F.lit("")) != "", F.col("final")).otherwise(F.col("joined"))
    return sums.select("stream_id", text.alias("text"), F.coalesce(F.when(F.col("told") > 0, F.col("told")), F.floor(F.octet_length(text) / 4)).cast("long").alias("tokens"), is_garbage(text).alias("garbage"))


def is_garbage(text) -> F.Column:
    return text.rlike("|".join(GARBAGE))
