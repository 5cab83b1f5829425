"""Batches by count or time, kept in the state of a stream.

Each shard of a stream has one open batch.  It closes when it is full, when an event comes that is too late for it, or when a
timer finds that its time is up without another event; its rows are then handed on together, under a number that counts the shard's batches.
State and timers live in the stream's checkpoint, so a restart goes on in the middle of a batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .events import BATCH, SECONDS

STORE = "spark.sql.streaming.stateStore.providerClass"
CHECK = "spark.sql.streaming.unsupportedOperationCheck"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Batches(StatefulProcessor):
    """One open batch a shard; ``clock`` is 'event' (the rows' own times) or 'processing' (when they arrive)."""

    def __init__(self, columns: list[str], held: str, size: int, millis: int, clock: str):
        self.columns, self.held, self.size, self.millis, self.clock = columns, held, size, millis, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held)
        self.place = handle.getValueState("place", "batch bigint, n int, began bigint")

    def _frame(self, shard, closed: list):
        """Rows of closed batches, given as (batch, place, row)."""
        import pandas as pd

        return pd.DataFrame({"shard": [shard] * len(closed), "batch": [b for b, _, _ in closed], "place": [p for _, p, _ in closed], "row": pd.Series([dict(zip(self.columns, r)) for *_, r in closed], dtype=object)})

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator:  # noqa: N802
        (shard,) = key
        batch, n, began = self.place.get() or (0, 0, 0)
        held, before = [tuple(r) for r in self.rows.get()] if n else [], began if n else None
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock == "processing" else None
        last = None
        for frame in rows:  # one shard's rows of one micro-batch, as Spark has sorted them: no more than an Arrow batch and the open batch is held
            closed = []
            for ms, order, row in zip(frame["q_ms"].tolist(), frame["q_id"].tolist(), frame["q_row"]):
                if last is not None and (ms, order) < last:
                    raise RuntimeError("the rows of a shard came out of order")
                last = ms, order
                at = ms if now is None else now
                if held and at >= began + self.millis:
                    closed += [(batch, p, r) for p, r in enumerate(held)]
                    batch, held = batch + 1, []
                if not held:
                    began = at
                held.append(tuple(row[c] for c in self.columns))
                if len(held) == self.size:
                    closed += [(batch, p, r) for p, r in enumerate(held)]
                    batch, held = batch + 1, []
            if closed:
                yield self._frame(shard, closed)
        self._keep(batch, held, began, before)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator:  # noqa: N802
        batch, n, began = self.place.get() or (0, 0, 0)
        if n and expiredTimerInfo.getExpiryTimeInMs() >= began + self.millis:
            yield self._frame(key[0], [(batch, p, tuple(r)) for p, r in enumerate(self.rows.get())])
            self._keep(batch + 1, [], began, None)

    def _keep(self, batch: int, held: list, began: int, before: int | None) -> None:
        if before is not None and (not held or before != began):
            self.handle.deleteTimer(before + self.millis)
        if held:
            self.rows.put(held)
            if before != began:
                self.handle.registerTimer(began + self.millis)
        else:
            self.rows.clear()
        self.place.update((batch, len(held), began))

    def close(self) -> None:
        pass


def batched(events: DataFrame, shard: Column, size: int = BATCH, seconds: float = SECONDS, clock: str = "event", late: str = "0 seconds", order: str = "event_id", at: str = "ts") -> DataFrame:
    """A stream of ``events`` as (shard, batch, place, and its columns): batches of at most ``size`` rows and ``seconds`` from their first row.

    ``shard`` is a long that spreads the rows; within one, rows of a micro-batch are taken by (``at``, ``order``), and a row that comes after later
    ones joins the open batch.  By the event clock a batch without a successor closes once the watermark (the latest time less
    ``late``) has passed it; rows later than that are dropped by Spark's own rule, so ``late`` must cover what may come.  Rows with a null time are left out.
    """
    columns = events.columns
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    time = F.col(at).cast("timestamp")
    # names that begin with "_" do not reach the frames
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("q_row")  # in a struct, whole numbers beside nulls stay what they are
    rows = events.where(F.col(at).isNotNull()).select(shard.cast("long").alias("q_shard"), time.alias("q_at"), F.unix_millis(time).alias("q_ms"), F.col(order).alias("q_id"), whole)
    rows = rows.withWatermark("q_at", late) if clock == "event" else rows
    # the order within a micro-batch: the state's own sort by shard finds it done, so rows reach Python in order and none are held there
    rows = rows.repartition("q_shard").sortWithinPartitions("q_shard", "q_ms", "q_id")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # a worker beside the driver reads the class too, without the files sent to executors
    step = Batches(columns, held, size, int(seconds * 1000), clock)
    mode = "EventTime" if clock == "event" else "ProcessingTime"
    # the form over frames, as Spark's form over rows holds all that a shard gives back in a micro-batch
    return rows.groupBy("q_shard").transformWithStateInPandas(step, f"shard bigint, batch bigint, place int, row struct<{held}>", "Append", mode).select("shard", "batch", "place", "row.*")


def write(batches: DataFrame, path: str, checkpoint: str, available_now: bool = False, seconds: float = SECONDS):
    """Start writing ``batches`` to ``path`` by shard, exactly once through the checkpoint; the session's settings are put back.

    Spark refuses a sort in a stream, as it is none over the whole stream; here it means the rows of a micro-batch, so that check is off while the query starts.

    ``available_now`` is for the event clock: by the processing clock Spark plans batch after batch for timers that may come, so such a stream runs until it is stopped.
    """
    spark = batches.sparkSession
    own = {STORE: ROCKS, CHECK: "false"}  # the first is what timers and lists need; the query copies its settings when it starts
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        writer = batches.writeStream.format("parquet").partitionBy("shard").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
