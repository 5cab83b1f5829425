"""Best-two-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import END_ID, encoder, slices
from .workspace import Workspace

PIECE = "doc_id long, piece long, start long, length long, ids_crc32 long, tie long"


def pack(lengths: list[int], room: int) -> list[list[int]]:
    """Bins of item numbers.  Each bin is filled greedily, longest item that fits first; then, if two
    unpacked items fit the gap that its smallest item would leave more tightly, they replace it."""
    stock: dict[int, list[int]] = defaultdict(list)
    for k in range(len(lengths) - 1, -1, -1):
        stock[lengths[k]].append(k)
    have = 0  # bit n: an unpacked item of length n
    for n in stock:
        have |= 1 << n

    def take(n: int) -> int:
        nonlocal have
        k = stock[n].pop()
        if not stock[n]:
            have &= ~(1 << n)
        return k

    def give(n: int, k: int) -> None:
        nonlocal have
        stock[n].append(k)
        have |= 1 << n

    def two(gap: int, more_than: int) -> tuple[int, int] | None:
        """Lengths a >= b of two unpacked items with the largest sum in (more_than, gap]."""
        low = have & ((1 << (gap + 1)) - 1)
        if not low:
            return None
        mirror = int(format(low, f"0{gap + 1}b")[::-1], 2)  # bit i: an item of length gap - i
        for total in range(gap, more_than, -1):
            both = low & (mirror >> (gap - total)) if total != gap else low & mirror
            while both:
                a = both.bit_length() - 1
                b = total - a
                if a != b or len(stock[a]) > 1:
                    return (a, b) if a >= b else (b, a)
                both &= ~(1 << a)
        return None

    bins = []
    while have:
        gap, own = room, []
        while fit := have & ((1 << (gap + 1)) - 1):
            n = fit.bit_length() - 1
            own.append((n, take(n)))
            gap -= n
        if gap and len(own) > 1 and have:
            n, k = own[-1]  # the last taken is the smallest
            if pair := two(gap + n, n):
                own[-1:] = [(m, take(m)) for m in pair]
                give(n, k)
        bins.append([k for _, k in own])
    return bins


def pieces(docs: DataFrame, tokenizer: str, room: int) -> DataFrame:
    """A row for each piece of at most ``room`` ids of each document."""

    def cut(batches):
        import pyarrow as pa

        enc, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc, text, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * room)):
                    part = raw[at : at + 4 * room]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), text))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "piece", "start", "length", "ids_crc32", "tie"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.monotonically_increasing_id().alias("tie"))
    return read.mapInArrow(cut, PIECE)


def best_two_fit(docs: DataFrame, tokenizer: str, room: int = 4096, per_part: int = 16_000) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``room`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Pieces (not
    texts) are written with a number of their row, then dealt by its hash over tasks of about ``per_part`` pieces, repeated
    rows too; each packs its own, so a task leaves one part-filled sequence at most.  A null or empty text is
    the end id alone; a very long text is cut into pieces, the longest of which come first; pieces alike in length go by doc_id, then piece; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    cut = space.table(pieces(docs, tokenizer, room), "pieces")
    tasks = max(1, -(-cut.count() // per_part))

    def fill(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = table.column("length").to_pylist()
        seq, offset = [0] * len(length), [0] * len(length)
        base = TaskContext.get().partitionId() << 40
        for number, own in enumerate(pack(length, room)):
            at = 0
            for k in own:
                seq[k], offset[k] = base + number, at
                at += length[k]
        table = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        table = table.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from table.to_batches()

    out = cut.repartition(tasks, "tie", "piece").mapInArrow(fill, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("piece", F.col("piece").cast("int"))
