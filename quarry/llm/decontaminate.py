"""Benchmark decontamination: a broadcast hash set of normalised test windows."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import slices
from .workspace import Workspace

WINDOW = 10
#: Bytes that part words: all ASCII but digits and lower-case letters, after A-Z became a-z.
_PART = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_FOLD = bytes(_PART[c + 32] if 0x41 <= c <= 0x5A else _PART[c] for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Windows:
    """Hash set of the windows of some items, by length; words are numbers of a common vocabulary."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.sets: dict[int, dict[bytes, list]] = defaultdict(dict)
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            n = min(window, len(ids))
            for at in range(len(ids) - n + 1) if n else ():
                key = np.array(ids[at : at + n], np.int32).tobytes()
                owners = self.sets[n].setdefault(key, [])
                if not owners or owners[-1] != item:
                    owners.append(item)

    def scan(self, ws: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words stand in an occurring window, and the items that own one."""
        hit, found = np.zeros(len(ws), bool), set()
        get = self.number.get
        ids = np.array([get(w, 0) for w in ws], np.int32)
        # lengths of the runs of known words that end at each place
        place = np.arange(len(ids))
        run = place - np.maximum.accumulate(np.where(ids == 0, place, -1))
        for n, known in self.sets.items():
            for end in np.flatnonzero(run >= n).tolist():
                if owners := known.get(ids[end - n + 1 : end + 1].tobytes()):
                    hit[end - n + 1 : end + 1] = True
                    found.update(owners)
        return hit, found


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def cut_spans(text: str, hit: np.ndarray) -> str:
    """The text without the characters from the first to the last word of each run of hit words."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw.translate(_FOLD))]
    out, last = [], 0
    for a, b in _spans(hit):
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def _item_blocks(benchmark: DataFrame, space: Workspace, most_chars: int) -> tuple[DataFrame, list[int]]:
    """Items in a written table by ``block``, and the blocks' numbers.  A block's texts have ``most_chars`` characters at most, or it is one item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null").distinct()
    items = space.table(items.withColumn("h", F.xxhash64("item", "text")), "items")
    total, count = items.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    n = max(1, -(-(total or 0) // most_chars))
    while True:
        dealt = items.withColumn("block", F.pmod("h", F.lit(n)).cast("int"))
        if n == 1 and (total or 0) <= most_chars:
            break
        over = dealt.groupBy("block").agg(F.sum(F.length("text")).alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("size") > most_chars) & (F.col("n") > 1))
        if n > 4 * count or over.isEmpty():
            break
        n *= 2
    table = space.table(dealt.drop("h"), "blocks")
    return table, sorted(r[0] for r in table.select("block").distinct().collect())  # numbers


def _scan(docs: DataFrame, row: list, benchmark: DataFrame, window: int, most_chars: int, texts: bool) -> DataFrame:
    """row, text, n_words, n_hit, hits, items and clean_text of every document; ``row`` is a struct of the given columns."""
    spark = docs.sparkSession
    space = Workspace(spark, "decontaminate")
    out = docs.select(F.struct(*row).alias("row"), F.col("text"), F.lit(None).cast("array<array<int>>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    schema = T.StructType([T.StructField("row", out.schema["row"].dataType), *T.StructType.fromDDL("text string, n_words long, n_hit long, hits array<array<int>>, items array<string>, clean_text string").fields])
    table, numbers = _item_blocks(benchmark, space, most_chars)
    for turn, number in enumerate(numbers or [0], 1):
        last = turn >= len(numbers)
        block = [(r["item"], r["text"]) for r in table.where(F.col("block") == number).orderBy("item", "text").collect()]  # one block at a time
        sent, bare = spark.sparkContext.broadcast(block), not texts and last

        def scan(batches, sent=sent, bare=bare):
            import pyarrow as pa

            known = Windows(sent.value, window)
            for batch in slices(batches):
                texts, before, owners = (c.to_pylist() for c in batch.columns[1:])
                rows = defaultdict(list)
                for text, spans, own in zip(texts, before, owners):
                    ws = words(text)
                    hit, found = known.scan(ws)
                    for a, b in spans or ():
                        hit[a:b] = True
                    rows["n_words"].append(len(ws))
                    rows["n_hit"].append(int(hit.sum()))
                    rows["hits"].append([list(s) for s in _spans(hit)])
                    rows["items"].append(sorted(found | set(own or ())))
                    rows["clean"].append(None if bare else text if text is None or not hit.any() else cut_spans(text, hit))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.nulls(batch.num_rows, pa.string()) if bare else batch.column(1), pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_hit"], pa.int64()), pa.array(rows["hits"], pa.list_(pa.list_(pa.int32()))), pa.array(rows["items"], pa.list_(pa.string())), pa.array(rows["clean"], pa.string())],
                    ["row", "text", "n_words", "n_hit", "hits", "items", "clean_text"],
                )

        out = out.select("row", "text", "hits", "items").mapInArrow(scan, schema)
        if not last:  # what this block found is written, so its items may leave the driver
            out = space.table(out, f"scanned-{turn}")
            sent.destroy()
            if turn > 1:
                space.drop(f"scanned-{turn - 1}")
    return out


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_chars: int = 8_000_000, texts: bool = True) -> DataFrame:
    """doc_id and text of ``docs``, and the benchmark windows found in each.

    Adds ``hits`` (array of word spans [from, to)), ``items`` (sorted item ids), ``n_words``, ``n_hit``
    and ``clean_text`` (hit spans cut out; null where the text is null).
    Without ``texts`` both texts come back null, which spares their way back from Python.

    The set that is broadcast is bounded: up to ``most_chars`` characters of items (or one item) are held by the driver and go out at once.
    A larger benchmark is a stated query set run in blocks of that size: each block scans all
    documents, and the marks of earlier blocks travel along in a written table.
    Null and empty texts have no words; a null item_id or text is no item.  A very long text is scanned whole, in time proportional to its words.
    An item that several windows or rows share, or that stands twice, counts once (no ties to break); repeated rows are scanned each.
    An empty table gives no rows, an empty benchmark no hits; other columns are ignored, whatever their names.
    """
    found = _scan(docs, [F.col("doc_id").cast("long").alias("doc_id")], benchmark, window, most_chars, texts)
    return found.select("row.doc_id", "text", "n_words", "n_hit", "hits", "items", "clean_text")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns, whatever their names; else as :func:`scan_documents`."""
    return _scan(docs, [F.col(c) for c in docs.columns], benchmark, window, most_chars, False).where("n_hit = 0").select("row.*")


def items_digest(items: list) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
