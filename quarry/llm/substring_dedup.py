"""Exact substring deduplication by external induced sorting.

Every byte that a string of ``window`` bytes covers goes, if that string also starts anywhere else.

*Blocks.*  A string's anchor is its leftmost gram of least hash.  Neighbouring starts that have one anchor and lie in
one cell of ``CELL`` places before it make a block.  All strings of a cell share the bytes
in their middle (337 of 400), whose hash is the block's key: equal strings have equal
keys, at the same place of the cell.  A block that occurs twice is repeated as a whole,
which a count shows.  Only where one key has several different blocks must their strings be sorted.

*Shards.*  Those blocks, each once, are dealt by key into shards.  A block is read as its bytes before the
middle, one symbol for the middle and its bytes after it, so a string is ``CELL`` symbols.
Each shard's suffixes are sorted by :mod:`.induced`; neighbours that agree are repeats.  A key
with more than ``LARGE`` different blocks (the edge of a passage that very many documents
share) would fill one shard: its starts are spread by the hash of their string instead, and counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced import repeated_starts
from .shingles import joined, mix
from .tokens import slices
from .workspace import Workspace

WINDOW, GRAM, CELL, LARGE, SHARD_BYTES = 400, 32, 64, 1000, 4 << 20
_RANDOM = np.random.default_rng(20240613)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(1, 1 << 63)) | 1
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            more = np.full(size, base, np.uint64)
            more[0] = 1
            _powers.append(np.multiply.accumulate(more))
    return _powers


class Hashes:
    """Hashes of any substring of ``raw``, equal for equal strings wherever they stand."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = _tables(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=self.sums[1:])

    def of(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[at]) * self.inverse[at])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values."""
    n = len(values) - width + 1
    rows = np.append(values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def blocks(texts, window: int = WINDOW, gram: int = GRAM, cell: int = CELL) -> dict[str, np.ndarray]:
    """Of an Arrow string array: row, start (in its text), n starts, left (bytes before the middle), key, content."""
    raw, at = joined(texts)
    if len(raw) < window:
        return {k: np.zeros(0, np.int64) for k in ("row", "start", "n", "left", "key", "content")}
    hashes = Hashes(raw)
    place = np.arange(len(raw) - gram + 1)
    own = hashes.of(place, place + gram)
    least = sliding_min((own & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64), window - gram + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the string that starts at each place
    start = np.arange(len(anchor))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    whole = start + window <= at[row + 1]
    # a cell's last start, where the middle begins
    last = anchor - (anchor - start) // cell * cell
    group = np.where(whole, last * 2 + 1, -1)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(anchor))
    keep = whole[first]
    first, ends = first[keep], ends[keep]
    middle = last[first]
    key = mix(hashes.of(middle, middle + window - cell + 1) + ((anchor[first] - middle) // cell).astype(np.uint64))
    left = middle - first
    content = mix(hashes.of(first, ends - 1 + window) ^ mix((left * 4096 + ends - first).astype(np.uint64)))
    return {"row": row[first], "start": first - at[row[first]], "n": ends - first, "left": left, "key": key.view(np.int64), "content": content.view(np.int64)}


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def repeats(docs: DataFrame, space: Workspace, window: int = WINDOW, gram: int = GRAM, cell: int = CELL, large: int = LARGE) -> DataFrame:
    """rid and [a, b): bytes of its text that repeated strings cover, unmerged."""
    spark = docs.sparkSession

    def find(batches):
        import pyarrow as pa

        for batch in slices(batches, most_bytes=2 << 20):
            b = blocks(batch.column(1), window, gram, cell)
            cols = [batch.column(0).take(pa.array(b["row"])), *(pa.array(b[c].astype(t)) for c, t in (("start", np.int64), ("n", np.int32), ("left", np.int32), ("key", np.int64), ("content", np.int64)))]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "start", "n", "left", "key", "content"])

    found = _rows(docs).select("rid", "text").mapInArrow(find, "rid long, start long, n int, left int, key long, content long")
    found = space.table(found, "blocks")
    one = found.groupBy("key", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("rid", "start", "n", "left")).alias("at"))
    one = space.table(one.select("key", "content", "times", "at.*"), "contents")
    several = one.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = space.table(one.join(several, "key"), "mixed")
    # the bytes around the middle of those blocks, each once, from the text that holds it
    asked = mixed.groupBy("rid").agg(F.collect_list(F.struct("key", "content", "start", "n", "left", "times", "kinds")).alias("asked"))

    def cut(batches):
        import pyarrow as pa

        kept = ("key", "content", "n", "times", "kinds")
        for batch in slices(batches):
            out = {k: [] for k in (*kept, "before", "after")}
            for text, asks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for a in asks:
                    middle = a["start"] + a["left"]
                    out["before"].append(raw[a["start"] : middle])
                    out["after"].append(raw[middle + window - cell + 1 : a["start"] + a["n"] - 1 + window])
                    for k in kept:
                        out[k].append(a[k])
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    texts = _rows(docs).select("rid", "text").join(asked, "rid").select("text", "asked")
    held = texts.mapInArrow(cut, "key long, content long, n int, times long, kinds long, before binary, after binary")
    held = space.table(held, "held")
    space.drop("mixed")

    size = held.where(F.col("kinds") <= large).agg(F.sum(F.length("before") + F.length("after") + 2)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def sort(table):
        import pyarrow as pa

        table = table.group_by(["key", "content"]).aggregate([("n", "min"), ("times", "min"), ("before", "min"), ("after", "min")])  # rows alike were cut twice
        n, times = table.column("n_min").to_pylist(), table.column("times_min").to_pylist()
        pieces = list(zip(table.column("before_min").to_pylist(), table.column("key").to_pylist(), table.column("after_min").to_pylist()))
        again = repeated_starts(pieces, n, cell)
        spans = [_runs(np.ones(k, bool) if t > 1 else a) for a, k, t in zip(again, n, times)]
        return pa.table({"key": table.column("key"), "content": table.column("content"), "spans": pa.array(spans, pa.list_(pa.list_(pa.int32())))})

    schema = "key long, content long, spans array<array<int>>"
    sorted_ = held.where(F.col("kinds") <= large).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(sort, schema)

    def spread(batches):
        import pyarrow as pa

        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for key, content, n, times, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.arange(n)
                lead, raw = len(before), np.frombuffer(before + after, np.uint8)
                h = Hashes(raw).of(at, at + cell - 1) + mix((lead - at).astype(np.uint64))  # the middle is the same
                for own, values in zip(out, (np.full(n, key), np.full(n, content), at.astype(np.int32), h.view(np.int64), np.full(n, times))):
                    own.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["key", "content", "at", "h", "times"])

    starts = held.where(F.col("kinds") > large).select("key", "content", "n", "times", "before", "after").dropDuplicates(["key", "content"])
    starts = space.table(starts.mapInArrow(spread, "key long, content long, at int, h long, times long"), "starts")
    twice = starts.groupBy("key", "h").agg(F.sum("times").alias("all")).where("all > 1").select("key", "h")
    counted = starts.join(twice, ["key", "h"]).groupBy("key", "content").agg(F.expr("transform(collect_set(at), x -> array(x, x + 1))").alias("spans"))

    alone = one.where("times > 1").join(several, "key", "left_anti").select("key", "content", F.expr("array(array(0, n))").alias("spans"))
    known = space.table(sorted_.union(counted).union(alone).where("size(spans) > 0"), "known")
    space.keep_only("blocks", "known")
    cover = found.select("rid", "key", "content", "start").join(known, ["key", "content"])
    return cover.select("rid", F.explode("spans").alias("s"), "start").select("rid", (F.col("start") + F.col("s")[0]).alias("a"), (F.col("start") + F.col("s")[1] - 1 + window).alias("b"))


def _runs(marks: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return [[int(a), int(b)] for a, b in zip(edge[::2], edge[1::2])]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cell: int = CELL, large: int = LARGE, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte runs [from, to), merged), kept (remaining bytes) and kept_sha256 of every row.

    Texts are UTF-8 bytes; a null one is empty.  Strings are judged on the input.  Matches never cross rows;
    rows alike repeat each other.  A very long text is cut into blocks like any other, its spans gathered a row; there is nothing to tie.  Without ``texts`` ``kept`` is null.  An empty
    table gives no rows; other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "substring-dedup")
    # a text's blocks are its own, so neither a repeated passage nor a hot source gathers here
    cover = repeats(docs, space, window, gram, cell, large).groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("cover"))

    def cut(batches):
        import pyarrow as pa

        for batch in slices(batches):
            out = {k: [] for k in ("n_bytes", "spans", "kept", "sha")}
            for text, cover in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for c in sorted((c["a"], c["b"]) for c in cover or ()):
                    if spans and c[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], c[1])
                    else:
                        spans.append(list(c))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                out["n_bytes"].append(len(raw))
                out["spans"].append(spans)
                out["kept"].append(left if texts else None)
                out["sha"].append(hashlib.sha256(left).hexdigest())
            types = (pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types))], ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"])

    rows = _rows(docs).join(cover, "rid", "left").select("doc_id", "text", "cover")
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, spans array<array<long>>, kept binary, kept_sha256 string")
