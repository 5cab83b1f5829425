"""Token-id files by bit-plane shuffling.

A ``.bps`` file holds the ids of a run of documents.  Ids are cut into blocks of a
fixed size; a block is transposed into bit planes (or byte planes), each plane is
compressed with zstandard on its own, and a chunk index at the end of the file
gives every plane's place, so one block can be read without the others.

Layout (little-endian)::

    magic 8 | blocks' planes ... | tail | u64 tail offset | magic 8
    tail: zstd of  u32 kind, u32 block size, u64 first id (in its partition), u64 ids, u64 documents,
                   u32 blocks | per block: u64 offset, u32 ids, u32 planes, u32 length of each plane
                   | per document: u8 has-id, i64 doc_id, u32 tokens
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import END_ID, encoder, slices
from .workspace import Workspace, partitions

MAGIC = b"QBPSv1\0\n"
BIT, BYTE = 1, 8


def _planes(ids: np.ndarray, kind: int) -> list[bytes]:
    top = int(ids.max()) if len(ids) else 0
    if kind == BYTE:
        cols = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [np.ascontiguousarray(cols[:, k]).tobytes() for k in range(max(1, (top.bit_length() + 7) // 8))]
    return [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(max(1, top.bit_length()))]


def _unplane(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint32)
    for k, raw in enumerate(planes):
        if kind == BYTE:
            out |= np.frombuffer(raw, np.uint8)[:n].astype(np.uint32) << np.uint32(8 * k)
        else:
            out |= np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


def pack_file(ids: np.ndarray, doc_ids: list, counts: list[int], first: int = 0, kind: int = BIT, block: int = 1 << 16, level: int = 1) -> bytes:
    """Bytes of one file: ``ids`` of all its documents, and each document's id and token count."""
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=level).compress
    body, index = [MAGIC], []
    at = len(MAGIC)
    for lo in range(0, len(ids), block):
        part = ids[lo : lo + block]
        planes = [zip_(p) for p in _planes(part, kind)]
        index.append(struct.pack("<QII", at, len(part), len(planes)) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
        body += planes
        at += sum(map(len, planes))
    docs = np.zeros(len(counts), dtype=[("has", "u1"), ("id", "<i8"), ("n", "<u4")])
    docs["has"] = [d is not None for d in doc_ids]
    docs["id"] = [d or 0 for d in doc_ids]
    docs["n"] = counts
    tail = zip_(struct.pack("<IIQQQI", kind, block, first, len(ids), len(counts), len(index)) + b"".join(index) + docs.tobytes())
    return b"".join(body) + tail + struct.pack("<Q", at) + MAGIC


class TokenFile:
    """Reader of one file's bytes; ``block(k)`` reads one block through the chunk index."""

    def __init__(self, data: bytes):
        import zstandard

        if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file, or cut short")
        self.unzip, self.data = zstandard.ZstdDecompressor().decompress, data
        (at,) = struct.unpack_from("<Q", data, len(data) - len(MAGIC) - 8)
        tail = self.unzip(data[at : len(data) - len(MAGIC) - 8])
        self.kind, self.block_size, self.first, self.n_ids, self.n_docs, blocks = struct.unpack_from("<IIQQQI", tail)
        pos, self.index = struct.calcsize("<IIQQQI"), []
        for _ in range(blocks):
            off, n, planes = struct.unpack_from("<QII", tail, pos)
            pos += 16
            self.index.append((off, n, struct.unpack_from(f"<{planes}I", tail, pos)))
            pos += 4 * planes
        self.docs = np.frombuffer(tail, dtype=[("has", "u1"), ("id", "<i8"), ("n", "<u4")], offset=pos, count=self.n_docs)

    def block(self, k: int) -> np.ndarray:
        off, n, lengths = self.index[k]
        planes = []
        for length in lengths:
            planes.append(self.unzip(self.data[off : off + length]))
            off += length
        return _unplane(planes, n, self.kind)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.index))] or [np.zeros(0, np.uint32)])


def _put(path: str, data: bytes, attempt: str) -> None:
    """Write beside the target and move there, so a repeated attempt leaves one whole file."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    folder, _, name = place.rpartition("/")
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/.{name}.{attempt}") as out:
        out.write(data)
    store.move(f"{folder}/.{name}.{attempt}", place)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, parts: int | None = None, file_ids: int = 4_000_000, kind: int = BIT) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending ``doc_id`` order into files under ``folder``.

    Rows are dealt by ranges of (doc_id, text hash), so a repeated or missing doc_id
    cannot gather in one task beyond its identical rows; null ids come first, null
    texts are empty and every document ends with id 1.  Files hold whole documents
    and about ``file_ids`` ids.  Returns one row per file: part, file, n_docs, n_ids, n_bytes.
    """
    parts = parts or partitions(docs.sparkSession)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), str(task.taskAttemptId())
        enc, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        held, ids, counts, size, first, number = [], [], [], 0, 0, 0
        rows = []

        def flush():
            nonlocal held, ids, counts, size, first, number
            data = pack_file(np.frombuffer(b"".join(held), "<u4"), ids, counts, first, kind)
            _put(f"{folder}/part-{part:06d}-{number:06d}.bps", data, attempt)
            rows.append((part, number, len(ids), size, len(data)))
            held, ids, counts, first, size, number = [], [], [], first + size, 0, number + 1

        for batch in slices(batches):
            for doc, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                held.append(raw + end)
                ids.append(doc)
                counts.append(len(raw) // 4 + 1)
                size += counts[-1]
                if size >= file_ids:
                    flush()
        if ids:
            flush()
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["part", "file", "n_docs", "n_ids", "n_bytes"])

    tie = F.xxhash64("text")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange(parts, F.col("doc_id"), tie)
    return dealt.sortWithinPartitions("doc_id", tie).mapInArrow(write, "part long, file long, n_docs long, n_ids long, n_bytes long")


def read_token_files(spark: SparkSession, folder: str, starts: dict[int, int]) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    ``starts`` has the ids before each written partition: one number a partition.
    """

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = TokenFile(data.as_py())
                part = int(path.rpartition("part-")[2].split("-")[0])
                raw = f.ids().astype("<u4").tobytes()
                ends = np.cumsum(f.docs["n"].astype(np.int64))
                begins = ends - f.docs["n"]
                crc = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(f.docs["id"].astype(np.int64), mask=f.docs["has"] == 0),
                        pa.array(begins + f.first + starts[part], pa.int64()),
                        pa.array(f.docs["n"].astype(np.int64)),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bps").load(folder).select("path", "content")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, parts: int | None = None, file_ids: int = 4_000_000, kind: int = BIT) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back.

    Nulls, empties: a null or empty text is the end id alone.  A very long text is encoded whole and may run over blocks and
    files.  Rows of one doc_id stand in order of their texts' hashes.  Repeated rows are
    documents of their own, side by side.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "token-files")
    manifest = space.table(write_token_files(docs, space.path("ids"), tokenizer, parts, file_ids, kind), "manifest")
    totals = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row a partition
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part] = at
        at += totals[part]
    if not totals:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, space.path("ids"), starts)
