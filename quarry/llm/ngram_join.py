"""N-gram Jaccard self-join by parity sketches.

A document's set of shingles is XOR-hashed into a sketch of ``n`` blocks: a shingle
falls into one block and toggles that block's word.  Two sets that differ in ``d``
shingles have at most ``d`` differing blocks, so the blocks' Hamming distance is a lower bound of
the symmetric difference, and of ``n`` blocks at least ``n - d`` agree (pigeonhole).

Sizes are cut into bands of ratio 4/3.  A pair at the threshold lies in one band or two
neighbouring ones, and both sides are sketched with the block number of that pair of
bands.  There are half as many blocks again as the largest possible ``d``; they are
ordered by how many shingles they hold, and a set joins with its first ``d + 1`` only.
That order depends on a block's content alone, so linked sets still meet
(prefix filtering), and empty or nearly empty blocks, which would
join everything, stay out.

Sets that meet are verified on their exact shingles.  In a run of up to ``SMALL`` sets every
pair is verified; a larger run (a crowd) is verified against two pivots.  In a crowd
that these links leave in more than one component, the pairs between components whose
bit sketches are near enough (their Hamming distance, too, is a lower bound of the
difference) are verified; the others are no links.  That comparison is cut into tiles of two blocks of some ``TILE`` sets, each a
task's group of its own; the largest component is never compared with itself.  A crowd of more than ``LARGE`` sets is first
sketched again with other seeds, which part sets that met by chance; what ``SEEDS`` turns leave is compared in tiles like any other.
So no link between different components is lost, and no group emits all its pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import linked, mix, shingle_sets
from .tokens import slices as cut
from .workspace import Workspace, partitions, row_id

SMALL, LARGE, SEEDS, FLUSH, PER_BUCKET, TILE = 16, 16_384, 3, 2_000_000, 4_000_000, 512
SKETCH_BITS = 4096


def _edges(most: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 4 // 3 + 1)
    return out


EDGES = np.array(_edges(), np.int64)  # band k: EDGES[k] <= size < EDGES[k + 1]


def set_id(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketch_keys(sets: list[np.ndarray], seed: int, part: int = 75) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first d + 1 blocks of sorted, non-empty sets, for both pairs of bands that each can join in; whose they are."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    spread = np.concatenate(sets)
    if seed:
        spread = mix(spread + np.uint64(seed))
        spread = spread[np.lexsort((spread, owner))]
    words = mix(spread + np.uint64(0x51ED270B))
    band = np.searchsorted(EDGES, sizes, side="right") - 1
    keys, owners = [], []
    for step in (0, 1):
        lower = np.maximum(band - step, 0)
        joins = band - step >= 0
        top = EDGES[lower + 1] - 1  # the largest size of the lower band
        most = (100 - part) * (top + top * 100 // part) // (100 + part)  # largest symmetric difference of a pair
        partner = np.minimum(sizes, top) if step else sizes * 100 // part
        own = (100 - part) * (sizes + partner) // (100 + part)  # largest one of a pair with this set
        blocks = most + 1 + most // 2
        block = ((spread >> np.uint64(32)) * blocks.astype(np.uint64)[owner]) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])]))
        parity = np.bitwise_xor.reduceat(words, first)
        held = np.minimum(np.diff(np.append(first, len(spread))), 255)
        place, whose = block[first], owner[first]
        # stable order of a set's blocks: fullest first, then by content, then by place
        rank = (whose.astype(np.uint64) << np.uint64(40)) | ((255 - held).astype(np.uint64) << np.uint64(32)) | (parity >> np.uint64(32))
        order = np.argsort(rank, kind="stable")
        filled = np.bincount(whose, minlength=len(sets))
        begin = np.concatenate([[0], np.cumsum(filled)[:-1]])
        nth = np.arange(len(order)) - begin[whose[order]]
        order = order[(nth <= own[whose[order]]) & joins[whose[order]]]
        at, word, who = place[order], parity[order], whose[order]
        for k in np.flatnonzero(joins & (filled < np.minimum(own + 1, blocks))).tolist():  # empty blocks come last
            empty = np.setdiff1d(np.arange(blocks[k], dtype=np.uint64), place[begin[k] : begin[k] + filled[k]])[: own[k] + 1 - filled[k]]
            at, word, who = np.concatenate([at, empty]), np.concatenate([word, np.zeros(len(empty), np.uint64)]), np.concatenate([who, np.full(len(empty), k)])
        tag = mix(at + (lower[who].astype(np.uint64) << np.uint64(44)) + np.uint64((seed << 58) + 1))
        keys.append(mix(word ^ tag))
        owners.append(who)
    return np.concatenate(keys), np.concatenate(owners)


def _low(sid: bytes) -> int:
    return int.from_bytes(sid[:8], "little", signed=True)


def _base(docs: DataFrame) -> DataFrame:
    """rid (128-bit row hash), doc_id, sid (128-bit hash of the set), low (its first 64 bits), n_shingles."""

    def read(batches):
        import pyarrow as pa

        for batch in cut(batches):
            sets = shingle_sets(batch.column(2))
            sids = [set_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sids, pa.binary()), pa.array([x and _low(x) for x in sids], pa.int64()), pa.array([len(s) for s in sets], pa.int64())],
                ["rid", "doc_id", "sid", "low", "n_shingles"],
            )

    return _rows(docs).mapInArrow(read, "rid struct<x: bigint, y: bigint>, doc_id long, sid binary, low long, n_shingles long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(row_id("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def packed(docs: DataFrame) -> DataFrame:
    """rid and z of every row with a text: the text as a zstandard frame, which is what texts travel as."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        small = zstandard.ZstdCompressor(level=3)
        for batch in cut(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([small.compress(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["rid", "z"])

    return _rows(docs).where("text is not null").select("rid", "text").mapInArrow(run, "rid struct<x: bigint, y: bigint>, z binary")


def packed_sets(frames: list[bytes], most_bytes: int = 8 << 20) -> list[np.ndarray]:
    """Shingle sets of packed texts, of which at most ``most_bytes`` and one more text are open at a time."""
    import pyarrow as pa
    import zstandard

    whole, out, at, held = zstandard.ZstdDecompressor(), [], 0, 0
    for k, frame in enumerate(frames, 1):
        held += zstandard.frame_content_size(frame)
        if held > most_bytes or k == len(frames):
            out += shingle_sets(pa.array([whole.decompress(x) for x in frames[at:k]], pa.large_binary()).cast(pa.large_string()))
            at, held = k, 0
    return out


def _met(texts: DataFrame, seed: int, buckets: int) -> DataFrame:
    """kind 0: sets a < b that share a block; kind 1: block key a of a crowd that holds set b and whose least set is hub.
    Sets by their low 64 bits; ``texts`` has one column, of texts or of packed ones."""

    def emit(batches):
        import pyarrow as pa

        keys, owners, held, seen = [], [], 0, set()

        def flush():
            k, o = np.concatenate(keys), np.concatenate(owners)
            bucket = (mix(k ^ np.uint64(77)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, k, o = bucket[order], k[order], o[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(first[1:], len(bucket))
            rows = [k[a:b].tobytes() + o[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())]
            for at in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first][at : at + 500]), pa.array(rows[at : at + 500], pa.binary())], ["bucket", "data"])

        for batch in cut(batches):
            new, lows = [], []
            for s in packed_sets(batch.column(0).to_pylist()) if batch.schema.names == ["z"] else shingle_sets(batch.column(0)):
                low = _low(set_id(s)) if len(s) else None
                if low is not None and low not in seen:  # copies of a set are combined before the shuffle
                    seen.add(low)
                    new.append(s)
                    lows.append(low)
            if new:
                k, o = sketch_keys(new, seed)
                keys.append(k)
                owners.append(np.array(lows, np.int64)[o])
                held += len(k)
            if len(seen) > 500_000:
                seen.clear()
            if held > FLUSH:
                yield from flush()
                keys, owners, held = [], [], 0
        if held:
            yield from flush()

    def meet(table):
        import pyarrow as pa

        k, o = [], []
        for data in table.column("data"):
            raw = data.as_py()
            k.append(np.frombuffer(raw[: len(raw) // 2], np.uint64))
            o.append(np.frombuffer(raw[len(raw) // 2 :], np.int64))
        k, o = np.concatenate(k), np.concatenate(o)
        order = np.argsort(k, kind="stable")
        k, o = k[order], o[order]
        twice = np.concatenate([[False], k[1:] == k[:-1]])
        keep = twice | np.append(twice[1:], False)
        k, o = k[keep], o[keep]
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]) if len(k) else np.zeros(0, bool)
        k, o = k[fresh], o[fresh]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(k)))
        run = np.repeat(size, size)
        a, b, hubs = [], [], np.zeros(0, np.int64)
        small = run <= SMALL
        ks, os_ = k[small], o[small]
        for step in range(1, SMALL):
            same = ks[step:] == ks[:-step]
            if not same.any():
                break
            a.append(os_[:-step][same])
            b.append(os_[step:][same])
        crowd_k, crowd_o = k[~small], o[~small]
        if len(crowd_k):
            start = np.flatnonzero(np.concatenate([[True], crowd_k[1:] != crowd_k[:-1]]))
            length = np.diff(np.append(start, len(crowd_k)))
            hubs = np.repeat(crowd_o[start], length)  # a crowd's sets are in order
            for pivots in (start, start + np.array([int(mix(crowd_o[s : s + n].astype(np.uint64)).argmin()) for s, n in zip(start.tolist(), length.tolist())])):
                a.append(np.repeat(crowd_o[pivots], length))
                b.append(crowd_o)
        a = np.concatenate(a) if a else np.zeros(0, np.int64)
        b = np.concatenate(b) if b else np.zeros(0, np.int64)
        differ = a != b
        pairs = np.stack([np.minimum(a, b)[differ], np.maximum(a, b)[differ]], 1)
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        kind = np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(crowd_k), np.int32)])
        left = np.concatenate([pairs[:, 0], crowd_k.view(np.int64)])
        right = np.concatenate([pairs[:, 1], crowd_o])
        return pa.table({"kind": kind, "a": left, "b": right, "hub": np.concatenate([np.zeros(len(pairs), np.int64), hubs])})

    dealt = texts.mapInArrow(emit, "bucket long, data binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "kind int, a long, b long, hub long")


def _sketched(texts: DataFrame) -> DataFrame:
    """low, n (size) and the bit sketch of each set."""

    def sketch(batches):
        import pyarrow as pa

        for batch in cut(batches):
            rows = []
            for s in packed_sets(batch.column(1).to_pylist()):
                odd = np.bincount((s % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
                rows.append((len(s), np.packbits(odd.astype(np.uint8)).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["low", "n", "bits"])

    return texts.select("low", "z").mapInArrow(sketch, "low long, n long, bits binary")


def _fit(bits_a, bits_b, n_a, n_b, part: int) -> np.ndarray:
    """Whether the sketches' Hamming distance and the sizes allow a link."""
    apart = np.bitwise_count(bits_a ^ bits_b).sum(-1, dtype=np.int64)
    return ((100 + part) * apart <= (100 - part) * (n_a + n_b)) & (100 * np.minimum(n_a, n_b) >= part * np.maximum(n_a, n_b))


def _verify(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, part: int) -> DataFrame:
    """Links (a, b) between set ids among pairs of their low 64 bits: by sketches first, then by the sets themselves."""

    def allow(batches):
        import pyarrow as pa

        for batch in cut(batches, most_rows=4000):
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(len(a), -1) for k in (4, 5))
            fit = _fit(x, y, na, nb, part)
            yield pa.RecordBatch.from_arrays([pa.array(a[fit]), pa.array(b[fit])], ["a", "b"])

    left = sketches.select(F.col("low").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = sketches.select(F.col("low").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(allow, "a long, b long")

    def check(batches):
        import pyarrow as pa

        for batch in cut(batches):
            table = pa.Table.from_batches([batch])
            one = {}
            for sid, text in (("sa", "za"), ("sb", "zb")):
                ids = table.column(sid).to_pylist()
                fresh = {x: k for k, x in enumerate(ids) if x not in one}
                one.update(zip(fresh, packed_sets(table.column(text).combine_chunks().take(pa.array(list(fresh.values()), pa.int64())).to_pylist())))
            hit = [(x, y) for x, y in zip(table.column("sa").to_pylist(), table.column("sb").to_pylist()) if linked(one[x], one[y], part)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in hit], pa.binary()), pa.array([y for _, y in hit], pa.binary())], ["a", "b"])

    left = sets.select(F.col("low").alias("a"), F.col("sid").alias("sa"), F.col("z").alias("za"))
    right = sets.select(F.col("low").alias("b"), F.col("sid").alias("sb"), F.col("z").alias("zb"))
    return pairs.join(left, "a").join(right, "b").select("sa", "za", "sb", "zb").mapInArrow(check, "a binary, b binary")


def ngram_join(docs: DataFrame, part: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs(doc_id, text)``.

    Two rows link where 100 x shared shingles >= ``part`` x all shingles; component_id is the
    smallest doc_id reachable by links.  A null or text without words has no shingles, is its
    own component and links with nothing.  Equal sets (copies, repeated rows) are one node
    and count once however many there are; a tie at the threshold links.  A very long text's set is compared whole.  An empty table gives no rows; other columns are ignored.
    """
    rows = classes(docs, Workspace(docs.sparkSession, "ngram-join"), part)
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, part: int = 75) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay when one of each group of linked rows stays: that of
    the smallest doc_id, then of the smallest row hash.  Of rows alike in doc_id and text one stays.
    Rows without words stay as they are."""
    space = Workspace(docs.sparkSession, "ngram-join")
    rows = space.table(classes(docs, space, part), "classes").where("sid is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    best = rows.groupBy("root").agg(F.min(order).alias("best")).select("root", "best.rid")
    # written, so that its size is known: where it is small enough for Spark to broadcast, no text is exchanged
    gone = space.table(rows.select("root", "rid").distinct().join(best, ["root", "rid"], "left_anti").select("rid"), "gone")
    space.keep_only("classes", "gone")
    twice = space.table(rows.groupBy("rid").count().where("count > 1").select("rid"), "twice")
    own = docs.select(F.struct(*docs.columns).alias("row"), row_id("doc_id", "text").alias("rid"))
    kept = own.join(gone, "rid", "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, "rid", "left_anti").unionByName(kept.join(twice, "rid", "left_semi").dropDuplicates(["rid"]))
    return kept.select("row.*")


def classes(docs: DataFrame, space: Workspace, part: int = 75) -> DataFrame:
    """rid, doc_id, sid, n_shingles, root (id of the group) and component_id of every row; the last two are null without words."""
    spark = docs.sparkSession
    base = space.table(_base(docs), "base")
    sets = space.table(base.where("sid is not null").groupBy("sid", "low").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n")), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * partitions(spark), int(0.6 * total) // PER_BUCKET)

    met = space.table(_met(docs.select("text"), 0, buckets), "met-0")
    need = met.where("kind = 0").select(F.explode(F.array("a", "b")).alias("low")).distinct()
    wanted = sets.join(need, "low", "left_semi").select("rid", "sid", "low")
    texts = space.table(_of_rows(docs, wanted), "texts")
    sketches = space.table(_sketched(texts), "sketches")
    links, tree, turn = None, None, 0
    while True:
        pairs = met.where("kind = 0").select("a", "b").distinct()
        found = space.table(_verify(pairs, texts, sketches, part), f"links-{turn}")
        links = found if links is None else links.union(found)
        tree = space.table(components(links, space, f"star-{turn}"), f"tree-{turn}")
        held = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("low"), "hub")
        large = held.groupBy("key").count().where(F.col("count") > LARGE).select("key")
        again = None
        if turn + 1 < SEEDS and not large.isEmpty():
            again = held.join(large, "key", "left_semi").select("low").distinct()
            held = held.join(large, "key", "left_anti")
        crowds = space.table(_open(held, texts, tree, space, turn), f"crowds-{turn}")
        space.drop(f"named-{turn}")
        turn += 1
        if again is None and crowds.isEmpty():
            break
        near = _near(crowds, sketches, part)
        if again is not None:
            near = near.union(_met(texts.join(again, "low", "left_semi").select("z"), turn, buckets))
        met = space.table(near, f"met-{turn}")
    named = sets.select("sid", "least").join(tree.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = space.table(named, "named")
    space.keep_only("base", "named")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "root").select("sid", "root", "component_id")
    return base.join(named, "sid", "left").select("rid", "doc_id", "sid", "n_shingles", "root", "component_id")


def _of_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, low and packed text of the wanted rows; rows alike have one rid, and a set has one wanted row."""
    return packed(docs).join(wanted, "rid").dropDuplicates(["rid"]).select("sid", "low", "z")


def _open(held: DataFrame, texts: DataFrame, tree: DataFrame, space: Workspace, turn: int) -> DataFrame:
    """hub, low, root, keys (the blocks that a set shares in the crowds of a hub), top (the hub's largest component), x and o (how many
    sets are in it, and not), for hubs whose sets are not all in one component.

    A hub's crowds are mostly the blocks of one family, so a set stands here once and not once a block.
    """
    members = held.groupBy("hub", "low").agg(F.collect_set("key").alias("keys"))
    label = texts.select("low", "sid").join(tree.withColumnRenamed("node", "sid"), "sid", "left").select("low", F.xxhash64(F.coalesce("root", "sid")).alias("root"))
    named = space.table(members.join(label, "low"), f"named-{turn}")
    parts = named.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("n"))
    hubs = parts.groupBy("hub").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.max("n").alias("x"), (F.sum("n") - F.max("n")).alias("o")).where("o > 0")
    hubs = space.table(hubs, f"hubs-{turn}")  # written, so that the join below may split a hub
    return named.join(hubs, "hub").select("hub", "low", "root", "keys", "top", "x", "o")


#: Tiles of a set: those outside the largest component are compared with each other and with those inside.
_TILES = """if(root = top,
  transform(sequence(0, bo - 1), j -> named_struct('i', j, 'j', b, 'inner', false, 'side', 1)),
  concat(transform(sequence(0, bx - 1), j -> named_struct('i', b, 'j', j, 'inner', false, 'side', 0)),
         transform(sequence(0, bo - 1), j -> named_struct('i', least(b, j), 'j', greatest(b, j), 'inner', true, 'side', cast(b > j as int)))))"""


def _near(crowds: DataFrame, sketches: DataFrame, part: int) -> DataFrame:
    """Pairs (kind 0) of each crowd that are in different components and whose bit sketches are near enough for a link.

    A hub's crowds are read together, tile by tile, so a pair that meets in many blocks is looked at once.
    """

    def near(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        low, root, n, side = (table.column(c).to_numpy() for c in ("low", "root", "n", "side"))
        alone = bool((side == side[0]).all())  # a block with itself, or a tile of which one side is empty
        if alone and not (table.column("inner")[0].as_py() and table.column("i")[0] == table.column("j")[0]):
            return none
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(low), -1)
        lists = table.column("keys").combine_chunks()
        keys, whose = lists.flatten().to_numpy(), np.repeat(np.arange(len(low)), pc.list_value_length(lists).to_numpy())
        order = np.lexsort((whose, keys))
        keys, whose = keys[order], whose[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        open_ = root[:, None] != root[None, :]
        open_ &= np.triu(open_) if alone else (side[:, None] < side[None, :])
        found = [np.zeros(0, np.int64)]
        for start, end in zip(first.tolist(), np.append(first[1:], len(keys)).tolist()):
            block = np.ix_(whose[start:end], whose[start:end])
            x, y = np.nonzero(open_[block])
            open_[block] = False
            x, y = whose[start:end][x], whose[start:end][y]
            for cut_at in range(0, len(x), 20_000):
                a, b = x[cut_at : cut_at + 20_000], y[cut_at : cut_at + 20_000]
                fit = _fit(bits[a], bits[b], n[a], n[b], part)
                found.append(a[fit] * len(low) + b[fit])
        code = np.concatenate(found)
        a, b = low[code // len(low)], low[code % len(low)]
        return pa.table({"kind": np.zeros(len(a), np.int32), "a": np.minimum(a, b), "b": np.maximum(a, b), "hub": np.zeros(len(a), np.int64)})

    import pyarrow as pa

    none = pa.table({"kind": np.zeros(0, np.int32), **{c: np.zeros(0, np.int64) for c in ("a", "b", "hub")}})
    sized = crowds.withColumns({"bo": F.ceil(F.col("o") / TILE), "bx": F.ceil(F.col("x") / TILE)})
    dealt = sized.withColumn("b", F.pmod(F.xxhash64("low"), F.when(F.col("root") == F.col("top"), F.col("bx")).otherwise(F.col("bo"))))
    dealt = dealt.join(sketches, "low").select("hub", "low", "root", "keys", "n", "bits", F.explode(F.expr(_TILES)).alias("t")).select("hub", "low", "root", "keys", "n", "bits", "t.*")
    return dealt.groupBy("hub", "i", "j", "inner").applyInArrow(near, "kind int, a long, b long, hub long")
