"""Community detection by local moving, small communities merged."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, numbered
from .graph import weak_components

SWEEPS, MOST = 20, 15
#: So many rows a task sends at once.
SENT = 1 << 16


def local_moving(nodes: list[int], pairs: list[tuple[int, int]], m: float, sweeps: int = SWEEPS) -> dict[int, int]:
    """Community of each node of one component; ``m`` is the number of edges of the whole graph.

    Nodes move in order of id to the neighbouring community of greatest positive gain, the lesser id on ties.
    """
    near: dict[int, list[int]] = defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
        if a != b:
            near[b].append(a)
    own = {n: n for n in nodes}
    total = {n: float(len(near[n])) for n in nodes}
    for _ in range(sweeps):
        moved = False
        for n in sorted(nodes):
            k = float(len(near[n]))
            ties = Counter(own[x] for x in near[n])
            best, gain = own[n], 0.0
            for c in sorted(ties):
                if c == own[n]:
                    continue
                g = ties[c] / (2 * m) - total[c] * k / (4 * m * m)
                if g > gain:
                    best, gain = c, g
            if best != own[n]:
                total[own[n]] -= k
                total[best] += k
                own[n], moved = best, True
        if not moved:
            break
    return own


def _linked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The symbols, once each, and the edges between them (source_id, target_id), written."""
    nodes = nodes.select("symbol_id").distinct()
    pairs = edges.select("source_id", "target_id")
    for end in pairs.columns:
        pairs = pairs.join(nodes.withColumnRenamed("symbol_id", end), end, "left_semi")
    return nodes, cut(pairs.select("source_id", "target_id"))


#: What a task tells: (MOVED, symbol, community), (MERGED, community, group, pass) where it comes to another group, (PASS, by how many groups fell, null, pass).
MOVED, MERGED, PASS = range(3)
TOLD = "kind int, a long, b long, stage int, threshold long, again int"


def _told(label: DataFrame, pairs: DataFrame, m: float, end: int | None = None) -> DataFrame:
    """``TOLD`` of the local moving within components, and of the merging of their communities unless ``end`` is None.

    Both ends of an edge are laid out by component and sorted by symbol.  The components of a partition are one graph to its task: no move
    crosses a component and ``m`` is a constant, so they give what one run over the whole graph gives.  Neighbours lie in a file of
    the task's scratch folder; in memory are some numbers a symbol and a stretch of neighbours.
    """
    own = pairs.join(label.select(F.col("symbol_id").alias("source_id"), "component"), "source_id")
    there, back = F.struct(F.col("source_id").alias("symbol_id"), F.col("target_id").alias("near")), F.struct(F.col("target_id").alias("symbol_id"), F.col("source_id").alias("near"))
    ends = own.select("component", F.explode(F.when(F.col("source_id") == F.col("target_id"), F.array(there)).otherwise(F.array(there, back))).alias("e")).select("component", "e.symbol_id", "e.near")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .moving import Neighbours, moved, passes

        def rows(kind, a, b, step=(0, 0, 0)):
            for at in range(0, len(a), SENT):
                n = len(a[at : at + SENT])
                whole = [np.full(n, x) for x in (kind, *step)]
                columns = [whole[0], a[at : at + SENT], pa.nulls(n) if b is None else b[at : at + SENT], *whole[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=("kind", "a", "b", "stage", "threshold", "again"))

        near = Neighbours((b.column("symbol_id").to_numpy(), b.column("near").to_numpy()) for b in batches)
        own = moved(near, m, SWEEPS)
        first = np.full(len(near), len(near))
        np.minimum.at(first, own, np.arange(len(near)))
        yield from rows(MOVED, near.ids, near.ids[first[own]])
        if end is not None:
            for step, fell, community, group in passes(near, own, end):
                yield from rows(PASS, np.array([fell]), None, step)
                yield from rows(MERGED, community, group, step)

    return cut(ends.repartition("component").select("symbol_id", "near").sortWithinPartitions("symbol_id").mapInArrow(run, TOLD))


def _of(told: DataFrame, label: DataFrame) -> DataFrame:
    """symbol_id, community (its least symbol); the last is null without an edge."""
    return label.select("symbol_id").join(told.where(F.col("kind") == MOVED).select(F.col("a").alias("symbol_id"), F.col("b").alias("community")), "symbol_id", "left")


def detect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol_id, community (its least symbol) by local moving, as in :func:`local_moving`.

    An edge to what is no symbol is none.
    """
    nodes, pairs = _linked(nodes, edges)
    m = float(pairs.count())
    if not m:
        least = nodes.agg(F.min("symbol_id").alias("community"))  # one row
        return nodes.select("symbol_id").crossJoin(least)
    label = cut(weak_components(nodes, pairs, linked=True))
    return _of(_told(label, pairs, m), label)


def merge(sizes: dict[int, int], ties: dict[tuple[int, int], int], most: int = MOST) -> dict[int, int]:
    """Final community (0-based, by size) of each initial one: small ones go to the neighbour with most edges.

    ``ties`` has the undirected edge counts between communities; key 0 of ``sizes`` may be the isolated nodes.
    """
    order = sorted(sizes, key=lambda c: (c == 0, -sizes[c], c))
    groups = [[c] for c in order]

    def once(threshold: int) -> None:
        nonlocal groups
        if len(groups) <= 1:
            return
        place = {c: k for k, g in enumerate(groups) for c in g}
        near: dict[int, Counter] = {k: Counter() for k, g in enumerate(groups) if sum(sizes[c] for c in g) <= threshold}
        for (a, b), n in ties.items():  # once a pass, for all small groups
            x, y = place[a], place[b]
            if x != y:
                if x in near:
                    near[x][y] += n
                if y in near:
                    near[y][x] += n
        moves = [(k, min(own, key=lambda x: (-own[x], x))) for k, own in near.items() if own]
        for k, to in moves:
            groups[to], groups[k] = groups[to] + groups[k], []
        groups = sorted((g for g in groups if g), key=lambda g: (-sum(sizes[c] for c in g), min(g)))

    once(3)
    for threshold in (5, 10):
        if len(groups) > most:
            once(threshold)
    while len(groups) > most:
        before = len(groups)
        once(sum(sizes[c] for c in groups[-1]))
        if len(groups) >= before:
            break
    return {c: k for k, g in enumerate(groups) for c in g}


def communities(nodes: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """symbol_id, community_id (1 is the largest) after merging as in :func:`merge`; symbols without an edge are one community.

    A component is moved and merged in one task, see :func:`_told`; the driver gets one row for each pass, to find the one that is the last.
    An edge to what is no symbol is none.
    """
    nodes, pairs = _linked(nodes, edges)
    m = float(pairs.count())
    if not m:
        return nodes.select("symbol_id", F.lit(1).cast("long").alias("community_id"))
    label = cut(weak_components(nodes, pairs, linked=True))
    # a group without ties that is the smallest ends the merging
    loops = pairs.where("source_id = target_id").select(F.col("source_id").alias("component"), F.lit(True).alias("loop")).distinct()
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(loops, "component", "left")
    whole, lone = sizes.agg(F.min(F.when((F.col("n") > 1) | F.col("loop"), F.col("n"))), F.count_if((F.col("n") == 1) & F.col("loop").isNull())).first()
    end = min(whole, lone) if lone else whole
    told = _told(label, pairs, m, end)
    left = told.where(F.col("kind") == MOVED).agg(F.count_distinct("b")).first()[0] + (lone > 0)
    last, step = (0, 3, 0), ["stage", "threshold", "again"]
    falls = told.where(F.col("kind") == PASS).groupBy(*step).agg(F.sum("a").alias("fell"))
    for stage, threshold, again, fell in falls.orderBy(*step).collect():  # a row a pass
        if stage and (left <= most or (stage == 3 and threshold > end)):
            break
        left, last = left - fell, (stage, threshold, again)
    upto = F.struct(*step) <= F.struct(F.lit(last[0]), F.lit(last[1]).cast("long"), F.lit(last[2]))
    merged = told.where((F.col("kind") == MERGED) & upto).groupBy(F.col("a").alias("community")).agg(F.max_by("b", F.struct(*step)).alias("group"))
    placed = cut(_of(told, label).join(merged, "community", "left").select("symbol_id", "community", F.coalesce("group", "community").alias("group")))
    groups = placed.groupBy("group").agg((-F.count(F.lit(1))).alias("late"), F.min("community").alias("least"))
    ranked = numbered(groups.select("group", "late", F.coalesce("least", F.lit(0)).alias("key"), F.col("least").isNull().alias("alone")), ["late", "key", "alone"], "community_id")
    return placed.alias("p").join(ranked.alias("r"), F.col("p.group").eqNullSafe(F.col("r.group"))).select("symbol_id", "community_id")


def topological(deps: list[tuple[int, int]], ids: list[int], first: set[int] = frozenset()) -> list[int]:
    """Communities after what they depend on (Kahn), ``deps`` being (user, used): entry communities first, then by id; cycles at the end."""
    deps = sorted(set(d for d in deps if d[0] != d[1]))
    open_ = Counter(a for a, _ in deps)
    ready = sorted((c for c in ids if not open_[c]), key=lambda c: (c not in first, c))
    out = []
    while ready:
        c = ready.pop(0)
        out.append(c)
        for a, b in deps:
            if b == c:
                open_[a] -= 1
                if not open_[a]:
                    ready.append(a)
    return out + sorted(set(ids) - set(out))
