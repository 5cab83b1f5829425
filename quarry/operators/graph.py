"""Graph analytics on nodes(symbol_id, name, ...), edges(edge_id, source_id, target_id, kind, confidence) and members(community_id, symbol_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def fan_in_out(nodes: DataFrame, edges: DataFrame, kind: str | None = "CALLS") -> DataFrame:
    """symbol_id, fan_in, fan_out over edges of ``kind`` (None: all), parallel edges counted, zero-filled.

    One pass over the edges: each end is one row, so both counts share a single shuffle.
    """
    own = edges.where(F.col("kind") == kind) if kind else edges
    ends = own.select(F.explode(F.array(F.struct(F.col("target_id").alias("symbol_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_id").alias("symbol_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    sums = ends.groupBy("symbol_id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("symbol_id").join(sums, "symbol_id", "left").select("symbol_id", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"), F.coalesce("fan_out", F.lit(0)).cast("long").alias("fan_out"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol_id, degree: edges at either end, a self-loop counted once."""
    ends = edges.select(F.explode(F.when(F.col("source_id") == F.col("target_id"), F.array("source_id")).otherwise(F.array("source_id", "target_id"))).alias("symbol_id"))
    return nodes.select("symbol_id").join(ends.groupBy("symbol_id").count(), "symbol_id", "left").select("symbol_id", F.coalesce("count", F.lit(0)).cast("long").alias("degree"))


#: (text, weight, condition on the lower-cased name n, fan_in i, fan_out o), in the order in which reasons are told.
ENTRY_RULES = (
    ("main function", 1.0, "n = 'main'"),
    ("module entry", 0.5, "n in ('index', 'mod', '__init__')"),
    ("handler/route pattern", 0.7, "n like '%handle%' or n like '%route%' or n like '%endpoint%'"),
    ("CLI pattern", 0.6, "n like '%cli%' or n like '%cmd%' or n like '%command%'"),
    ("high fan-in (utility)", -0.5, "i > 5"),
    ("zero callers, calls others", 0.5, "i = 0 and o > 0"),
    ("zero callers", 0.2, "i = 0 and o = 0"),
)


def entry_points(nodes: DataFrame, edges: DataFrame, limit: int = 30, least: float = 0.5) -> DataFrame:
    """symbol_id, name, score, reason of the best entry points; ties by symbol_id."""
    seen = nodes.select("symbol_id", "name").join(fan_in_out(nodes, edges, None), "symbol_id")
    seen = seen.select("symbol_id", "name", F.lower("name").alias("n"), F.col("fan_in").alias("i"), F.col("fan_out").alias("o"))
    score = sum((F.when(F.expr(rule), w).otherwise(0.0) for _, w, rule in ENTRY_RULES), F.lit(0.0))
    reason = F.concat_ws(", ", *[F.when(F.expr(rule), F.lit(text)) for text, _, rule in ENTRY_RULES])
    scored = seen.select("symbol_id", "name", F.round(score, 6).alias("score"), reason.alias("reason")).where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "symbol_id").limit(limit)


def labelled(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with the communities of both ends (source_community, target_community)."""
    a = members.select(F.col("symbol_id").alias("source_id"), F.col("community_id").alias("source_community"))
    b = members.select(F.col("symbol_id").alias("target_id"), F.col("community_id").alias("target_community"))
    return edges.join(a, "source_id").join(b, "target_id")


def community_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """source_community, target_community, weight of edges between different communities."""
    return labelled(edges, members).where("source_community <> target_community").groupBy("source_community", "target_community").agg(F.count(F.lit(1)).alias("weight"))


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """community_id, n_members, cohesion: inner edges (half the inner ends, rounded down) over possible pairs; 1 for one member."""
    inner = labelled(edges, members).where("source_community = target_community").select(F.col("source_community").alias("community_id"), F.when(F.col("source_id") == F.col("target_id"), 1).otherwise(2).alias("ends"))
    ends = inner.groupBy("community_id").agg(F.sum("ends").alias("ends"))
    sizes = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("n_members"))
    n = F.col("n_members")
    value = F.when(n <= 1, 1.0).otherwise(F.expr("(coalesce(ends, 0) div 2) / (n_members * (n_members - 1) / 2)"))
    return sizes.join(ends, "community_id", "left").select("community_id", "n_members", F.round(value, 6).alias("cohesion"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """community_id, q over distinct undirected pairs: 2L/2m - (D/2m)^2; a self-loop adds 2 to a degree and nothing to L."""
    pairs = edges.select(F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id")).distinct()
    both = labelled(pairs, members)
    total = pairs.agg(F.count(F.lit(1)).alias("m"))
    parts = both.select(F.explode(F.array(F.struct(F.col("source_community").alias("c"), F.when((F.col("source_community") == F.col("target_community")) & (F.col("source_id") != F.col("target_id")), 1).otherwise(0).alias("l")), F.struct(F.col("target_community").alias("c"), F.lit(0).alias("l")))).alias("e"))
    sums = parts.groupBy(F.col("e.c").alias("community_id")).agg(F.sum("e.l").alias("l"), F.count(F.lit(1)).alias("d"))
    everyone = members.select("community_id").distinct().join(sums, "community_id", "left")
    q = F.expr("coalesce(try_divide(2.0D * l, 2 * m), 0) - coalesce(try_divide(1.0D * d, 2 * m) * try_divide(1.0D * d, 2 * m), 0)")
    return everyone.crossJoin(F.broadcast(total)).select("community_id", F.round(F.coalesce(q, F.lit(0.0)), 6).alias("q"))  # total is one row


def reach(edges: DataFrame, roots: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """root, node, depth (least number of hops, 0 for the root itself) within ``depth`` hops.

    A frontier a round: joined with the edges, cleared of what is known, written, so the plan stays one round long.
    Roots are written first: every round reads them, and they may come from a long plan.
    """
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    step = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())  # read every round
    known = cut(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")))
    front = known
    for d in range(1, depth + 1):
        found = front.join(step, "node").select("root", F.col("next").alias("node")).distinct().join(known.select("root", "node"), ["root", "node"], "left_anti")
        front = cut(found.select("root", "node", F.lit(d).alias("depth")))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def impact(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """root, symbol_id, depth, risk of what reaches a root over any edge; risk is 1/depth."""
    return reach(edges, roots, depth, True).where("depth > 0").select("root", F.col("node").alias("symbol_id"), "depth", F.round(F.try_divide(F.lit(1.0), F.col("depth")), 6).alias("risk"))


def call_chain(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """root, symbol_id, depth, name, path, start_line of what a root calls, itself included."""
    found = reach(edges.where("kind = 'CALLS'"), roots, depth).withColumnRenamed("node", "symbol_id")
    return found.join(nodes.select("symbol_id", "name", "path", "start_line"), "symbol_id").select("root", "symbol_id", "depth", "name", "path", "start_line")


def flows(nodes: DataFrame, edges: DataFrame, entries: DataFrame, depth: int = 20) -> DataFrame:
    """process, step_order, symbol_id, depth, description of the breadth-first flow of each entry.

    Queue order: by level, then by the parent's place, then the newest edge first.
    """
    calls = cut(edges.where("kind = 'CALLS'").groupBy(F.col("source_id").alias("node"), F.col("target_id").alias("next")).agg(F.max("edge_id").alias("edge_id")))  # read every round
    done = cut(entries.select(F.col("symbol_id").alias("root"), F.col("symbol_id").alias("node"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("place")))  # read every round
    front = done
    for d in range(1, depth + 1):
        # a node is queued by its first parent in queue order
        found = front.join(calls, "node").groupBy("root", F.col("next").alias("node")).agg(F.min(F.struct("place", (-F.col("edge_id")).alias("late"))).alias("at"))
        found = found.join(done.select("root", "node"), ["root", "node"], "left_anti")
        place = F.row_number().over(Window.partitionBy("root").orderBy("at", "node")).cast("long")
        front = cut(found.select("root", "node", F.lit(d).alias("depth"), place.alias("place")))
        if front.isEmpty():
            break
        done = done.unionByName(front)
    order = F.row_number().over(Window.partitionBy("root").orderBy("depth", "place")) - 1
    names = nodes.select(F.col("symbol_id").alias("node"), "name")
    out = done.withColumn("step_order", order.cast("long")).join(names, "node")
    heads = nodes.select(F.col("symbol_id").alias("root"), F.concat("name", F.lit("_flow")).alias("process"))
    text = F.concat(F.lit("Step "), F.col("step_order"), F.lit(": "), F.col("name"))
    return out.join(heads, "root").select("root", "process", "step_order", F.col("node").alias("symbol_id"), "depth", text.alias("description"))


#: So many edges one task may hold in memory at once.
FEW_EDGES = 200_000


def _strong(batches):
    """(component, symbol_id) of the strongly connected components of more than one symbol, of all edges at once (Tarjan)."""
    import pyarrow as pa

    step: dict[int, list[int]] = {}
    for batch in batches:
        for a, b in zip(batch.column("source_id").to_pylist(), batch.column("target_id").to_pylist()):
            step.setdefault(a, []).append(b)
            step.setdefault(b, [])
    index, low, held, held_set, out = {}, {}, [], set(), []
    for root in step:
        if root in index:
            continue
        path = [(root, iter(step[root]))]
        index[root] = low[root] = len(index)
        held.append(root)
        held_set.add(root)
        while path:
            node, ways = path[-1]
            for way in ways:
                if way not in index:
                    index[way] = low[way] = len(index)
                    held.append(way)
                    held_set.add(way)
                    path.append((way, iter(step[way])))
                    break
                if way in held_set:
                    low[node] = min(low[node], index[way])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == index[node]:
                    k = len(held) - 1
                    while held[k] != node:
                        k -= 1
                    own = held[k:]
                    del held[k:]
                    held_set.difference_update(own)
                    if len(own) > 1:
                        least = min(own)
                        out.extend((least, x) for x in own)
    yield pa.RecordBatch.from_pydict({"component": pa.array([c for c, _ in out], pa.int64()), "symbol_id": pa.array([x for _, x in out], pa.int64())})


#: So many edges a symbol are enough to find most of a large component.
THIN = 6


def _spread(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass of colours over ``left``: the edges within a colour (source_id, target_id), and (node, color) of one component for each colour.

    The greatest id is spread forward as a colour; what its holder reaches backward within the colour is its strongly connected component.
    """
    color = cut(left.select(F.col("source_id").alias("node"), F.col("source_id").alias("color")).distinct())
    while True:
        came = left.join(color, left["source_id"] == color["node"]).select(F.col("target_id").alias("node"), "color", F.lit(None).cast("long").alias("had"))
        both = color.select("node", "color", F.col("color").alias("had")).unionByName(came)
        after = cut(both.groupBy("node").agg(F.max("color").alias("color"), F.max("had").alias("had")))
        color = after.select("node", "color")
        if after.where("had is null or color > had").isEmpty():
            break
    inside = left.join(color.select(F.col("node").alias("source_id"), F.col("color").alias("c1")), "source_id").join(color.select(F.col("node").alias("target_id"), F.col("color").alias("c2")), "target_id").where("c1 = c2")
    inside = cut(inside.select("source_id", "target_id"))  # both ends have one colour, so the node alone says it
    found = cut(color.where("node = color").select("node", "color"))
    front = found
    while True:
        front = inside.join(front.select(F.col("node").alias("target_id"), "color"), "target_id").select(F.col("source_id").alias("node"), "color").distinct()
        front = cut(front.join(found, "node", "left_anti"))
        if front.isEmpty():
            break
        found = cut(found.unionByName(front))
    return inside, found


def _named(found: DataFrame) -> DataFrame:
    """component, symbol_id of those components of ``found`` that have more than one symbol."""
    sizes = found.groupBy("color").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("component")).where("n > 1")
    return found.join(sizes, "color").select("component", F.col("node").alias("symbol_id"))


def cycles(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """component (its least symbol), symbol_id of every strongly connected component of more than one symbol.

    What is strongly connected by some of the edges is so by all of them.  So one pass of colours over about ``THIN`` edges a symbol (chosen by a
    hash) merges what it finds, and all edges are then laid between the merged symbols, without loops and repeats: of a large component few are
    left.  On these, forward-backward colouring: ends without way in or out are trimmed, each colour's component goes, and so do edges
    between colours.  Every round takes at least one node, and rounds go on until no edge is left; ``few`` edges or less are finished by one task.
    """
    left = cut(edges.select("source_id", "target_id").where("source_id <> target_id"))
    n, sources = left.agg(F.count(F.lit(1)), F.approx_count_distinct("source_id")).first()
    share = round(n / (THIN * max(1, sources)))
    merged = None
    if n > few and share > 1:
        merged = cut(_named(_spread(cut(left.where(F.pmod(F.xxhash64("source_id", "target_id"), F.lit(share)) == 0)))[1]))
        a, b = merged.select(F.col("symbol_id").alias("source_id"), F.col("component").alias("a")), merged.select(F.col("symbol_id").alias("target_id"), F.col("component").alias("b"))
        left = left.join(a, "source_id", "left").join(b, "target_id", "left").select(F.coalesce("a", "source_id").alias("source_id"), F.coalesce("b", "target_id").alias("target_id")).where("source_id <> target_id")
    left = cut(left.distinct())
    out = None
    while True:
        while True:
            kept = left.join(left.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi").join(left.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_semi")
            kept = cut(kept.select("source_id", "target_id"))
            n = kept.count()
            same = n == left.count()
            left = kept
            if same or n <= few:
                break
        if n == 0:
            break
        if n <= few:
            own = cut(left.coalesce(1).mapInArrow(_strong, "component long, symbol_id long"))
            out = own if out is None else out.unionByName(own)
            break
        inside, found = _spread(left)
        own = _named(found)
        out = cut(own if out is None else out.unionByName(own))
        gone = found.select("node")
        left = cut(inside.join(gone.select(F.col("node").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("node").alias("target_id")), "target_id", "left_anti").select("source_id", "target_id"))
    if merged is None:
        return edges.sparkSession.createDataFrame([], "component long, symbol_id long") if out is None else out
    if out is None:
        return merged
    inner = merged.join(out.select(F.col("component").alias("top"), F.col("symbol_id").alias("component")), "component", "left").select(F.coalesce("top", "component").alias("component"), "symbol_id")
    return inner.unionByName(out.join(merged.select("symbol_id"), "symbol_id", "left_anti").select("component", "symbol_id"))


def weak_components(nodes: DataFrame, edges: DataFrame, linked: bool = False) -> DataFrame:
    """symbol_id, component: least id of the weakly connected component; isolated nodes are their own.

    Edges of which an end is no node are left out, unless ``linked`` says that there are none.

    Every node goes to its least neighbour below it, and on to where that one went; then edges are between those alone, without
    loops and repeats, so that each round has far fewer.  Two rounds leave at most half of the nodes that have edges.
    """
    known = nodes.select("symbol_id")
    pairs = edges.select(F.least("source_id", "target_id").alias("low"), F.greatest("source_id", "target_id").alias("high")).where("low < high")
    if not linked:
        pairs = pairs.join(known.withColumnRenamed("symbol_id", "low"), "low", "left_semi").join(known.withColumnRenamed("symbol_id", "high"), "high", "left_semi")
    rounds = []
    while True:
        pairs = cut(pairs)
        if pairs.isEmpty():
            break
        up = cut(pairs.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("up")))
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            after = cut(up.join(over, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            up = after.select("node", "up")
            if after.where("moved").isEmpty():
                break
        rounds.append(up)
        high, low = up.select(F.col("node").alias("high"), F.col("up").alias("b")), up.select(F.col("node").alias("low"), F.col("up").alias("a"))
        moved = pairs.join(high, "high").select("low", "b").distinct().join(low, "low", "left").select(F.coalesce("a", "low").alias("a"), "b")
        pairs = moved.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    top = None
    for up in reversed(rounds):
        if top is not None:
            last = top.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(last, "up", "left").select("node", F.coalesce("top", "up").alias("up")).unionByName(top)
        top = cut(up)
    if top is None:
        return known.select("symbol_id", F.col("symbol_id").alias("component"))
    return known.join(top.withColumnRenamed("node", "symbol_id"), "symbol_id", "left").select("symbol_id", F.coalesce("up", "symbol_id").alias("component"))
