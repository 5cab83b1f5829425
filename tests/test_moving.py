"""Local moving and merging from files: what the whole graph in memory gives, with little memory."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from quarry.operators import communities, moving


def near(pairs, held=moving.HELD, stretch=moving.STRETCH, batch=7):
    a, b = np.array(pairs, dtype=np.int64).T
    other = a != b
    x, y = np.concatenate((a, b[other])), np.concatenate((b, a[other]))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    return moving.Neighbours(((x[k : k + batch], y[k : k + batch]) for k in range(0, len(x), batch)), held, stretch)


def graph(seed):
    rng = random.Random(seed)
    n = rng.randrange(2, 80)
    if seed % 5 == 0:  # a chain, and a hub of more neighbours than are held
        return [(k, k + 1) for k in range(n)] + [(0, rng.randrange(n)) for _ in range(n)]
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 4 * n))]


@pytest.mark.parametrize("seed", range(60))
def test_moving_and_merging_are_exact(seed):
    """However little is held at once and however soon the symbols of a stretch are decided one after the other."""
    rng, pairs = random.Random(-seed), graph(seed)
    ids, m = sorted({x for p in pairs for x in p}), float(len(pairs)) * rng.choice([1, 5])
    nb = near(pairs, rng.choice([1, 3, 8, 1000]), rng.choice([1, 3, 8, 1000]), rng.choice([1, 7, 1000]))
    assert nb.ids.tolist() == ids
    own = moving.moved(nb, m, communities.SWEEPS, rng.choice([1, 2, moving.TRIES]))
    held = communities.local_moving(ids, pairs, m)
    assert [ids[c] for c in own] == [held[x] for x in ids]
    least = {}
    for x in ids:
        least.setdefault(held[x], x)
    held = {x: least[held[x]] for x in ids}
    sizes, ties = Counter(held.values()), Counter()
    for a, b in pairs:
        if held[a] != held[b]:
            ties[tuple(sorted((held[a], held[b])))] += 1
    group = {c: c for c in sizes}
    parts = np.array(list({frozenset(p) for p in pairs}), dtype=object)
    root = {x: x for x in ids}
    for _ in ids:
        for p in parts:
            low = min(root[x] for x in p)
            root.update(dict.fromkeys(p, low))
    end, n = min(Counter(root.values()).values()), len(sizes)
    for _, fell, changed, to in moving.passes(nb, own, end):
        group.update(zip(changed.tolist(), to.tolist()))
        n -= fell
        assert n == len(set(group.values()))
    want = communities.merge(sizes, ties, 1)
    assert {frozenset(c for c in group if group[c] == g) for g in group.values()} == {frozenset(c for c in want if want[c] == g) for g in want.values()}


def test_a_task_holds_no_edges():
    """Two hundred thousand edges of two thousand symbols take less memory than their ends alone would."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2000, 200_000), rng.integers(0, 2000, 200_000)
    x, y = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    tracemalloc.start()
    nb = moving.Neighbours(((x[k : k + 10_000], y[k : k + 10_000]) for k in range(0, len(x), 10_000)), 1 << 13, 1 << 12)
    own = moving.moved(nb, float(len(a)), 2)
    merged = list(moving.passes(nb, own, len(nb)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(own) == 2000 and merged and most < x.nbytes + y.nbytes


def test_communities_make_no_group_of_a_component(spark, monkeypatch):
    """No component's edges are one group in Python memory, and an edge to what is no symbol is none."""
    plans, cut = [], communities.cut
    monkeypatch.setattr(communities, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    nodes = spark.createDataFrame([(k,) for k in range(42)], "symbol_id long")
    edges = lambda pairs: spark.createDataFrame([(k, a, b, "CALLS", 1.0) for k, (a, b) in enumerate(pairs)], "edge_id long, source_id long, target_id long, kind string, confidence double")
    whole = [(a, b) for a in range(40) for b in range(a)]
    got = communities.communities(nodes, edges(whole + [(3, 999), (998, 4)])).collect()
    assert len(got) == 42 and sorted(map(tuple, got)) == sorted(map(tuple, communities.communities(nodes, edges(whole)).collect()))
    assert any("MapInArrow" in p for p in plans) and not any("FlatMap" in p for p in plans)
