import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import sharding
from quarry.llm.sharding import shard_documents


def check(frame, rows, shards):
    out = frame.collect()
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in out) == want
    loads = np.zeros(shards)
    for s in range(shards):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        loads[s] = sum(r.size for r in own)
    assert all(0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None for r in out)
    return loads, out


def test_whole_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    loads, out = check(shard_documents(documents, 4), rows, 4)
    assert (loads.max() - loads.min()) / loads.mean() < 0.02
    home = {}
    for r in out:
        home.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in home.values())


def test_hot_groups_are_cut_and_numbered(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PER_BUCKET", 16)
    rows = [(k, "hot text " * 20) for k in range(300)] + [(1000 + k, f"own {k} " * (k % 23 + 1)) for k in range(400)]
    loads, out = check(shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8), rows, 8)
    assert (loads.max() - loads.min()) / loads.mean() < 0.05 and len({r.shard for r in out if r.doc_id < 300}) > 1


def test_odd_rows(odd, empty):
    check(shard_documents(odd, 3), [(r.doc_id, r.text) for r in odd.collect()], 3)
    assert shard_documents(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 5))
def test_each_goes_where_the_dot_product_is_highest(sizes, shards):
    v = np.array([[s, s / 6, 1] for s in sizes], float)
    capacity = v.sum(0) / shards
    got = sharding.place(v, np.tile(capacity, (shards, 1)), capacity)
    residual = np.tile(capacity, (shards, 1))
    for x, s in zip(v, got):
        dots = (residual * sharding.WEIGHTS / capacity**2) @ x
        assert dots[s] >= dots.max() - 1e-9
        residual[s] -= x
