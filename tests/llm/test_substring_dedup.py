import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import induced
from quarry.llm.substring_dedup import remove_repeats


def brute(rows, window):
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for r, raw in enumerate(raws):
        for s in range(len(raw) - window + 1):
            key = raw[s : s + window]
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            if seen[raw[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def run(frame, window=400, **kw):
    rows = remove_repeats(frame, window, **kw).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(b - a for a, b in r.spans), len(r.spans), r.kept_sha256) for r in rows), key=str)


def passages(seed=5):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    shared = [text(n) for n in (15, 25, 40, 90)]
    rows = []
    for k in range(60):
        parts = [rng.choice(shared)[rng.randint(0, 6) :] if rng.random() < 0.5 else text(rng.randint(0, 40)) for _ in range(rng.randint(0, 6))]
        rows.append((k, "".join(parts)))
    return rows + [(100, "a" * 70), (101, "ab" * 40), (102, rows[3][1]), (103, rows[3][1])]


@pytest.mark.parametrize("large", [1000, 1])
def test_small_windows(spark, large):
    rows = passages()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(frame, 20, gram=4, cell=5, large=large) == brute(rows, 20)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text[:3000] if r.text else r.text) for r in odd.collect()]
    frame = odd.sparkSession.createDataFrame(rows, "doc_id long, text string")
    assert run(frame, 16, gram=4, cell=4) == brute(rows, 16)
    assert run(empty) == [] and len(run(odd)) == odd.count()


def test_whole_table(documents):
    assert run(documents) == brute([(r.doc_id, r.text) for r in documents.collect()], 400)


def test_queues_of_production_size_touch_the_disk(monkeypatch):
    rng = np.random.default_rng(5)
    common = [rng.integers(97, 123, 130, dtype=np.uint8).tobytes() for _ in range(40)]
    own = [rng.integers(97, 123, 130, dtype=np.uint8).tobytes() if k % 3 else common[k % 40] for k in range(30_000)]
    pieces = [(x[:64], k % 50, x[64 : 64 + k % 60]) for k, x in enumerate(own)]
    counts = [1 + min(64, k % 60) for k in range(len(own))]
    written = []
    push = induced.RangeQueue.push
    monkeypatch.setattr(induced.RangeQueue, "push", lambda self, places, ranges: (push(self, places, ranges), written.append(len(self.spilled)))[0])
    got = induced.repeated_starts(pieces, counts, 64)
    assert max(written) > 0
    seen = {}
    for (a, m, b), n in zip(pieces, counts):
        for s in range(n):
            key = (a[s:], m, b[: 64 - len(a[s:]) - 1])
            seen[key] = seen.get(key, 0) + 1
    for (a, m, b), n, again in zip(pieces, counts, got):
        assert [seen[(a[s:], m, b[: 64 - len(a[s:]) - 1])] > 1 for s in range(n)] == again.tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=50), st.integers(1, 12), st.sampled_from([1, 2, 96]), st.sampled_from([1, 1 << 20]))
def test_suffixes_are_in_order(symbols, depth, ranges, limit):
    induced.RANGES, before = ranges, induced.RANGES
    try:
        text = np.array(symbols)
        order = induced.suffix_order(text, depth, limit=limit)  # a limit of one byte spills every queue
        keys = [tuple(symbols[i : i + depth]) for i in order]
        assert sorted(order.tolist()) == list(range(len(symbols))) and keys == sorted(keys)
        whole = induced.suffix_order(text, 1 << 30, limit=limit).tolist()
        assert whole == sorted(whole, key=lambda i: symbols[i:])
    finally:
        induced.RANGES = before
