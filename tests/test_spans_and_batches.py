"""Span joins against brute force, complexity from lines, and batches that live in a stream's state."""

import datetime
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import layout, metrics, spans
from quarry.sources import code
from quarry.streaming import batching


def test_pieces_cover_every_span(spark):
    rng = random.Random(1)
    rows = [(a, a + rng.randint(0, 900)) for a in range(0, 400)] + [(5, 4), (None, 3), (3, None)]
    out = spark.createDataFrame(rows, "lo long, hi long").withColumn("p", spans.pieces(F.col("lo"), F.col("hi"), 10)).collect()
    for r in out:
        held = sorted(x for q in r.p or () for x in range(q.at << q.level, (q.at + 1) << q.level))
        assert held == (list(range(r.lo, r.hi + 1)) if r.lo is not None and r.hi is not None else [])
        assert len(r.p or ()) <= 20


def test_innermost_equals_brute_force(spark):
    rng = random.Random(2)
    held = [(rng.choice("ab"), a := rng.randint(0, 60), a + rng.choice([0, 1, 3, 10, 40, -1]), f"s{k}") for k in range(60)] + [(None, 1, 5, "x"), ("a", None, 5, "y")]
    points = [(rng.choice("abc"), rng.randint(0, 110), k) for k in range(150)] + [(None, 3, 200), ("a", None, 201)]
    got = spans.innermost(spark.createDataFrame(points, "path string, at long, k int"), spark.createDataFrame(held, "path string, lo long, hi long, name string"), ["name"])
    want = {}
    for path, at, k in points:
        around = [(hi - lo, lo, name) for p, lo, hi, name in held if p == path and p and lo is not None and at is not None and lo <= at <= hi]
        want[k] = min(around)[2] if around else None
    assert {r.k: r.inner and r.inner.name for r in got.collect()} == want and got.count() == len(points)
    empty = spark.createDataFrame([], "path string, lo long, hi long, name string")
    assert spans.innermost(spark.createDataFrame(points, "path string, at long, k int"), empty, ["name"]).where("inner is null").count() == len(points)


def test_callers_are_the_innermost_definitions():
    text = "class A {\n  run() {\n    one();\n    function inner() {\n      two();\n    }\n    three();\n  }\n}\nfour();\n"
    out = code.parse_lines(text, "typescript")
    assert {(c["caller"], c["callee"]) for c in out["calls"]} >= {("run", "one"), ("run", "three"), (code.MODULE, "four")}
    spans_ = [(s["name"], s["start_line"], s["end_line"]) for s in out["symbols"]]
    for c in out["calls"]:
        around = [(b - a, k, n) for k, (n, a, b) in enumerate(spans_) if a <= c["line"] <= b]
        assert c["caller"] == (min(around)[2] if around else code.MODULE)


def test_complexity_from_lines(spark):
    texts = spark.createDataFrame([("a.rs", "fn f() {\n if a {\n  1\n }\n if b && c {\n  2\n }\n 3\n}\nfn g() {\n for x in y {}\n}"), ("b.rs", None)], "path string, content string")
    symbols = spark.createDataFrame([(1, "a.rs", 1, 9), (2, "a.rs", 10, 12), (3, "a.rs", 1, 12), (4, "b.rs", 1, 50), (5, "none.rs", 5, 4)], "symbol_id long, path string, start_line long, end_line long")
    own = metrics.symbol_complexity(texts, symbols)
    assert {r.symbol_id: r.complexity for r in own.collect()} == {1: 4.0, 2: 2.0, 3: 5.0, 4: 6.0, 5: 1.0}
    files = metrics.file_complexity(spark.createDataFrame([("a.rs",), ("b.rs",), ("c.rs",)], "path string"), own)
    assert {r.path: round(r.complexity, 6) for r in files.collect()} == {"a.rs": round(11 / 3, 6), "b.rs": 6.0, "c.rs": 1.0}


T0 = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def greedy(rows, size, millis):
    """Batches of (millisecond, id) rows of one shard, in order."""
    out = []
    for at, k in sorted(rows):
        if not out or len(out[-1]) == size or at >= out[-1][0][0] + millis:
            out.append([])
        out[-1].append((at, k))
    return out


def bring(spark, folder, name, rows):
    frame = spark.createDataFrame([(k, T0 + datetime.timedelta(milliseconds=at), f"e{k}") for at, k in rows], "event_id long, ts timestamp, what string")
    frame.coalesce(1).write.mode("append").parquet(f"file://{folder}/{name}")


def test_batches_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    times = sorted(rng.sample(range(0, 60_000), 160))
    rows = [(at, k) for k, at in enumerate(times)]
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    before = spark.conf.get(batching.STORE, None)
    for turn in range(2):
        bring(spark, source, "events.parquet", rows[turn * 80 : (turn + 1) * 80])
        stream = spark.readStream.schema("event_id long, ts timestamp, what string").parquet(f"file://{source}/events.parque[t]")
        made = batching.batched(stream, F.col("event_id") % 3, size=7, seconds=2)
        assert batching.write(made, out, f"file://{tmp_path}/mark", available_now=True).awaitTermination(120)
    assert spark.conf.get(batching.STORE, None) == before
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault((r.shard, r.batch), []).append((r.place, r.event_id, r.what))
    for shard in range(3):
        want = greedy([r for r in rows if r[1] % 3 == shard], 7, 2000)
        mine = [[e for _, e, _ in sorted(got[shard, b])] for b in range(sum(k[0] == shard for k in got))]
        # all but what is still open: the batches whose time the last event has not passed
        assert mine == [[k for _, k in b] for b in want if len(b) == 7 or b[0][0] + 2000 <= times[-1]]


def test_batches_take_rows_in_parts():
    """A shard's rows of a micro-batch are not held, only a part and the open batch: what closed is handed on before the next part is read."""
    step = batching.Batches(["k"], "k bigint", 5, 10**9, "event")
    step.handle = type("Handle", (), {"registerTimer": lambda *_: None, "deleteTimer": lambda *_: None})()
    step.rows = type("Held", (), {"get": lambda _: [], "put": lambda *_: None, "clear": lambda _: None})()
    step.place = type("Place", (), {"get": lambda _: None, "update": lambda *_: None})()
    read = []
    part = lambda ks: pd.DataFrame({"q_ms": ks, "q_id": ks, "q_row": [{"k": k} for k in ks]})
    source = (read.append(k) or part(range(k, k + 8)) for k in range(0, 800, 8))
    out = step.handleInputRows((0,), source, None)
    first = next(out)
    assert read == [0] and [r["k"] for r in first["row"]] == [0, 1, 2, 3, 4] and first["place"].tolist() == [0, 1, 2, 3, 4]
    assert [r["k"] for f in out for r in f["row"]] == list(range(5, 800))
    with pytest.raises(RuntimeError):
        list(step.handleInputRows((0,), iter([part([2, 1])]), None))


def test_batches_by_arrival(spark, tmp_path):
    """By the processing clock a timer hands on the last batch without another event coming."""
    bring(spark, tmp_path / "in", "events.parquet", [(k * 10_000, k) for k in range(20)])
    stream = spark.readStream.schema("event_id long, ts timestamp, what string").parquet(f"file://{tmp_path}/in/events.parque[t]")
    query = batching.write(batching.batched(stream, F.lit(0), size=8, seconds=1, clock="processing"), f"file://{tmp_path}/out", f"file://{tmp_path}/mark", seconds=1)
    try:
        end, rows = time.monotonic() + 90, []
        while time.monotonic() < end and len(rows) < 20 and query.isActive:
            time.sleep(1)
            rows = spark.read.schema("shard long, batch long, place int, event_id long").parquet(f"file://{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
    finally:
        query.stop()
    assert [(r.batch, r.place) for r in sorted(rows, key=lambda r: r.event_id)] == [(k // 8, k % 8) for k in range(20)]


def test_tree_positions(spark):
    """Files are stacked, folders stand between the first and the last of them."""
    files = spark.createDataFrame([("b.py",), ("a/x.py",), ("a/c/y.py",), ("a/c/a-long-name-of-a-file.py",)], "path string")
    got = {r.path: (r.depth, r.x, r.y, r.width) for r in layout.tree_positions(files).collect()}
    assert {p: v[2] for p, v in got.items()} == {"a/c/a-long-name-of-a-file.py": 20, "a/c/y.py": 62, "a/x.py": 104, "b.py": 146, "a/c": 41, "a": 62, "": 83}
    assert got["a/c"][:2] == (2, 360) and got[""] == (0, 0, 83, 120.0) and got["a/c/a-long-name-of-a-file.py"][3] == len("a-long-name-of-a-file.py") * 7.5 + 32 and got["b.py"][3] == 140.0
    assert layout.tree_positions(files.limit(0)).count() == 0
