import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quarry.llm import resampling
from quarry.llm.queries import op12_bucket_resampling
from quarry.llm.resampling import Buckets, features, resample
from quarry.llm.stretches import stretches


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(text, longest):
    ws = words(text)
    return [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def brute(docs, target, percent, least, buckets, longest, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in runs(x, longest)), Counter(bucket(f) for _, x in target for f in runs(x, longest))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for doc, text in docs:
        fs = runs(text, longest)
        weight = sum(math.floor(1000 * math.log(float(t[b] + 1) * all_s / (float(s[b] + 1) * all_t))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(words(text)), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = [(*r, k) for k, r in enumerate(able[: percent * len(able) // 100], 1)]
    return drawn, out


def held(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_equals_brute_force(spark, longest):
    rng = random.Random(longest)
    pool = ["alpha", "Beta", "GAMMA", "naïve", "Ünder", "x1", "12", "ß", "日本"]
    make = lambda n: "".join(rng.choice(pool) + rng.choice([" ", "-", "\n", "... "]) for _ in range(n))
    docs = [(k, make(rng.randint(0, 60))) for k in range(150)] + [(None, make(40)), (7, make(40)), (7, make(41)), (200, None), (201, " .\n")]
    target = [(k, "alpha beta naïve " * 5 + make(5)) for k in range(6)] + [(9, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = resample(frame, spark.createDataFrame(target, "item_id long, text string"), percent=30, buckets=257, longest=longest)
    drawn, rows = brute(docs, target, 30, 20, 257, longest, 2024)
    assert sorted((tuple(r) for r in got.where("rank is not null").collect()), key=lambda r: r[5]) == drawn
    assert held(got.drop("rank")) == sorted(rows, key=str)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frame = op12_bucket_resampling(spark, sf_dir)
    want = con.sql(resampling.SQL)
    assert frame.columns == want.columns and held(frame) == sorted(want.fetchall(), key=str)


def test_stretches_keep_every_word():
    text = b" ".join(b"w%d" % k for k in range(3000)) + b" " + b"x" * 5000 + b" end"
    for size in (1, 7, 100, 1 << 20):
        parts = list(stretches(text, (b" ", b"\n"), size))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
    assert list(stretches(b"", (b" ",))) == []


def test_runs_cross_stretches(monkeypatch):
    monkeypatch.setattr(resampling, "stretches", lambda text, marks: stretches(text, marks, 16))
    text = " ".join(f"w{k}" for k in range(200))
    n_words = np.zeros(2, np.int64)
    got = [(int(k), int(b)) for at, own in features([None, text.encode()], Buckets(1 << 30), 3, n_words) for k, b in zip(at, own)]
    assert sorted(got) == sorted((1, zlib.crc32(f.encode()) % (1 << 30)) for f in runs(text, 3)) and n_words.tolist() == [0, 200]


def test_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([(1, "lang lang the same text")], "item_id long, text string")
    out = resample(odd, target, percent=100).collect()
    assert len(out) == odd.count() and {r.doc_id: r.n_features for r in out}[9] == 30_000
    assert sorted(r.rank for r in out if r.rank) == [1] and all((r.weight, r.rank) == (0, None) for r in out if not r.n_words)
    assert resample(empty, target).count() == 0
    flat = resample(odd, target.limit(0)).collect()
    assert len(flat) == odd.count()
