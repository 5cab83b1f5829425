import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import ngram_join as nj
from quarry.llm.shingles import linked, shingle_sets


def words(text):
    out, own = [], ""
    for c in (text or "") + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            if own:
                out.append(own)
            own = ""
        else:
            own += c.lower() if "A" <= c <= "Z" else c
    return out


def brute(rows):
    sets = []
    for _, text in rows:
        ws = words(text)
        n = min(5, len(ws))
        sets.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(frame):
    return sorted((tuple(r) for r in nj.ngram_join(frame).collect()), key=str)


def near_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 12, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[rng.randint(0, 5) :]
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(len(rows) + i, " ".join(rng.choice(vocabulary) for _ in range(20)) + " " + passage) for i in range(40)]
    return rows


def test_equals_brute_force_on_families_and_a_common_passage(spark):
    rows = near_rows()
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_crowds_are_resolved(spark, monkeypatch):
    monkeypatch.setattr(nj, "SMALL", 2)
    monkeypatch.setattr(nj, "SEEDS", 2)
    rows = near_rows()
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_whole_table(documents):
    assert run(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(odd, empty):
    assert run(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert run(empty) == []


def test_crowds_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(nj, "SMALL", 2)
    monkeypatch.setattr(nj, "TILE", 3)
    rows = near_rows()
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 8, 20, 61, 150, 700])
def test_linked_sets_always_share_a_key(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        drop, add = rng.integers(0, size // 4 + 1), rng.integers(0, size // 3 + 1)
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if linked(a, b):
            for seed in (0, 1, 3):
                keys, owner = nj.sketch_keys([a, b], seed)
                assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size


def test_short_sequences_differ_by_length():
    sets = shingle_sets(pa.array(["a b c", None, "a b c d e f", "", " \n", "A\tb  C ", "a b", "abc"]))
    assert [len(s) for s in sets] == [1, 0, 2, 0, 0, 1, 1, 1] and sets[0] == sets[5] and len({int(s[0]) for s in sets if len(s)}) == 4
