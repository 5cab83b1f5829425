import random
import re
import time
import zlib

import numpy as np

from quarry.llm.toxicity import Model, _shouts, features_of, label_model, least_gain, score_documents


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def corpus(n=900):
    rng = random.Random(7)
    plain = [f"word{k}" for k in range(300)]
    bad = ["grumbelnd", "zilchish", "snarkoid", "idiot", "moron"]
    rows, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice(plain) for _ in range(60)]
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(60), rng.choice(bad) + rng.choice(["", "", "", "er", "ster"]))
        rows.append((k, " ".join(words)))
        if k % 3:
            labels.append((k, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in score_documents(docs, marks).collect()}
    assert all(out[k].held_out == held(k) for k, _ in rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    test = [(out[k], t) for k, t in labels if held(k)]
    assert np.mean([r.predicted == t for r, t in test]) > 0.95
    worst_toxic = np.quantile([r.score for r, t in test if t], 0.1)
    assert worst_toxic > np.quantile([r.score for r, t in test if not t], 0.95)
    # labels of held-out rows never matter
    flipped = spark.createDataFrame([(k, 1 - t if held(k) else t) for k, t in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in score_documents(docs, flipped).collect()}
    assert all(abs(again[k] - r.score) < 1e-9 for k, r in out.items())


def test_gain_follows_the_number_of_features():
    rng = np.random.default_rng(1)
    chance, real = rng.standard_normal(20_000) ** 2, rng.uniform(25, 200, 300)
    gains = np.concatenate([chance[::2], real])  # half of those that chance gives lie below the rate and have no gain
    steps, counts = np.unique(np.floor(gains * 4).astype(int), return_counts=True)
    least = least_gain(list(zip(steps.tolist(), counts.tolist())), 20_300)
    assert (chance[::2] >= least).sum() <= 0.1 * 300 and (real >= least).all()
    assert least_gain([(4, 10)], 1000) == float("inf") and least_gain([], 0) == float("inf")


def test_shouts_are_found_in_linear_time():
    want = re.compile(r"\b[^\W\d_a-zß-ÿ]{4,}\b.*!{2,}")
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["LOUD", "ÄÖÜß", "ÉCLAT", "abc", "!", "!!", " ", "\n", "_", "1", "LOu"]) for _ in range(rng.randint(0, 12)))
        assert _shouts(text) == bool(want.search(text)), text
    start = time.perf_counter()
    assert not _shouts("SHOUTED WORDS! " * 200_000) and not _shouts("!!" + "SHOUTED WORDS! " * 200_000) and _shouts("SHOUTED WORDS! " * 200_000 + "!!")
    assert time.perf_counter() - start < 20  # three texts of 3 MB


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(200_000) < 0.2
    hit, false = np.array([0.9, 0.7, 0.6, 0.5, 0.8]), np.array([0.05, 0.1, 0.02, 0.2, 0.1])
    votes = (rng.random((len(y), 5)) < np.where(y[:, None], hit, false)).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # a copy of the first voter
    model = Model([], 0.2)
    label_model(model, len(y), votes.sum(0), votes.T @ votes)
    assert np.allclose(model.hit[1:5], hit[1:5], atol=0.08) and np.allclose(model.false[1:5], false[1:5], atol=0.05)
    assert model.count[0] < 0.8 and model.count[2] > 0.9


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (None, 1), (99, None)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for marks in (labels, none):
        out = score_documents(odd, marks).collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
        assert next(r for r in out if r.doc_id is None).held_out is False
    assert score_documents(empty, labels).count() == 0
    alone = spark.createDataFrame([(1, "you are a stupid idiot and a moron"), (2, "a fine day")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_documents(alone, none).collect()}
    assert got[1] > got[2]
    assert "idio*" in features_of("Idiots")[0]
