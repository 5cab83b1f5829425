import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import rule_ensemble as R


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def corpus(n=500):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.3
        ws = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 90))]
        if bad:
            ws = [w + "###" for w in ws] if k % 2 else ws[:6] * 12
        rows.append((k, " ".join(ws)))
        if k % 4:
            labels.append((k, int(not bad)))
    return rows, labels


def test_statistics():
    names = dict(zip(R.STATISTICS, R.measure("Aa bb #1\nAa bb #1\n\nÄé! zz".encode())))
    assert names["words"] == math.log1p(8) and names["distinct_words"] == 5 / 8 and names["lines"] == math.log1p(3) and names["repeated_lines"] == 1 - 2 / 3
    assert math.isclose(names["repeated_windows"], 1 - 5 / 6) and names["top_word"] == 2 / 8 and names["exclaims"] == 1 / 8
    assert names["symbols"] == 2 / 17 and names["digits"] == 2 / 17 and names["foreign"] == 2 / 17 and names["capitals"] == 2 / 12
    assert R.measure(None) == R.measure(b" \n\t") == [0.0] * len(R.STATISTICS)
    # stretches do not matter
    text = " ".join(f"word{k % 977}" for k in range(300_000)).encode()
    whole, size = R.measure(text), R.stretches.__defaults__
    R.stretches.__defaults__ = (1 << 30,)
    try:
        assert R.measure(text) == whole
    finally:
        R.stretches.__defaults__ = size


def test_rules_of_a_printed_tree():
    printed = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5, numClasses=2, numFeatures=17
  If (feature 0 <= 1.5)
   If (feature 9 <= 2.5E-4)
    Predict: 1.0
   Else (feature 9 > 2.5E-4)
    Predict: 0.0
  Else (feature 0 > 1.5)
   If (feature 0 <= 3.0)
    Predict: 0.0
   Else (feature 0 > 3.0)
    Predict: 1.0
"""
    inf = math.inf
    assert R.tree_rules(printed) == {
        (("words", -inf, 1.5),),
        (("words", 1.5, inf),),
        (("symbols", -inf, 2.5e-4), ("words", -inf, 1.5)),
        (("symbols", 2.5e-4, inf), ("words", -inf, 1.5)),
        (("words", 1.5, 3.0),),
        (("words", 3.0, inf),),
    }


def test_held_out_accuracy_and_compiled_scores(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in R.score_quality(docs, marks).collect()}
    assert len(out) == len(rows) and all(out[k].held_out == held(k) and out[k].predicted == (out[k].score >= 0.3) for k, _ in rows)
    test = [(out[k], y) for k, y in labels if held(k)]
    assert np.mean([r.predicted == y for r, y in test]) > 0.95
    # labels of held-out rows never matter, and the fit is the same again
    flipped = spark.createDataFrame([(k, 1 - y if held(k) else y) for k, y in labels], "doc_id long, quality int")
    ensemble = R.fit(docs.repartition(7), flipped)
    assert 0 < len(ensemble.rules) < 200
    for k, text in rows:
        x = dict(zip(R.STATISTICS, R.measure(text.encode())))
        z = ensemble.base + sum(w for rule, w in ensemble.rules if all(low < x[name] <= high for name, low, high in rule))
        assert abs(out[k].score - 1 / (1 + math.exp(-z))) < 1e-6


def test_odd_rows(spark, odd, empty):
    odd = odd.withColumns({"quality": F.lit(9), "words": F.lit("w"), "_q_id": F.lit(1)})
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (7, 1), (None, 1), (99, None)], "doc_id long, quality int")
    for marks in (labels, labels.limit(0)):
        out = R.score_quality(odd, marks).collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
        assert next(r for r in out if r.doc_id is None).held_out is False
        assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1  # null, empty and blank alike
    assert R.score_quality(empty, labels).count() == 0
