"""Quality by a sparse ensemble of rules.

1. Statistics of each whole text (shares of kinds of characters, repeats, lengths) are measured once, over Arrow batches.
2. Trees of small depth are grown on the labelled rows; every path from a root to a node is a rule, a conjunction of
   bounds on statistics.
3. A logistic model with an L1 penalty weighs the rules; most get no weight and go.
4. The rules left are compiled into one Spark column over the statistics, which scores all rows.

Only rows whose crc32(doc_id as text) mod 5 is not 0 teach, from at most ``FIT_ROWS`` labelled documents (those with the least
hash of doc_id).  Labels, language, source and doc_id are never part of a rule.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stretches import stretches
from .tokens import slices
from .toxicity import held_out
from .workspace import Workspace

FIT_ROWS, TREES, DEPTH, PENALTY, KEEP_SCORE, TAUGHT_PARTS = 20_000, 40, 3, 0.002, 0.3, 8
STATISTICS = ("words", "word_bytes", "distinct_words", "repeated_windows", "top_word", "longest_word", "lines", "line_words", "repeated_lines", "symbols", "capitals", "digits", "exclaims", "stops", "bars", "foreign", "bytes_entropy")
_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def _class(characters: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(characters, np.uint8), minlength=256).astype(bool)


_SYMBOLS, _CAPITALS, _DIGITS, _EXCLAIMS, _STOPS, _BARS = map(_class, (b"#*$%&<>@^~_=+{}[]\\", bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b".,;:", b"|/-"))
_LETTERS = _CAPITALS | _class(bytes(range(97, 123))) | _class(bytes(range(0xC0, 0x100)))
_FOREIGN, _LATER, _BLANKS = _class(bytes(range(0xC0, 0x100))), _class(bytes(range(0x80, 0xC0))), _class(b"".join(_SPACES))


class _Numbers(dict):
    """key -> its number in the order of first sight."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


def measure(text: bytes | None) -> list[float]:
    """``STATISTICS`` of a whole text, read a stretch at a time; an empty or null text has zeros."""
    text = text or b""
    numbers, own, longest, held = _Numbers(), [], 0, np.zeros(256, np.int64)
    for part in stretches(text, _SPACES):
        found = part.split()
        own.append(np.array(list(map(numbers.__getitem__, found)), np.int64))
        longest = max(longest, max(map(len, found), default=0))
        held += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
    words = np.concatenate(own) if own else np.zeros(0, np.int64)
    seen, lines = set(), 0
    for part in stretches(text, (b"\n",)):
        full = [x for line in part.split(b"\n") if (x := line.strip())]
        lines += len(full)
        seen.update(full)
    n, chars = len(words), int(held[~_LATER].sum())
    if not n:
        return [0.0] * len(STATISTICS)
    solid, letters = chars - int(held[_BLANKS].sum()), max(1, int(held[_LETTERS].sum()))
    again = 0.0
    if n > 2:
        mixed = words.astype(np.uint64)
        keys = (mixed[:-2] * np.uint64(0x9E3779B97F4A7C15) + mixed[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + mixed[2:]  # wraps: a hash of the window
        again = 1 - len(np.unique(keys)) / len(keys)
    share = held[held > 0] / len(text)
    return [
        math.log1p(n),
        (len(text) - int(held[_BLANKS].sum())) / n,
        len(numbers) / n,
        again,
        int(np.bincount(words).max()) / n,
        math.log1p(longest),
        math.log1p(lines),
        math.log1p(n / lines),
        1 - len(seen) / lines,
        int(held[_SYMBOLS].sum()) / solid,
        int(held[_CAPITALS].sum()) / letters,
        int(held[_DIGITS].sum()) / solid,
        int(held[_EXCLAIMS].sum()) / n,
        int(held[_STOPS].sum()) / n,
        int(held[_BARS].sum()) / n,
        int(held[_FOREIGN].sum()) / solid,
        float(-(share * np.log(share)).sum()),
    ]


def statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the statistics of ``text``, as ``_q_`` columns."""
    rows = docs.select(*keep, F.col("text").cast("binary").alias("_q_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"_q_{s} double" for s in STATISTICS])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            last = batch.num_columns - 1
            values = np.array([measure(t) for t in batch.column(last).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(last)] + [pa.array(v) for v in values.T], [batch.schema.names[k] for k in range(last)] + [f"_q_{s}" for s in STATISTICS])

    return rows.mapInArrow(run, schema)


#: A rule: (statistic, above, at most), sorted by statistic; an open end is an infinity.
Rule = tuple[tuple[str, float, float], ...]


def tree_rules(printed: str) -> set[Rule]:
    """The rules of every node but the root of a tree as the library prints it (``toDebugString``)."""
    rules, path = set(), []
    for line in printed.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, STATISTICS[int(m[2])], m[3] == ">", float(m[4]))]
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, over, at in path:
            low, high = bounds.get(name, (-math.inf, math.inf))
            bounds[name] = (max(low, at), high) if over else (low, min(high, at))
        rules.add(tuple((name, *bounds[name]) for name in sorted(bounds)))
    return rules


def condition(rule: Rule) -> Column:
    """A rule as a boolean column over the statistics."""
    parts = [F.col(f"_q_{name}") > F.lit(low) for name, low, _ in rule if low > -math.inf] + [F.col(f"_q_{name}") <= F.lit(high) for name, _, high in rule if high < math.inf]
    return reduce(Column.__and__, parts)


@dataclass
class Ensemble:
    base: float = 0.0  # log odds where no rule holds
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """Chance of label 1 as one column over the statistics."""
        z = reduce(Column.__add__, [F.when(condition(rule), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules], F.lit(self.base))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """Ensemble of ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; held-out rows are left out here.

    Conflicting labels of one doc_id count as the larger; of rows that share a doc_id the one with the least statistics teaches.
    Without both labels there is no rule, and the score is the smoothed share of label 1.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    space = Workspace(docs.sparkSession, "rules")
    key = F.col("doc_id").cast("long").alias("_q_id")
    marks = labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id")).groupBy(key).agg(F.max("quality").cast("double").alias("_q_label"))
    marks = space.table(marks.orderBy(F.xxhash64("_q_id"), "_q_id").limit(fit_rows), "marks")  # so broadcasting them is bounded
    rows = docs.select(key, "text").join(F.broadcast(marks), "_q_id")
    values = [f"_q_{s}" for s in STATISTICS]
    once = statistics(rows, [F.col("_q_id"), F.col("_q_label")]).groupBy("_q_id").agg(F.min(F.struct("_q_label", *values)).alias("v")).select("_q_id", "v.*")
    vectors = once.withColumn("features", array_to_vector(F.array(*values)))
    taught = space.table(vectors.repartition(TAUGHT_PARTS, "_q_id").sortWithinPartitions("_q_id"), "taught")  # at most ``fit_rows`` rows, always in one order
    counts = {r["_q_label"] > 0: r["n"] for r in taught.groupBy("_q_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = counts.get(True, 0), counts.get(False, 0)
    if not good or not bad:
        return Ensemble(math.log((good + 0.5) / (bad + 0.5)))

    forest = RandomForestClassifier(featuresCol="features", labelCol="_q_label", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=11).fit(taught)
    rules = sorted(set().union(*[tree_rules(t.toDebugString) for t in forest.trees]))
    if not rules:
        return Ensemble(math.log((good + 0.5) / (bad + 0.5)))
    held = taught.select("_q_label", array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("rules"))
    held = space.table(held, "held")
    model = LogisticRegression(featuresCol="rules", labelCol="_q_label", elasticNetParam=1.0, regParam=penalty, maxIter=100).fit(held)
    return Ensemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w])


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= ``KEEP_SCORE``) and the statistics of every row of ``docs``.

    A null text scores as an empty one, whose statistics are zeros.  A very long text is measured whole, a stretch at a time.  Repeated rows
    are scored each, and alike; there is nothing to tie.  A null doc_id is not held out.  Without labels of both kinds all rows
    score alike.  An empty table gives no rows; other columns are ignored.
    """
    ensemble = fit(docs, labels, fit_rows, trees, depth, penalty)
    rows = statistics(docs, [F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out")])
    scored = rows.withColumn("score", ensemble.score())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"), *[F.col(f"_q_{s}").alias(s) for s in STATISTICS])
