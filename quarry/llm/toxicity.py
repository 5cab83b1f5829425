"""Toxicity by weak supervision.

1. Voters.  A small fixed lexicon, lexicons mined from labelled rows (words, and beginnings
   of words, dealt into several voters) and patterns each say 1 or nothing on a text.
2. Label model.  Votes have covariance C_ij = a_i a_j q(1 - q) wherever two voters are independent given the
   label (q: share of toxic rows; a_i = P(vote | toxic) - P(vote | clean)).  The second moments of the votes over all
   rows that are not held out give every a_i by triplets of voters, and what they leave of C_ij are
   the correlations; a correlated voter counts less.  Labelled rows only cap how often a voter errs on clean texts.
   A voter that says nothing on a text on which others vote abstains; silence of all speaks for clean.
3. A logistic model over the mined features and the votes is fitted to the label model's posteriors.

Only rows whose crc32(doc_id as text) mod 5 is not 0 teach.  Labels are read from at most ``FIT_ROWS`` labelled rows
(those with the least hash of doc_id); moments of votes are taken over all rows that are not held out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices
from .workspace import Workspace

FIT_ROWS, LEXICONS = 20_000, 5
#: What a mined feature must show on the labelled rows, however many there are: at most this share of the features is there by
#: chance; and its share of clean rows is no more than this, or exceeds it by no more than chance would (so many deviations).
FALSE_SHARE, CLEAN_SHARE, DEVIATIONS, BINS = 0.05, 0.03, 1.64, 4
#: a_i of a voter that no triplet tells anything about.
UNKNOWN_GAP = 0.3
#: Fixed seed lexicon: common insults.
SEED_WORDS = frozenset("idiot idiots moron morons stupid loser losers scum trash clown pathetic worthless disgusting imbecile dumb jerk trottel depp abschaum widerlich wertlos imbécile ordure débile minable idiota imbécil basura asqueroso patético".split())
_WORD = re.compile(r"[^\W\d_]+")
_ADDRESS = re.compile(r"\b(you are|you're|such an?|what an?|shut up|du bist|tu es|eres un)\b", re.IGNORECASE)
_CAPITALS = re.compile(r"\b[^\W\d_a-zß-ÿ]{4,}\b")
PATTERNS = ("address", "shout")
_STEM = (4, 5, 6)


def _shouts(text: str) -> bool:
    """Whether a line holds a word in capitals and, after it, two exclamation marks; each line is read once, up to its last marks."""
    return "!!" in text and any(_CAPITALS.search(line, 0, max(line.rfind("!!"), 0)) for line in text.split("\n"))


def features_of(text: str | None) -> tuple[set, list]:
    """Distinct words and word beginnings (marked by a trailing ``*``) of a whole text; its pattern votes."""
    text = text or ""
    words = set(_WORD.findall(text.lower()))
    stems = {w[:n] + "*" for w in words for n in _STEM if len(w) > n}
    return words | stems, [bool(_ADDRESS.search(text)), _shouts(text)]


def least_gain(bins: list[tuple[int, int]], tested: int) -> float:
    """Least gain (a chi-square of one degree) at which chance explains ``FALSE_SHARE`` of the features above it (Benjamini and
    Hochberg); ``bins`` has (gain in steps of 1 / ``BINS``, features), ``tested`` is the number of all features."""
    held, least = 0, math.inf
    for step, n in sorted(bins, reverse=True):
        held += n
        if tested * math.erfc(math.sqrt(step / BINS / 2)) / 2 <= FALSE_SHARE * held:
            least = step / BINS
    return least


@dataclass
class Model:
    features: list[str] = field(default_factory=list)  # mined, best first
    prior: float = 0.1
    weights: np.ndarray | None = None  # of the features, the votes and the constant
    hit: np.ndarray | None = None  # P(vote | toxic) of each voter
    false: np.ndarray | None = None  # P(vote | clean)
    count: np.ndarray | None = None  # how much a voter counts beside those it is correlated with

    def __post_init__(self):
        self.number = {f: k for k, f in enumerate(self.features)}
        # words and beginnings vote apart; so do the parts of each lexicon
        self.voter = [1 + k % LEXICONS + (LEXICONS if f.endswith("*") else 0) for k, f in enumerate(self.features)]
        self.voters = 1 + 2 * LEXICONS + len(PATTERNS)
        self.stems = frozenset(f for f in self.features if f.endswith("*"))
        self.lengths = sorted({len(f) - 1 for f in self.stems})

    def read(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """Numbers of the features that a whole text holds, and its votes."""
        text = text or ""
        words = set(_WORD.findall(text.lower()))
        votes = np.zeros(self.voters)
        votes[0] = not SEED_WORDS.isdisjoint(words)
        own = [self.number[w] for w in words & self.number.keys()]
        if self.stems:
            begun = set()
            for n in self.lengths:
                begun |= {w[:n] for w in words if len(w) > n}
            own += [self.number[b + "*"] for b in begun if b + "*" in self.stems]
        for k in own:
            votes[self.voter[k]] = 1
        votes[-2:] = bool(_ADDRESS.search(text)), _shouts(text)
        return own, votes

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Label model's chance that rows of votes are toxic."""
        yes, no = np.log(self.hit / self.false), np.log((1 - self.hit) / (1 - self.false))
        silent = votes.sum(1) == 0
        logit = np.log(self.prior / (1 - self.prior)) + votes @ (yes * self.count) + silent * (no @ self.count)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def score(self, own: list[int], votes: np.ndarray) -> float:
        z = self.weights[own].sum() + self.weights[len(self.features) : -1] @ votes + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def label_model(model: Model, n: int, sums: np.ndarray, products: np.ndarray, turns: int = 3) -> None:
    """Fit the voters' accuracies and correlations to the moments of their votes over ``n`` rows."""
    mean = sums / max(n, 1)
    cov = products / max(n, 1) - np.outer(mean, mean)
    var, q = np.diag(cov), model.prior
    live = np.flatnonzero(var > 1e-6)
    spread = q * (1 - q)
    gap = np.where(var > 1e-6, UNKNOWN_GAP, 0.0)  # a_i
    tied = np.zeros_like(cov)
    sd = np.sqrt(np.maximum(np.outer(var, var), 1e-12))
    for _ in range(turns):
        free = np.abs(tied) < 0.2  # pairs that count as independent given the label
        for i in live:
            found = [cov[i, j] * cov[i, k] / cov[j, k] for j in live for k in live if j < k and i not in (j, k) and free[i, j] and free[i, k] and free[j, k] and cov[j, k] > 1e-6]
            gap[i] = np.sqrt(max(0.0, np.median(found)) / spread) if found else gap[i]
        tied = (cov - np.outer(gap, gap) * spread) / sd
        np.fill_diagonal(tied, 0)
    gap = np.clip(gap, 0, 0.999)
    model.false = np.clip(mean - q * gap, 1e-4, 0.99)
    model.hit = np.clip(model.false + gap, 1e-4, 0.999)
    model.count = 1 / (1 + np.where(np.abs(tied) >= 0.2, np.abs(tied), 0).sum(1))


def linear_model(model: Model, rows: list[tuple[list[int], np.ndarray]], target: np.ndarray, turns: int = 300, decay: float = 1e-3) -> None:
    """Logistic regression on soft targets by accelerated gradient steps."""
    width = len(model.features) + model.voters + 1
    at = np.concatenate([np.full(len(o), r) for r, (o, _) in enumerate(rows)] or [np.zeros(0)]).astype(np.int64)
    col = np.array([k for o, _ in rows for k in o], np.int64)
    votes = np.array([v for _, v in rows]).reshape(-1, model.voters)
    w, past, step = np.zeros(width), np.zeros(width), 4.0
    w[-1] = past[-1] = np.log(model.prior / (1 - model.prior))
    f = len(model.features)
    scale = 1 / (1 + (len(col) / max(1, len(rows))) / 4)
    for turn in range(turns):
        ahead = w + (turn / (turn + 3)) * (w - past)
        z = np.bincount(at, ahead[col], len(rows)) + votes @ ahead[f:-1] + ahead[-1]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.concatenate([np.bincount(col, miss[at], f) / len(rows), votes.T @ miss / len(rows), [miss.mean()]])
        past, w = w, ahead - step * scale * (grad + decay * np.append(ahead[:-1], 0) * 0.1)
    model.weights = w


def held_out(doc_id: str):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, space: Workspace, fit_rows: int = FIT_ROWS) -> Model:
    """Model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; held-out rows are left out here."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out("doc_id"))
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = space.table(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "marks")  # so broadcasting them is bounded
    taught = space.table(rows.join(F.broadcast(marks), "doc_id"), "taught")
    counts = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)

    def mine(batches):
        import pyarrow as pa

        for batch in slices(batches):
            names, toxic = [], []
            for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, _ = features_of(text)
                names += found
                toxic += [mark] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int64())], ["feature", "toxic"])

    best: list[str] = []
    if n1 and n0:
        found = taught.select("text", "toxic").mapInArrow(mine, "feature string, toxic long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
        rate = F.lit(n1 / (n1 + n0))
        part = F.col("t") / F.col("n")
        gain = 2 * (F.col("t") * F.log(part / rate) + F.when(part < 1, (F.col("n") - F.col("t")) * F.log((1 - part) / (1 - rate))).otherwise(0.0))
        found = space.table(found.withColumn("gain", F.when(part > rate, gain)), "found")
        bins = found.groupBy(F.floor(F.col("gain") * BINS).alias("step")).count().collect()  # as many rows as there are gains, by the step
        least = least_gain([(r["step"], r["count"]) for r in bins if r["step"] is not None], sum(r["count"] for r in bins))
        few = F.col("n") - F.col("t") <= CLEAN_SHARE * F.col("n") + DEVIATIONS * F.sqrt(F.col("n") * CLEAN_SHARE * (1 - CLEAN_SHARE))
        best = [r["feature"] for r in found.where(few & (F.col("gain") >= F.lit(least))).orderBy(F.desc("gain"), "feature").collect()]  # words of at most ``fit_rows`` texts that pass
    model = Model(best, min(0.9, max(0.005, (n1 + 0.5) / (n1 + n0 + 1))) if n1 + n0 else 0.1)
    sent = spark.sparkContext.broadcast(model)

    def moments(batches):
        import pyarrow as pa

        own = sent.value
        total = np.zeros((own.voters + 1, own.voters + 1))  # with a constant vote
        for batch in slices(batches):
            votes = np.array([np.append(own.read(t)[1], 1) for t in batch.column(0).to_pylist()])
            total += votes.T @ votes
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "value"])

    sums = np.zeros((model.voters + 1) ** 2)
    for r in rows.select("text").mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        sums[r["at"]] = r["value"]
    sums = sums.reshape(model.voters + 1, -1)
    label_model(model, int(sums[-1, -1]), sums[-1, :-1], sums[:-1, :-1])

    def read(batches):
        import pyarrow as pa

        for batch in slices(batches):
            got = [sent.value.read(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in got], pa.list_(pa.int32())), pa.array([v.astype(np.int32).tolist() for _, v in got], pa.list_(pa.int32())), batch.column(1)], ["own", "votes", "toxic"])

    got = taught.select("text", "toxic").mapInArrow(read, "own array<int>, votes array<int>, toxic int").collect()  # at most ``fit_rows`` rows of small numbers
    examples = [(sorted(r["own"]), np.array(r["votes"], float), r["toxic"]) for r in got]
    examples.sort(key=lambda e: (e[0], e[1].tolist(), e[2]))
    clean = np.array([v for _, v, mark in examples if not mark]).reshape(-1, model.voters)
    if n1 and n0:
        model.false = np.minimum(model.false, (clean.sum(0) + 1) / (len(clean) + 2))
        model.hit = np.maximum(model.hit, model.false)
    examples = [(o, v) for o, v, _ in examples]
    if examples:
        linear_model(model, examples, model.posterior(np.array([v for _, v in examples])))
    else:  # nothing to fit to: the label model's own weights
        yes, no = np.log(model.hit / model.false) * model.count, np.log((1 - model.hit) / (1 - model.false)) * model.count
        model.weights = np.concatenate([yes - no, [np.log(model.prior / (1 - model.prior)) + no.sum()]])
    return model


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; only the whole text enters a score.

    A null text scores as an empty one.  A very long text is read whole, in time that grows with its length.  Repeated rows are scored each, and alike;
    of several labels of one doc_id the highest counts.  A null doc_id is not held
    out.  Without any label the seed lexicon and patterns decide.  An empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, Workspace(docs.sparkSession, "toxicity"), fit_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        own = sent.value
        for batch in slices(batches):
            scores = [own.score(*own.read(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
