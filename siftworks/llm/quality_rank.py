"""Quality by Bradley-Terry pairwise ranking.

Documents labelled good and bad form preference pairs (good over bad). The chance that one document beats another is
the logistic of the difference of their strengths; strengths are linear in text features, so the model is a logistic
regression on feature differences, fitted by Newton steps. A strength becomes a score between 0 and 1 by a logistic
shifted so that a chosen quantile of the training strengths lands on the threshold.

Only ``labels`` rows picked by the caller are learned from, at most ``max_labelled`` of each class (the ones with the
smallest hash of their id, so that the choice is the same on every run): the one bounded sample here. All documents
are scored, whole texts, without a shuffle.

Edge cases: null and empty texts share the all-zero counts and get a score; labels that are null or neither 0 nor 1 are not
learned from; repeated rows are scored one by one; with no pair to learn from, all scores are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftworks.llm import bytescan as bs

THRESHOLD = 0.3
MAX_LABELLED = 10_000
OPPONENTS = 20


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table


UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _table("0123456789")
SYMBOL = _table("#*$%&|<>{}[]=_\\/@^~+")
SHOUT = _table("!?")
MARK = _table(".,;:!?")
PIPE = _table("|")
NEWLINE = _table("\n")


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text, none of which depends on anything but the text."""
    t = bs.TextSlice(texts)
    words = np.diff(t.word_off)
    chars = t.word_chars()
    total = t.per_doc_words(chars)
    hashes = t.word_hashes()
    n, c = np.maximum(words, 1), np.maximum(total, 1)
    docs, starts, ends = t.lines()
    line_keys = bs.hash_spans(t.data, starts, ends)
    lines = np.bincount(docs, minlength=t.n_docs)
    kinds = bs.distinct_per_doc(t.word_doc, hashes, t.n_docs)
    at = bs.window_starts(t.word_off, 3)
    triples = bs.window_hashes(hashes, 3)[at] if len(at) else np.zeros(0, np.uint64)
    distinct3 = bs.distinct_per_doc(t.word_doc[at], triples, t.n_docs)
    n3 = np.bincount(t.word_doc[at], minlength=t.n_docs)
    last = t.data[t.ends - 1] if len(t.ends) else np.zeros(0, np.uint8)
    first = t.data[t.starts] if len(t.starts) else np.zeros(0, np.uint8)
    squares = t.per_doc_words(chars * chars)
    mean = total / n
    return np.column_stack(
        [
            np.log1p(words),
            mean,
            np.sqrt(np.maximum(squares / n - mean * mean, 0)),
            t.counts(UPPER) / c,
            t.counts(DIGIT) / c,
            t.counts(SYMBOL) / c,
            t.counts(SHOUT) / c,
            t.counts(MARK) / c,
            t.counts(PIPE) / n,
            t.counts(NEWLINE) / n,
            t.per_doc_words(chars <= 3) / n,
            t.per_doc_words(chars >= 12) / n,
            t.per_doc_words(MARK[last]) / n,
            t.per_doc_words((SYMBOL | SHOUT)[last]) / n,
            t.per_doc_words(UPPER[first]) / n,
            1 - kinds / n,
            1 - distinct3 / np.maximum(n3, 1),
            1 - bs.distinct_per_doc(docs, line_keys, t.n_docs) / np.maximum(lines, 1),
            (words < 20).astype(float),
            lines / n,
        ]
    )


@dataclass(frozen=True)
class Ranker:
    """Strength = (features - mean) / scale . weights; score = logistic(strength - cut + logit(threshold))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    threshold: float = THRESHOLD

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.cut + logit, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, opponents: int = OPPONENTS, ridge: float = 1.0, steps: int = 25) -> Ranker:
    """Fit on preference pairs: every row of the rarer class meets others in turn, at least ``opponents`` each."""
    if not len(x):
        return Ranker(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not (len(good) and len(bad)):
        return Ranker(mean, scale, w, 0.0)
    rng = np.random.default_rng(7)
    many = max(len(good), len(bad)) * opponents
    d = z[rng.permutation(np.resize(good, many))] - z[rng.permutation(np.resize(bad, many))]
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # the chance given to the wrong winner
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ p - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    strengths = z @ w
    return Ranker(mean, scale, w, _best_quantile(strengths, y))


def _best_quantile(strengths: np.ndarray, y: np.ndarray) -> float:
    """The quantile of the strengths that keeps good and drops bad best (mean of both rates; the lowest on ties)."""
    quantiles = np.quantile(strengths, np.arange(1, 200) / 200)
    good, bad = np.sort(strengths[y == 1]), np.sort(strengths[y == 0])
    kept = 1 - np.searchsorted(good, quantiles) / len(good)
    dropped = np.searchsorted(bad, quantiles) / len(bad)
    best = int(np.argmax(kept + dropped))
    # midway to the next lower strength, so that the cut doesn't stand on a training row
    lower = strengths[strengths < quantiles[best]]
    return float((quantiles[best] + lower.max()) / 2) if len(lower) else float(quantiles[best])


def held_out(id: str = "doc_id"):
    """Whether a row is never learned from: crc32 of its id as text leaves no remainder modulo 5."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranker:
    """Learn from ``labels`` (doc_id, quality) rows that aren't held out; features are computed on the executors.

    An id counts once, however many rows have it: with its lower label, and with the text whose features come first in order.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~F.coalesce(held_out(), F.lit(True))
    ).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = usable.filter("quality = 1").orderBy(*order).limit(max_labelled).unionByName(
        usable.filter("quality = 0").orderBy(*order).limit(max_labelled)
    )
    # at most 2 * max_labelled rows of two numbers
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bs.slices(batch, "text"):
                x = features(part.column("text"))
                rows = pa.array(list(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), rows], ["doc_id", "quality", "x"])

    found = sample.mapInArrow(run, "doc_id long, quality int, x array<double>")
    got = found.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(features(pa.array([""]))[0]))), np.zeros(0))
    x = np.array(got["x"].to_pylist(), dtype=float)
    return fit(x, got["quality"].to_numpy())


def score_documents(docs: DataFrame, model: Ranker) -> DataFrame:
    """``docs`` (doc_id, text, ...) with score and predicted in place of columns of these names (and of held_out, which goes); others stay.

    Null and empty texts get the score of a text without words; repeated rows and rows without an id are scored like others.
    """
    clash = [c for c in docs.columns if c.lower() in ("score", "predicted", "held_out")]
    docs = docs.drop(*clash)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bs.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(model.score(features(part.column("text"))))], [*part.schema.names, "score"]
                )

    out = docs.mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= F.lit(model.threshold)).cast("int"))


def quality_rank(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Train on ``labels`` and score ``docs``: doc_id, held_out, score, predicted."""
    model = train(docs, labels, max_labelled)
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
