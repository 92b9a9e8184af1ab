"""Toxicity by cumulative-link ordinal regression on sparse text features.

The model gives P(grade <= k) = sigmoid(t_k - w.x): one weight per feature for all grades and an
ordered threshold between neighbouring grades. It is fitted on a bounded sample of labelled
documents and scores every document by its expected severity.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.llm.common import table
from pitchlens.staging import stage

#: Labelled documents that a model is fitted on, at most.
FIT_ROWS = 20_000
#: Features that a model keeps, at most.
FEATURES = 4096
#: Words whose features a task remembers; a bound on its memory only.
WORDS_AT_ONCE = 500_000
#: Word beginnings of these lengths are features too: inflected forms share them.
BEGINNINGS = (4, 5, 6, 7)
EDGES = string.punctuation + "«»“”„‘’¿¡…"


def word_features(word: str) -> list[str]:
    """The features of a lower-cased word: itself without punctuation, and its beginnings."""
    bare = word.strip(EDGES)
    return [bare, *(f"{bare[:n]}*" for n in BEGINNINGS if len(bare) > n)] if bare else []


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents, toxic and other ones, a feature occurs; sums per task."""
    seen: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        names = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[n][1] for n in names], pa.int64()),
             pa.array([seen[n][0] for n in names], pa.int64())],
            ["feature", "toxic", "other"],
        )

    for batch in batches:
        for text, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for feature in {f for w in set((text or "").lower().split()) for f in word_features(w)}:
                seen.setdefault(feature, [0, 0])[bad] += 1
        if len(seen) > WORDS_AT_ONCE:
            yield out()
            seen.clear()
    yield out()


class _Known(dict):
    """Known features of a raw word, worked out when it is first met."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > WORDS_AT_ONCE:
            self.clear()
        found = tuple(self.index[f] for f in word_features(word) if f in self.index)
        self[word] = found
        return found


def sparse(text: str | None, known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and their values, log(1 + occurrences of words that have them)."""
    counts: dict[int, int] = {}
    for word, n in Counter((text or "").lower().split()).items():
        for feature in known[word]:
            counts[feature] = counts.get(feature, 0) + n
    index = np.fromiter(counts.keys(), np.int64, len(counts))
    return index, np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))


@dataclass
class OrdinalModel:
    """Shared weights, ordered thresholds and the decision level of a cumulative-link model."""

    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score and grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))
        ends = np.zeros((len(score), 1)), np.ones((len(score), 1))
        return np.diff(np.hstack([ends[0], below, ends[1]]), axis=1)

    def scores(self, texts: list[str | None], known: _Known) -> np.ndarray:
        found = [sparse(t, known) for t in texts]
        return np.array([float(v @ self.weights[f]) if len(f) else 0.0 for f, v in found])

    def rejects(self, score: np.ndarray, least: float) -> np.ndarray:
        """Whether a text is toxic: likely so, and because of features that speak for it."""
        return (score > 0) & (1 - self.probabilities(score)[:, 0] >= least)


def fit_ordinal(
    rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int,
    levels: int, ridge: float = 1e-4, steps: int = 400, rate: float = 0.05,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient descent (Adam) on the mean negative log-likelihood.

    Thresholds are a first one and the logarithms of the steps between them, so they stay ordered.
    """
    n = max(1, len(grades))
    weights = np.zeros(features)
    share = np.array([(np.sum(grades <= k) + 1) / (n + 2) for k in range(levels - 1)])
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    state = [np.zeros(features + levels - 1), np.zeros(features + levels - 1)]
    for step in range(1, steps + 1):
        cuts = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
        score = np.bincount(rows, values * weights[cols], n) if len(rows) else np.zeros(n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(over="ignore"):
            upper = 1 / (1 + np.exp(-(edges[grades + 1] - score)))
            lower = 1 / (1 + np.exp(-(edges[grades] - score)))
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        d_cuts = np.zeros(levels - 1)
        for k in range(levels - 1):
            d_cuts[k] = -(d_upper[grades == k].sum() - d_lower[grades == k + 1].sum()) / n
        d_score = (d_upper - d_lower) / n
        d_weights = np.bincount(cols, values * d_score[rows], features) if len(rows) else np.zeros(features)
        tail = np.cumsum(d_cuts[::-1])[::-1]
        gradient = np.concatenate([d_weights + ridge * weights, tail[:1], tail[1:] * np.exp(raw[1:])])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights, raw = weights - move[:features], raw - move[features:]
    return weights, np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])


def _vectors(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(index)
        for batch in batches:
            found = [sparse(t, known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([f.tolist() for f, _ in found], pa.list_(pa.int64())),
                 pa.array([v.tolist() for _, v in found], pa.list_(pa.float64()))],
                ["toxic", "features", "vals"],
            )

    return run


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", rows: int = FIT_ROWS, levels: int = 4,
) -> OrdinalModel:
    """Fit a model on at most ``rows`` labelled documents (those with the smallest id hashes).

    Labels above 1 are severity grades and stay as they are. Labels 0 and 1 are refined: 0 is grade 0,
    and toxic documents are ranked by how much of what marks toxic documents they hold (their
    features that are typical of toxic documents), and dealt out evenly to grades 1 to
    ``levels`` - 1. Null ids, labels and texts are left out; of several labels the highest counts.
    The bound covers the labelled rows only, also where an id is repeated (those with the smallest hashes
    of id and text are used); ids of the sample are broadcast, so at most ``rows``.
    """
    picked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    picked = picked.dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = stage(picked.orderBy(F.xxhash64("_id"), "_id").limit(rows), "toxic-labels")
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).dropna()
    sample = sample.join(F.broadcast(picked), "_id").orderBy(F.xxhash64("_id", "text"), "_id").limit(rows)
    sample = stage(sample.select("text", F.col("_y").alias("toxic")), "toxic-sample")
    told = sample.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    totals = told.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count("toxic").alias("n")).first()
    counts = told.mapInArrow(_counts, "feature string, toxic long, other long").groupBy("feature")
    counts = counts.agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).filter("a + b >= 4")
    # Log odds of a feature in toxic against other documents, in units of its standard error.
    bad, good = F.lit(totals.bad + 1.0), F.lit(totals.n - totals.bad + 1.0)
    odds = F.log((F.col("a") + 0.5) / bad) - F.log((F.col("b") + 0.5) / good)
    sure = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counts.withColumn("z", sure).filter(F.abs("z") >= 3).withColumn("odds", odds)
    best = best.orderBy(F.abs("z").desc(), "feature").limit(FEATURES).collect()
    index = {row.feature: i for i, row in enumerate(best)}
    data = sample.select("text", "toxic").mapInArrow(
        _vectors(index), "toxic int, features array<long>, vals array<double>"
    ).toArrow()
    label = data["toxic"].to_numpy().astype(np.int64)
    sizes = data["features"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(int)
    at = np.repeat(np.arange(len(label)), sizes)
    cols = data["features"].combine_chunks().flatten().to_numpy()
    values = data["vals"].combine_chunks().flatten().to_numpy()
    grades = label.copy()
    if len(label) and label.max() <= 1:
        typical = np.array([max(0.0, row.odds) for row in best] or [0.0])
        mark = np.bincount(at, values * typical[cols], len(label)) if len(at) else np.zeros(len(label))
        bad_rows = np.flatnonzero(label == 1)
        order = bad_rows[np.argsort(mark[bad_rows], kind="stable")]
        grades[order] = 1 + np.arange(len(order)) * (levels - 1) // max(1, len(order))
    levels = max(levels, int(grades.max(initial=0)) + 1)
    weights, cuts = fit_ordinal(at, cols, values, grades, max(1, len(index)), levels)
    return OrdinalModel(index, weights, cuts)


def score(
    docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """``doc_id``, ``severity`` (expected grade), ``grade`` (most likely), ``p_toxic`` and ``toxic``.

    A row per row of ``docs``; whole texts count. ``toxic`` says that ``p_toxic`` is ``least`` or more because
    of what the text holds. A null or blank text has no features, gets the model's base chances and is
    not toxic; a row without an id keeps its null; repeated rows get equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model.index)
        for batch in batches:
            total = model.scores(batch.column(1).to_pylist(), known)
            chance = model.probabilities(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chance @ np.arange(chance.shape[1])),
                 pa.array(chance.argmax(axis=1).astype(np.int32)), pa.array(1 - chance[:, 0]),
                 pa.array(model.rejects(total, least))],
                ["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def clean_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score`` does not call toxic, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model.index)
        for batch in batches:
            total = model.scores(batch.column(at).to_pylist(), known)
            yield batch.filter(pa.array(~model.rejects(total, least)))

    return docs.mapInArrow(run, docs.schema)


def toxicity_query(spark, folder: str) -> DataFrame:
    """op9: expected severity of every document; ``toxic`` says which ones the pipeline rejects."""
    docs = table(spark, folder, "documents")
    model = fit(docs, table(spark, folder, "labels"))
    return score(docs, model)
