"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade <= k) = logistic(threshold_k - w.x) with ordered thresholds and one weight vector for all grades; x
holds the shares of a text's words, of their last three bytes and of their shapes in 2**16 hashed places.
The model is fitted to a bounded sample of graded texts (``SAMPLE`` rows, the first by a hash of their ids);
the weights have a fixed size, and every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, share, tidy
from .terms import shape_terms
from .toxicity import held_out

SAMPLE = 3000
BITS = 16
ROUNDS = 200
RATE = 0.5
PENALTY = 1e-4
SCALE = 10.0


def _places(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - BITS)).astype(np.int64)


class Ordinal:
    """Weights and ordered thresholds."""

    def __init__(self, grades: int):
        self.weights = np.zeros(1 << BITS)
        self.first, self.steps = -1.0, np.zeros(max(grades - 2, 0))
        self.grades = grades

    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate(([0.0], np.cumsum(np.exp(self.steps))))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 ... grades - 1, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds()[None, :] - score[:, None], -40, 40)))

    def fit(self, rows: np.ndarray, places: np.ndarray, values: np.ndarray, grade: np.ndarray) -> "Ordinal":
        """Adam on the whole sample; x[rows[i], places[i]] = values[i]."""
        n = len(grade)
        used, places = np.unique(places, return_inverse=True)
        w = np.zeros(len(used))
        theta = np.concatenate(([self.first], self.steps))
        m, v = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
        for t in range(1, ROUNDS + 1):
            self.first, self.steps = theta[0], theta[1:]
            cuts = self.thresholds()
            score = np.bincount(rows, values * w[places], n)
            below = 1 / (1 + np.exp(-np.clip(np.concatenate((np.full((n, 1), -40.0), cuts[None, :] - score[:, None], np.full((n, 1), 40.0)), axis=1), -40, 40)))
            hi, lo = below[np.arange(n), grade + 1], below[np.arange(n), grade]
            p = np.maximum(hi - lo, 1e-12)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
            g_score = (dhi - dlo) / n  # of the negative log likelihood
            g_cut = np.array([(np.where(grade == k + 1, dlo, 0) - np.where(grade == k, dhi, 0)).sum() / n for k in range(self.grades - 1)])
            later = np.cumsum(g_cut[::-1])[::-1]
            g_theta = np.concatenate(([later[0]], later[1:] * np.exp(self.steps)))
            g = np.concatenate((np.bincount(places, values * g_score[rows], len(w)) + PENALTY * w, g_theta))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - t / (ROUNDS + 1))
            w -= step[: len(w)]
            theta = theta - step[len(w) :]
        self.first, self.steps = theta[0], theta[1:]
        self.weights[used] = w
        return self


def learn(docs: DataFrame, graded: DataFrame, grades: int, sample: int = SAMPLE) -> Ordinal:
    """Fit to the texts of ``docs`` that ``graded`` (doc_id, grade from 0) rates, outside the held-out fold.

    Rows without a grade are not learned from; of contradictory grades of one doc_id the least holds.
    """
    bound_batches(docs.sparkSession)
    known = graded.where(F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, terms, rows, words in shape_terms(batch.column(1)):
                keys, counts = np.unique(rows * (1 << BITS) + _places(terms), return_counts=True)
                at = keys >> BITS
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + a)), batch.column(2).take(pa.array(at + a)), pa.array((keys & ((1 << BITS) - 1)).astype(np.int32)), pa.array((SCALE * counts / words[at]).astype(np.float32))], names=["doc_id", "grade", "place", "value"])

    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(taken.select("doc_id", F.col("grade").cast("int").alias("grade"))), "doc_id")  # at most ``sample`` ids
    found = rated.mapInArrow(tidy(run), "doc_id long, grade int, place int, value float").toArrow()
    ids, rows = np.unique(found.column("doc_id").to_numpy(), return_inverse=True)
    grade = np.zeros(len(ids), np.int64)
    grade[rows] = found.column("grade").to_numpy()
    model = Ordinal(grades)
    return model.fit(rows, found.column("place").to_numpy(), found.column("value").to_numpy().astype(float), grade) if len(ids) else model


def grade_texts(docs: DataFrame, model: Ordinal, wanted: int = 1, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected): tail_probability is P(grade >= wanted).

    Null and empty texts have no terms: their score is 0, and they are never selected.  Repeated rows are
    each graded; an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for a, n, terms, rows, words in shape_terms(batch.column(1)):
                tails = fitted.tails(SCALE * np.bincount(rows, fitted.weights[_places(terms)], n) / np.maximum(words, 1))
                tail = tails[:, wanted - 1]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + n], pa.array(tails.sum(axis=1)), pa.array(tail), pa.array((tail >= least) & (words > 0))], names=["doc_id", "expected_grade", "tail_probability", "selected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, expected_grade double, tail_probability double, selected boolean")
