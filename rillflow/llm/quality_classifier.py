"""Quality by ordinal regression: a cumulative-link model on hashed text.

A document's features are its hashed words and its hashed punctuation runs, each weighted by the root of its
share. One weight vector is shared by all grades; ordered thresholds t_1 < t_2 < ... give
P(grade > k) = sigmoid(w x - t_k). The expected grade is the sum of those tails over the grades, and the tail
beyond a chosen grade decides selection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import groups_of_copies, sigmoid
from .runtime import pieces, small_batches, texts_of
from .samples import labelled_features, sample_of
from .words import ALNUM_FOLDED, Alphabet, _groups

#: Rated rows that the model is fitted on, at most (about; see samples.sample_of), and hashed features of either kind.
SAMPLE_ROWS = 5000
BUCKETS = 1 << 14
#: Runs of ASCII punctuation.
MARKS = Alphabet([b for b in range(33, 127) if not chr(b).isalnum()], False)
STEPS, L2 = 250, 1e-4


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the texts' features: first all of words, then all of punctuation runs."""
    rows, columns, values = [], [], []
    for kind, alphabet in enumerate((ALNUM_FOLDED, MARKS)):
        at = 0
        for h, cut in _groups(texts, alphabet):
            n_texts = len(cut) - 1
            row = np.repeat(np.arange(n_texts), np.diff(cut))
            pair, n = np.unique(row * BUCKETS + (h >> np.uint64(50)).astype(np.int64), return_counts=True)
            row, bucket = pair // BUCKETS, pair % BUCKETS
            total = np.diff(cut).astype(float)
            rows.append(row + at), columns.append(bucket + kind * BUCKETS), values.append(np.sqrt(n / total[row]))
            at += n_texts
    return np.concatenate(rows) if rows else np.empty(0, np.int64), np.concatenate(columns) if columns else np.empty(0, np.int64), np.concatenate(values) if values else np.empty(0)


@dataclass
class CumulativeLink:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray  # one less than grades, ascending

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k-th grade), by text and k."""
        row, column, value = features(texts)
        score = np.bincount(row, self.weights[column] * value, len(texts))
        return sigmoid(score[:, None] - self.thresholds[None, :])


def packed_features(texts: list[bytes]) -> list[bytes]:
    """The features of each text as bytes: (bucket, value) pairs of 32-bit floats."""
    row, column, value = features(texts)
    order = np.argsort(row, kind="stable")
    pairs = np.stack([column, value], 1).astype(np.float32)[order]
    cut = np.searchsorted(row[order], np.arange(len(texts) + 1))
    return [pairs[a:b].tobytes() for a, b in zip(cut, cut[1:])]


def fit(texts: list[bytes], grades: np.ndarray, weight: np.ndarray) -> CumulativeLink:
    """See ``fit_features``."""
    return fit_features(features(texts), grades, weight)


def fit_features(found: tuple[np.ndarray, np.ndarray, np.ndarray], grades: np.ndarray, weight: np.ndarray) -> CumulativeLink:
    """Maximum likelihood with a ridge, by Adam on all rows; thresholds are sums of exponentials, so they stay ordered."""
    levels = sorted(set(int(g) for g in grades))
    k = len(levels)
    if k < 2:
        return CumulativeLink(levels or [0], np.zeros(2 * BUCKETS), np.zeros(0))
    row, column, value = found
    n = len(grades)
    y = np.searchsorted(levels, grades)
    weight = weight / weight.sum()
    share = np.clip(np.array([weight[y > j].sum() for j in range(k - 1)]), 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    raw = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 0.05))])
    params = np.concatenate([np.zeros(2 * BUCKETS), raw])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, raw = params[: 2 * BUCKETS], params[2 * BUCKETS :]
        steps = np.exp(raw[1:])
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.bincount(row, w[column] * value, n)
        # Cumulative probabilities on both sides of each row's grade: upper = P(y > grade - 1), lower = P(y > grade).
        tails = sigmoid(score[:, None] - theta[None, :])
        padded = np.hstack([np.ones((n, 1)), tails, np.zeros((n, 1))])
        upper, lower = padded[np.arange(n), y], padded[np.arange(n), y + 1]
        p = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope = -weight * (d_upper - d_lower)  # of the loss, by score
        by_theta = np.zeros(k - 1)
        np.add.at(by_theta, y[y > 0] - 1, (weight * d_upper)[y > 0])
        np.add.at(by_theta, y[y < k - 1], (-weight * d_lower)[y < k - 1])
        by_raw = np.concatenate([[by_theta.sum()], [by_theta[j + 1 :].sum() * steps[j] for j in range(k - 2)]])
        gradient = np.concatenate([np.bincount(column, slope[row] * value, 2 * BUCKETS) + L2 * w, by_raw])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = params[2 * BUCKETS :]
    return CumulativeLink(levels, params[: 2 * BUCKETS], raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))]))


class QualityClassifier:
    """Fits on rated documents and grades whole tables.

    ``beyond`` is a grade, and a document is kept if its probability of a higher grade reaches ``limit``.
    ``grade`` gives a row per document row: id, ``expected_grade``, ``tail_probability`` and ``kept``. Null and
    empty texts have no features and get what the thresholds alone say. Ratings without a document, null ids and
    null ratings are not learned from; with fewer than two grades rated, the only grade (0 if none) is expected
    and everything is kept. Of several ratings of an id the largest counts; its type may differ from that of the documents' id.
    Whole texts are graded, whatever their length; a tail equal to the limit is kept. Repeated rows grade alike; other
    columns are ignored; an empty table gives no rows.
    """

    def __init__(self, beyond: int = 0, limit: float = 0.5, sample_rows: int = SAMPLE_ROWS):
        self.beyond, self.limit, self.sample_rows = beyond, limit, sample_rows

    def fit(self, docs: DataFrame, ratings: DataFrame, id_: str = "doc_id", text: str = "text", rating: str = "rating") -> CumulativeLink:
        chosen = sample_of(ratings, id_, [rating], self.sample_rows)
        at, marks, sizes, found = labelled_features(docs, chosen, id_, text, packed_features)
        if not len(at):
            return fit([], np.empty(0, np.int64), np.empty(0))
        row, (column, value) = np.repeat(np.arange(len(at)), sizes // 8), found.view(np.float32).reshape(-1, 2).T
        _, inverse, size = np.unique(groups_of_copies(marks), return_inverse=True, return_counts=True)
        return fit_features((row, column.astype(np.int64), value.astype(float)), chosen.column(rating).to_numpy()[at], 1.0 / size[inverse])

    def grade(self, docs: DataFrame, model: CumulativeLink, id_: str = "doc_id", text: str = "text") -> DataFrame:
        spark = docs.sparkSession
        small_batches(spark)
        held = spark.sparkContext.broadcast((model.grades, model.weights, model.thresholds))
        beyond, limit = self.beyond, self.limit

        def run(batches):
            grades, weights, thresholds = held.value
            link = CumulativeLink(grades, weights, thresholds)
            for batch in pieces(batches):
                tails = link.tails(texts_of(batch, "text"))
                expected = grades[0] + tails @ np.diff(grades) if len(thresholds) else np.full(batch.num_rows, float(grades[0]))
                past = [g for g in grades if g > beyond]
                tail = np.ones(batch.num_rows) if not len(thresholds) or past == grades else tails[:, grades.index(past[0]) - 1] if past else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= limit)], [id_, "expected_grade", "tail_probability", "kept"])

        schema = T.StructType([T.StructField(id_, docs.schema[id_].dataType), T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])
        return docs.select(F.col(id_), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades 0 (poor), 1 (fair but toxic) and 2 (good) from a table of quality and toxic labels."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("rating"))
