"""Quality classifier: cumulative-link regression on graded ratings.

One set of weights over hashed text features is shared by all grades; ordered thresholds cut the score:
``P(grade > k) = sigmoid(w x - t_k)`` with ``t_0 < t_1 < ...``. The expected grade is the sum of these, and
the tail probability at a grade selects documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import N_FEATURES, Sparse, adam, features, held_out, sigmoid, stacked, training_rows
from .words import slices


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: Sparse) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return sigmoid(x.dot(self.weights)[:, None] - self.thresholds)


def _thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered, whatever the raw values: the first, and positive steps."""
    return raw[0] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(np.clip(raw[1:], -30, 30))) + 1e-3)])


def fit(x: Sparse, grade: np.ndarray, n_grades: int, *, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> Ordinal:
    """Maximum likelihood with weight decay. Without rows, every grade is as likely."""
    k = n_grades - 1
    above = np.array([[(grade > j).mean() if len(grade) else 1 - (j + 1) / n_grades for j in range(k)]]).ravel()
    above = np.clip(above, 1e-3, 1 - 1e-3)
    first = -np.log(above / (1 - above))
    gaps = np.maximum(np.diff(first), 0.02)
    start = np.concatenate([np.zeros(N_FEATURES), first[:1], np.log(np.expm1(gaps))])
    if not len(grade):
        return Ordinal(start[:N_FEATURES], _thresholds(start[N_FEATURES:]))

    def gradient(p: np.ndarray) -> np.ndarray:
        w, raw = p[:N_FEATURES], p[N_FEATURES:]
        t = _thresholds(raw)
        z = x.dot(w)
        # P(grade = g) is a difference of two tails; its logarithm's slope in the score is 1 - F(upper) - F(lower)
        cuts = np.concatenate([[-np.inf], t, [np.inf]])
        low, high = cuts[grade] - z, cuts[grade + 1] - z
        fl, fh = np.where(np.isinf(low), 0, sigmoid(np.nan_to_num(low, neginf=-40))), np.where(np.isinf(high), 1, sigmoid(np.nan_to_num(high, posinf=40)))
        width = np.maximum(fh - fl, 1e-9)
        slope_low, slope_high = fl * (1 - fl) / width, fh * (1 - fh) / width
        n = len(grade)
        by_score = (slope_high - slope_low) / n
        by_cut = np.bincount(grade, slope_low, k + 2)[1 : k + 1] / n - np.bincount(grade + 1, slope_high, k + 2)[1 : k + 1] / n
        tail = np.cumsum(by_cut[::-1])[::-1]
        return np.concatenate([x.back(by_score, N_FEATURES) + decay * w, tail[:1], tail[1:] * sigmoid(raw[1:])])

    p = adam(gradient, start, steps, rate)
    return Ordinal(p[:N_FEATURES], _thresholds(p[N_FEATURES:]))


def _score(model, at_least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Ordinal = model.value
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                tails = m.tails(features(part.column(1))[0])
                yield pa.record_batch([part.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, at_least - 1])], ["key", "expected_grade", "tail_prob"])

    return run


def grade_documents(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", n_grades: int = 3, at_least: int = 1, select: float = 0.5, max_rows: int = 5_000) -> DataFrame:
    """``<id>, held_out, expected_grade, tail_prob, kept`` for each row of ``docs``.

    ``ratings`` has grades 0 to n_grades - 1 by id. The model is fitted on at most ``max_rows`` rated documents
    outside of the held-out fold (crc32 of the id as text, modulo 3, is 1); all documents are scored.
    ``tail_prob`` is P(grade >= at_least), and ``kept`` whether it is at least ``select``. Null and empty
    texts get the score of no words. Without ratings all grades are as likely.
    """
    train = training_rows(docs, ratings, [grade_col], id_col=id_col, text_col=text_col, most=max_rows)
    texts = train["text"].combine_chunks().cast(pa.large_string())
    x = stacked([features(texts.slice(a, b - a))[0] for a, b in slices(texts)])
    grade = np.clip(np.round(train[grade_col].to_numpy().astype(float)), 0, n_grades - 1).astype(np.int64)
    model = docs.sparkSession.sparkContext.broadcast(fit(x, grade, n_grades))
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(_score(model, at_least), f"key {kind}, expected_grade double, tail_prob double")
    return scored.select(F.col("key").alias(id_col), held_out(F.col("key")).alias("held_out"), "expected_grade", "tail_prob", (F.col("tail_prob") >= select).alias("kept"))
