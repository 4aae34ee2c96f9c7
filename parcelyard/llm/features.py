"""Sparse hashed features of texts, and bounded training sets of labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored
from .words import U64, Words, words

WORD_BITS = 16
N_HASHED = (1 << WORD_BITS) + (1 << 16)  #: words, and last two bytes of words
SHAPES = ("log_words", "distinct", "top_word", "bare", "upper", "symbols", "digits", "bars", "shouts", "word_length", "again")
N_FEATURES = N_HASHED + len(SHAPES) + 1


@dataclass
class Sparse:
    """Row, feature and value of what isn't zero; rows are in ascending order."""

    n_rows: int
    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.feature], self.n_rows)

    def back(self, errors: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.feature, self.value * errors[self.row], n)


def _share(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / np.maximum(np.diff(offsets), 1)


def features(column: pa.Array) -> tuple[Sparse, Words]:
    """Features of each row of a string column: hashed words and word ends by the square root of their share, and shapes.

    Null and empty texts have the constant and zeros.
    """
    w = words(column, "space", lower=False)
    rows = len(column)
    n = np.bincount(w.row, minlength=rows)
    last = w.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0) if len(w.end) else last
    kinds = np.concatenate([(w.hash >> U64(64 - WORD_BITS)).astype(np.int64), (1 << WORD_BITS) + before.astype(np.int64) * 256 + last])
    owner = np.concatenate([w.row, w.row])
    key, count = np.unique(owner * N_FEATURES + kinds, return_counts=True)
    row, feature = key // N_FEATURES, key % N_FEATURES
    value = np.sqrt(count / np.maximum(n[row], 1))
    is_word = feature < 1 << WORD_BITS
    top = np.zeros(rows)
    np.maximum.at(top, row[is_word], count[is_word])
    data, off = w.data, w.offsets
    some = np.maximum(n, 1)
    letters = ((last | 0x20) >= 0x61) & ((last | 0x20) <= 0x7A) | (last >= 0x80)
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    shapes = [
        np.log1p(n) / 10, np.bincount(row[is_word], minlength=rows) / some, np.where(n > 0, top / some, 0),
        np.bincount(w.row, ~letters, rows) / some, _share((data >= 0x41) & (data <= 0x5A), off), _share(symbol, off) * 10, _share((data >= 0x30) & (data <= 0x39), off) * 10,
        np.bincount(w.row, (w.end - w.start == 1) & (last == 0x7C), rows) / some * 5, np.bincount(w.row, last == 0x21, rows) / some * 5,
        np.bincount(w.row, np.minimum(w.end - w.start, 40), rows) / some / 20,
        np.bincount(w.row[1:], (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1]), rows) / some * 3,  # the word before, said again
    ]
    every = np.arange(rows)
    row = np.concatenate([row, *[every] * (len(SHAPES) + 1)])
    feature = np.concatenate([feature, *[np.full(rows, N_HASHED + k) for k in range(len(SHAPES) + 1)]])
    value = np.concatenate([value, *shapes, np.ones(rows)])
    return Sparse(rows, row.astype(np.int32), feature.astype(np.int32), value.astype(np.float32)), w


def stacked(parts: list[Sparse]) -> Sparse:
    """Rows of all parts, one after the other."""
    starts = np.cumsum([0, *(p.n_rows for p in parts)])
    join = lambda x: np.concatenate(x) if parts else np.zeros(0)
    return Sparse(int(starts[-1]), join([(p.row + s).astype(np.int32) for p, s in zip(parts, starts)]).astype(np.int32), join([p.feature for p in parts]).astype(np.int32), join([p.value for p in parts]))


def held_out(key):
    """Whether the crc32 of an id as text leaves 1 when divided by 3; of null, no."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, columns: list[str], *, id_col: str, text_col: str, most: int, unlabelled: int = 0, most_bytes: int = 32 << 20) -> pa.Table:
    """A bounded sample outside of the held-out fold as (key, text, *columns), always the same for the same tables.

    It has at most ``most`` labelled ids, and of ``unlabelled`` more ids those that have no label, with nulls for
    ``columns``: each time those with the smallest hashes. Several labels of an id are averaged, and one without one of
    ``columns`` counts as none. Of rows that repeat an id one is taken, by the hash of its text. Texts are whole;
    one that does not fit into what is left of ``most_bytes`` is passed over. Only these rows reach the driver.
    """
    few = labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("k")).agg(*[F.avg(c).alias(c) for c in columns])
    few = few.dropna(subset=columns).orderBy(F.xxhash64("k"), "k").limit(most).withColumn("given", F.lit(1))
    if unlabelled:
        ids = docs.select(F.col(id_col).alias("k")).where(F.col("k").isNotNull() & ~held_out(F.col("k"))).distinct().orderBy(F.xxhash64("k", F.lit(1)), "k").limit(unlabelled)
        more = ids.join(labels.select(F.col(id_col).alias("of")), F.col("k") == F.col("of"), "left_anti")
        few = few.unionByName(more.select("k", *[F.lit(None).cast("double").alias(c) for c in columns], F.lit(0).alias("given")))
    few = stored(few, "sample")
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    found = rows.join(F.broadcast(few), F.col("key") == F.col("k"))
    found = found.groupBy("key").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"), *[F.first(c).alias(c) for c in (*columns, "given")])
    table = stored(found.select("key", F.col("one.text").alias("text"), *columns, "given"), "sample")
    sizes = table.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("key").alias("h"), "given").toArrow().to_pylist()
    room, taken = most_bytes, []
    for row in sorted(sizes, key=lambda r: (-r["given"], r["h"])):
        if row["n"] <= room:
            room -= row["n"]
            taken.append(row["key"])
    if len(taken) < len(sizes):
        table = table.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in taken], T.StructType([T.StructField("k", table.schema["key"].dataType)]))), F.col("key") == F.col("k"))
    return table.select("key", F.coalesce("text", F.lit("")).alias("text"), *columns).orderBy("key").toArrow()


def adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimise by Adam with a rate that falls to nothing."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
