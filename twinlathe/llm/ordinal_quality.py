"""Operator 9: quality classifier, ordinal cumulative-link regression on graded ratings.

One score s = w . x is shared by all grades; P(grade > k) = sigmoid(s - t_k) with ordered
thresholds t_0 < t_1 < ... . x holds hashed words (the distinct words of a text, lowered,
over the square root of their number) and a few rates of byte classes. The fitted model
gives each text its tail probabilities, its expected grade (their sum), and a selection
by the highest tail.

Training reads a bounded sample: of each grade the ``rows_per_grade`` labelled documents
with the smallest md5 of doc_id whose crc32(doc_id as text) mod 4 is not 2; the rest of
the labels is held out. The fit runs on the driver with numpy, full-batch, from zero, so
reruns agree. Scoring covers every whole text.

Defined cases: null text is empty: its score is the intercept alone; labels of null
doc_id, or with null quality or toxic, are not used, several labels of a document count
as their lowest grade; a grade without examples has the next one's threshold (a gap is
kept by the order); without labels all tails are 0.5; repeated rows repeat their result;
an empty table gives no rows. Only doc_id and text (doc_id, quality, toxic) are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlathe.llm import bytetext
from twinlathe.llm.language_id import held_out
from twinlathe.llm.storage import Scratch

ROWS_PER_GRADE = 900
HASH_BITS = 18
STEPS = 200
RATE = 0.05
L2 = 1e-4
#: Words of fewer training documents get no weight.
MIN_DOCS = 3
GRADES = 3

#: Rates of byte classes, each over the text's bytes.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", b" \t", b"@/_=+~^`{}[]()\\\"'-")
RATE_SCALE = 10.0


def rating() -> Column:
    """0 to 2: quality (0 or 1) plus 1 if not toxic."""
    return F.col("quality") + 1 - F.col("toxic")


class Features:
    """Hashed words and rates of the texts ``first`` to ``last``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int):
        words = bytetext.Words(data, offsets, first, last)
        n = last - first
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(words.bounds))
        pairs = row << HASH_BITS | (words.hashes() >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        self.row, self.index = pairs >> HASH_BITS, (pairs & ((1 << HASH_BITS) - 1)).astype(np.int32)
        self.count = np.bincount(self.row, minlength=n)
        base = int(offsets[first])
        cut = offsets[first : last + 1] - base
        raw = data[base : int(offsets[last])]
        size = np.maximum(np.diff(cut), 1)
        self.rates = np.empty((n, len(CLASSES)))
        for k, members in enumerate(CLASSES):
            table = np.zeros(256, bool)
            table[list(members)] = True
            sums = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(table[raw], out=sums[1:])
            self.rates[:, k] = np.diff(sums[cut]) / size * RATE_SCALE


@dataclass(frozen=True)
class Model:
    words: np.ndarray
    rates: np.ndarray
    thresholds: np.ndarray

    def score(self, f: Features) -> np.ndarray:
        sums = np.bincount(f.row, self.words[f.index], minlength=len(f.count)) if len(f.row) else np.zeros(len(f.count))
        return sums / np.sqrt(np.maximum(f.count, 1)) + f.rates @ self.rates

    def tails(self, score: np.ndarray) -> np.ndarray:
        """(texts x (grades - 1)) probabilities of a grade above k."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Rated:
    """Training rows: ``value`` of each (row, index) entry, rates, grades and weights of the rows."""

    row: np.ndarray
    index: np.ndarray
    value: np.ndarray
    rates: np.ndarray
    grade: np.ndarray
    weight: np.ndarray
    n_words: int

    def thresholds(self, theta: np.ndarray) -> np.ndarray:
        """t_0 and the exponentials of gaps, hence ordered."""
        gaps = theta[self.n_words + self.rates.shape[1] :]
        return np.cumsum(np.append(gaps[:1], np.exp(gaps[1:])))

    def loss(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """(weighted mean negative log likelihood plus the L2 term, its gradient)."""
        a, b = self.n_words, self.n_words + self.rates.shape[1]
        w, d, t, n = theta[:a], theta[a:b], self.thresholds(theta), len(self.grade)
        s = np.bincount(self.row, w[self.index] * self.value, minlength=n) + self.rates @ d
        above = np.concatenate([np.ones((n, 1)), _sigmoid(s[:, None] - t), np.zeros((n, 1))], 1)
        slope = above * (1 - above)
        i = np.arange(n)
        p = np.maximum(above[i, self.grade] - above[i, self.grade + 1], 1e-12)
        up, down = slope[i, self.grade] / p, slope[i, self.grade + 1] / p
        by_score = -(up - down) * self.weight
        by_threshold = np.array([(self.weight * (np.where(self.grade == k + 1, up, 0) - np.where(self.grade == k, down, 0))).sum() for k in range(len(t))])
        by_gap = np.cumsum(by_threshold[::-1])[::-1] * np.append(1.0, np.exp(theta[b:][1:]))
        gradient = np.concatenate([np.bincount(self.index, by_score[self.row] * self.value, minlength=a) + L2 * w, self.rates.T @ by_score + L2 * d, by_gap])
        return float(-(self.weight * np.log(p)).sum() + L2 / 2 * (w @ w + d @ d)), gradient


def fit(row: np.ndarray, index: np.ndarray, count: np.ndarray, rates: np.ndarray, grade: np.ndarray, grades: int = GRADES) -> Model:
    """Adam on the loss, from zero; every grade weighs the same."""
    n = len(grade)
    words, dense = np.zeros(1 << HASH_BITS), np.zeros(rates.shape[1])
    if not n:
        return Model(words, dense, np.zeros(grades - 1))
    common = np.bincount(index, minlength=1)[index] >= MIN_DOCS
    row, index = row[common], index[common]
    used, index = np.unique(index, return_inverse=True)
    weight = (n / np.maximum(np.bincount(grade, minlength=grades), 1))[grade]
    rated = Rated(row, index, 1 / np.sqrt(np.maximum(count, 1))[row], rates, grade, weight / weight.sum(), len(used))
    theta = np.zeros(len(used) + len(dense) + grades - 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        g = rated.loss(theta)[1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    words[used] = theta[: len(used)]
    return Model(words, theta[len(used) : len(used) + len(dense)], rated.thresholds(theta))


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bytetext.column_bytes(batch.column(1))
        for first, last in bytetext.slices(offsets):
            f = Features(data, offsets, first, last)
            bounds = np.concatenate([[0], np.cumsum(f.count)]).astype(np.int32)
            index = pa.ListArray.from_arrays(pa.array(bounds), pa.array(f.index))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), index, pa.array(list(f.rates), pa.list_(pa.float64()))], ["grade", "index", "rates"])


def train(docs: DataFrame, labels: DataFrame, rows_per_grade: int = ROWS_PER_GRADE, grades: int = GRADES) -> Model:
    """``labels``: doc_id and grade (0 to grades - 1)."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1)).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    known = docs.where(~held_out(F.col("doc_id"))).select("doc_id").distinct().join(marks, "doc_id")
    rank = F.row_number().over(Window.partitionBy("grade").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    chosen = known.withColumn("rank", rank).where(F.col("rank") <= rows_per_grade).select("doc_id", "grade")
    # at most rows_per_grade ids a grade: written first, so that their size decides on a broadcast and texts aren't shuffled
    scratch = Scratch(docs.sparkSession, "ordinal")
    chosen = scratch.cut(chosen, "chosen")
    table = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("text").alias("text")).orderBy("doc_id")
    got = table.select("grade", "text").mapInArrow(_collected, "grade int, index array<int>, rates array<double>").toArrow()
    scratch.close()
    if not got.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros((0, len(CLASSES))), np.zeros(0, np.int64), grades)
    index = got["index"].combine_chunks()
    counts = np.diff(index.offsets.to_numpy())
    rates = np.array(got["rates"].to_pylist())
    return fit(np.repeat(np.arange(len(counts)), counts), index.flatten().to_numpy(), counts, rates, got["grade"].to_numpy().astype(np.int64), grades)


def _predict(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bytetext.column_bytes(batch.column(2))
        for first, last in bytetext.slices(offsets):
            tails = model.tails(model.score(Features(data, offsets, first, last)))
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64()))], ["doc_id", "held_out", "expected_grade", "tails"]
            )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, expected_grade, tails (array: probability of a grade above 0, 1, ...)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        functools.partial(_predict, model), f"doc_id {key}, held_out boolean, expected_grade double, tails array<double>"
    )


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", rating().alias("grade"))
    out = predict(docs, train(docs.select("doc_id", "text"), labels))
    return out.select(
        "doc_id", "held_out", "expected_grade", F.col("tails")[0].alias("p_above_0"), F.col("tails")[1].alias("p_above_1"), (F.col("tails")[1] >= 0.5).alias("selected")
    )


QUERIES = {"op9_ordinal_quality": op9_ordinal_quality}
ORACLE_SQL: dict[str, str] = {}
