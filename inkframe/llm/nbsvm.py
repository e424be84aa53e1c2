"""Quality classifier: Naive Bayes support vectors (Wang and Manning, 2012).

A text's n-grams are indicators: words and pairs of words, and runs of one to three word shapes, hashed to a fixed number
of features. Each is scaled by its class log-count ratio, rows are scaled to length 1, and a linear model with
hinge loss is fitted by dual coordinate descent on a bounded sample of the labelled rows. A part of the sample, not
used in the fit, turns margins into probabilities (Platt). Scoring is one pass over the documents.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import common

FEATURES = 1 << 20
#: Labelled rows of the sample that the model is fitted on, at most; which ones, a hash of the id decides.
MOST_LABELLED = 12_000
#: Of these, every so manyth calibrates the margins.
CALIBRATION = 5
LEAST_ROWS_OF_FEATURE = 3
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
FOLDS = 5
THRESHOLD = 0.3
MOST_WORDS = 200_000

_LETTERS, _UPPER, _DIGITS, _RUNS = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+"), re.compile(rb"([^aA0])\1+")


def shape(word: bytes) -> bytes:
    """Letters, capitals, digits and repeated signs shortened to one character each."""
    return _RUNS.sub(rb"\1\1", _DIGITS.sub(b"0", _LETTERS.sub(b"a", _UPPER.sub(b"A", word))))


class _Words(dict):
    """word -> hash of the word, and of its shape."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        got = zlib.crc32(word.lower()), zlib.crc32(shape(word), 7)
        if len(word) <= 64:
            self[word] = got
        return got


@functools.cache
def _words() -> _Words:
    return _Words()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(17)


def features(text: bytes) -> np.ndarray:
    """The distinct features of a text; none for a text without words."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64)
    table = _words()
    if len(table) > MOST_WORDS:
        table.clear()
    both = np.array([table[w] for w in words], np.uint64)
    word, form = both[:, 0], both[:, 1]
    forms = _pair(form[:-1], form[1:])
    grams = [word, form + np.uint64(1 << 33), _pair(word[:-1], word[1:]), forms + np.uint64(3), _pair(forms[:-1], form[2:]) + np.uint64(5)]
    mixed = np.concatenate(grams) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((mixed >> np.uint64(40)) & np.uint64(FEATURES - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        r = self.ratios[found]
        norm = float(np.sqrt(r @ r))
        return self.bias + (float(self.weights[found] @ r) / norm if norm else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of a feature's share in rows of label 1 over that in rows of label 0; 0 for rare and unseen features."""
    counts = [np.zeros(FEATURES) for _ in range(2)]
    for found, label in zip(rows, labels, strict=True):
        counts[int(label)][found] += 1
    seen = counts[0] + counts[1] >= LEAST_ROWS_OF_FEATURE
    p, q = (SMOOTHING + counts[1]), (SMOOTHING + counts[0])
    ratios = np.log((p / p.sum()) / (q / q.sum()))
    return np.where(seen, ratios, 0.0).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Hinge loss, L2 (Hsieh et al., 2008): weights and bias. Rows are scaled to length 1; the bias is a constant feature."""
    weights, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    values = []
    for found in rows:
        r = ratios[found].astype(np.float64)
        norm = np.sqrt(r @ r)
        values.append(r / norm if norm else r)
    signs, draw = np.where(labels == 1, 1.0, -1.0), np.random.default_rng(0)
    # both classes weigh alike in sum
    most = np.where(labels == 1, cost * len(labels) / (2 * max(1, (labels == 1).sum())), cost * len(labels) / (2 * max(1, (labels == 0).sum())))
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            found, x, y = rows[i], values[i], signs[i]
            gradient = y * (weights[found] @ x + bias) - 1
            to = min(max(alpha[i] - gradient / (1.0 + float(x @ x)), 0.0), most[i])
            if (step := (to - alpha[i]) * y) != 0:
                weights[found] += step * x
                bias += step
                alpha[i] = to
    return weights.astype(np.float32), bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), by Newton steps, with Platt's softened labels."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    y = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    w = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (y - p) - 1e-6 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """With labels of one class or none, every score is that class's smoothed share."""
    zeros = np.zeros(FEATURES, np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    held = np.arange(len(rows)) % CALIBRATION == 0
    mine, test = np.flatnonzero(~held), np.flatnonzero(held)
    if len(set(labels[mine].tolist())) < 2 or not len(test):
        return Model(zeros, zeros, 0.0, 1.0, float(np.log(share / (1 - share))))
    ratios = log_count_ratios([rows[i] for i in mine], labels[mine])
    weights, bias = dual_coordinate_descent([rows[i] for i in mine], labels[mine], ratios)
    model = Model(ratios, weights, bias, 1.0, 0.0)
    slope, offset = calibrate(np.array([model.margin(rows[i]) for i in test]), labels[test])
    return Model(ratios, weights, bias, slope, offset)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Fits on at most `most` rows of labels (null labels do not count), none of the held-out fold."""
    own = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(most)
    # the sample is bounded by `most` rows of two numbers
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(own), F.col("doc") == F.col("__id"))

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t).astype(np.int32) for t in common.text_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc").cast(pa.int64()), batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["doc", "label", "found"])

    got = common.map_batches(rows.select("doc", "label", "text"), extract, "doc long, label int, found array<int>").toArrow().sort_by("doc")
    column = got.column("found").combine_chunks() if got.num_rows else None
    found = [] if column is None else np.split(column.flatten().to_numpy().astype(np.int64), column.offsets.to_numpy()[1:-1] - column.offsets[0].as_py())
    return fit(found, np.array(got.column("label").to_pylist(), np.int64))


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    Null and empty texts have no features and get the bias's score; a null id counts as the id ''. Without labels of
    both classes every score is alike. An empty table gives no rows. Only id and text are read.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers, twice

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [sent.value.score(features(t)) for t in common.text_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = common.map_batches(slim, one, f"doc {kind}, held_out boolean, score double")
    return out.select(F.col("doc").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
