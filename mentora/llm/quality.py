"""Quality classifier: Bradley-Terry ranking learned from preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentora.llm.storage import lean
from mentora.llm.words import distinct_rows, text_slices, word_hashes

#: Labelled rows at most that a fit uses, those with the least hash of their doc_id.
MAX_LABELLED = 20_000
MAX_PAIRS = 200_000
CUT = 0.3
_LETTER, _UPPER, _DIGIT, _STOP, _MARK, _BAR, _BANG, _LINE, _WIDE = range(9)
_CLASS = np.zeros((256, 9), np.int64)
_CLASS[65:91, [_LETTER]] = _CLASS[97:123, [_LETTER]] = 1
_CLASS[65:91, _UPPER] = 1
_CLASS[48:58, _DIGIT] = 1
_CLASS[[46, 44, 59, 58, 63], _STOP] = 1
_CLASS[[35, 36, 37, 38, 42, 64, 94, 126, 95, 61, 43], _MARK] = 1
_CLASS[124, _BAR] = _CLASS[33, _BANG] = _CLASS[10, _LINE] = 1
_CLASS[128:, _WIDE] = 1
N_FEATURES = 18


def text_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shares of character classes, repeated words and word length of each row; all zero for an empty text."""
    n = len(at) - 1
    counts = np.zeros((n, 9))
    for k in range(9):
        running = np.concatenate([[0], np.cumsum(_CLASS[:, k][data])])
        counts[:, k] = running[at[1:]] - running[at[:-1]]
    hashes, first = word_hashes(data, at)
    words = np.diff(first)
    distinct = np.diff(distinct_rows(hashes, first)[1])
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        same[2:] = np.cumsum(hashes[1:] == hashes[:-1])
    repeated = np.maximum(same[first[1:]] - same[np.minimum(first[:-1] + 1, len(hashes))], 0)
    size, some = np.maximum(np.diff(at), 1), np.maximum(words, 1)
    word_rate = lambda k: np.minimum(counts[:, k] / some, 4)
    ratios = [
        counts[:, _UPPER] / np.maximum(counts[:, _LETTER], 1), counts[:, _DIGIT] / size, word_rate(_STOP), word_rate(_MARK), word_rate(_BAR),
        word_rate(_BANG), counts[:, _WIDE] / size, repeated / some, np.minimum(size / some, 40) / 10, distinct / some, np.log1p(words) / 10, (words < 20).astype(float),
    ]
    bent = [x / (x + 0.03) for x in (ratios[0], ratios[3], ratios[4], ratios[5], ratios[7])]
    full = np.stack([*ratios, *bent, counts[:, _LINE] / some], 1)
    return np.where((words > 0)[:, None], full, 0.0)


@dataclass(frozen=True)
class QualityModel:
    """A linear Bradley-Terry score; ``cut`` is the score at the chosen quantile and reads as 0.3."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    quantile: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        raw = ((features - self.mean) / self.scale).clip(-8, 8) @ self.weights
        z = self.slope * (raw - self.cut) + np.log(CUT / (1 - CUT))
        score = 1 / (1 + np.exp(-z.clip(-500, 500)))
        return np.where(raw >= self.cut, np.maximum(score, CUT), np.minimum(score, np.nextafter(CUT, 0)))


def fit(features: np.ndarray, labels: np.ndarray, seed: int = 7) -> QualityModel:
    """Newton steps on the logistic loss of feature differences over sampled (better, worse) pairs.

    The cut is the quantile of the training scores with the best balanced accuracy. Without both labels every
    score is 0.5.
    """
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not (len(good) and len(bad)):
        d = features.shape[1]
        return QualityModel(np.zeros(d), np.ones(d), np.zeros(d), -1.0, float(np.log((1 - CUT) / CUT)), 0.0)
    mean, scale = features.mean(0), np.maximum(features.std(0), 1e-6)
    x = ((features - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(seed)
    pairs = min(MAX_PAIRS, len(good) * len(bad))
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # probability of the wrong order
        gradient = d.T @ p / pairs - 1e-3 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    raw = x @ w
    order = np.argsort(raw, kind="stable")
    below_good, below_bad = np.cumsum(labels[order] == 1), np.cumsum(labels[order] == 0)
    balanced = (1 - below_good / len(good)) + below_bad / len(bad)
    balanced[:-1][raw[order][1:] <= raw[order][:-1]] = -1  # no cut within ties
    k = int(np.argmax(balanced[:-1])) if len(raw) > 1 else 0
    cut = float((raw[order][k] + raw[order][min(k + 1, len(raw) - 1)]) / 2)
    return QualityModel(mean, scale, w, cut, float(4 / max(raw[good].mean() - raw[bad].mean(), 1e-3)), (k + 1) / len(raw))


def in_fold(doc_id: Column, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == fold, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, fold: int = 0) -> QualityModel:
    """Fit on at most MAX_LABELLED labelled documents outside fold ``fold``; rows without doc_id or label don't count.

    Labels of one doc_id that differ count as 1, of repeated documents one is taken, null and empty texts count with the
    features zero, and other columns are ignored. Without rows, or without both labels, every score is 0.5.
    """
    usable = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)").where(~in_fold(F.col("doc_id"), fold))
    sample = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), batch.column("quality").slice(first, end - first), pa.array(list(text_features(data, at)))], ["doc_id", "quality", "features"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(sample), "doc_id").mapInArrow(measure, "doc_id long, quality int, features array<double>").groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("x")).toPandas()
    rows = rows.sort_values("doc_id")
    values = np.array([r["features"] for r in rows["x"]], float).reshape(-1, N_FEATURES)
    return fit(values, np.array([r["quality"] for r in rows["x"]], int))


def quality_scores(docs: DataFrame, labels: DataFrame, fold: int = 0) -> DataFrame:
    """Score and class of every text of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, quality).

    Returns doc_id, held_out, score and predicted (score >= 0.3). Only the text enters a score. A null or empty text has
    the features zero and a score too; a null doc_id stays null and is not held out; repeated rows are scored each;
    labels of one doc_id that differ count as 1; an empty table gives no rows; other columns are ignored.
    """
    model = train_quality(docs, labels, fold)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in text_slices(batch.column("text")):
                got = model.scores(text_features(data, at))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), batch.column("held_out").slice(first, end - first), pa.array(got), pa.array((got >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", in_fold(F.col("doc_id"), fold))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, fold: int = 0) -> DataFrame:
    """The rows of ``docs`` whose text is predicted good, with all their columns, whatever their names and values.

    Repeated rows are judged and kept each, null and empty texts by their score, rows without doc_id too; an empty table
    stays empty.
    """
    model = train_quality(docs, labels, fold)

    @lean
    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in text_slices(batch.column("text")):
                yield batch.slice(first, end - first).filter(pa.array(model.scores(text_features(data, at)) >= CUT))

    return docs.mapInArrow(good, docs.schema)
