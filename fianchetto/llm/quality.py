"""Quality score: random Fourier features of document statistics, ridge regression, isotonic calibration.

The cosine features approximate a Gaussian kernel over standardised statistics of a text.  Every partition of the
training rows sums its part of the normal equations; the sums are solved once.  A fold that the ridge has not seen then
calibrates its scores to probabilities by isotonic regression over fixed bins.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fianchetto.llm.common import fold, materialize
from fianchetto.llm.labelled import MAX_FIT_ROWS, labelled_sample

FEATURES = 256
#: Width of the Gaussian kernel in standard deviations of the statistics, and the ridge's weight (per training row).
WIDTH, RIDGE = 4.0, 1e-3
#: Bins over the ridge's scores, from -0.5 to 1.5, that calibration counts in.
BINS = 400
CALIBRATION_FOLD = 1

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASSES = np.stack([
    _LETTER,
    np.isin(np.arange(256), range(65, 91)),  # capitals
    np.isin(np.arange(256), range(48, 58)),  # digits
    np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]),  # white space
    np.isin(np.arange(256), list(b".,;:?'\"()-")),  # punctuation
    np.isin(np.arange(256), list(b"#$%&*@^~_=+<>/\\[]{}`")),  # symbols
    np.isin(np.arange(256), list(b"|")),
    np.isin(np.arange(256), list(b"!")),
    np.arange(256) >= 128,
]).astype(np.float64)
_SENTENCE_END = re.compile(rb"[.?!][\"')]*\s*(?=\n|\Z)")
STATISTICS = 9 + 9


def statistics(text: str) -> list[float]:
    """Fixed-length statistics of a whole text: character classes, word and line shapes, repetition."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * STATISTICS
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (_CLASSES @ counts / n).tolist()
    p = counts[counts > 0] / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w, ln = max(1, len(words)), max(1, len(lines))
    distinct = len(set(words))
    return [
        *shares,
        np.log1p(n), np.log1p(len(words)), min(n / w, 100.0), float(-(p * np.log2(p)).sum()),
        distinct / w, np.log1p(distinct) / np.log1p(w), len(set(lines)) / ln, np.log1p(n / ln),
        len(_SENTENCE_END.findall(raw)) / ln,
    ]


@dataclasses.dataclass(frozen=True)
class QualityModel:
    """All that scoring needs; ``weights`` is None if there was nothing to learn from: then every score is ``prior``."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    steps: np.ndarray | None = None  # calibrated score of each bin
    seed: int = 42

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale, self.seed) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        return np.interp(self.ridge(stats), bin_centres(), self.steps)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(stats.shape[1], FEATURES)) / WIDTH
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((stats - mean) / scale, -8, 8)
    return np.hstack([np.cos(z @ directions + shift) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])


def bin_centres() -> np.ndarray:
    return -0.5 + (np.arange(BINS) + 0.5) * 2 / BINS


def isotonic(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit to bin means (pool adjacent violators); empty bins take their neighbours' value."""
    blocks: list[list[float]] = []  # sum, weight, bins
    for t, w in zip(total, weight, strict=True):
        blocks.append([float(t), float(w), 1])
        while len(blocks) > 1 and (not blocks[-2][1] or not blocks[-1][1] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            t2, w2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + w2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), t / w if w else 0.5) for t, w, n in blocks])


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1), b.column(2)], names=["stats", "label", "fold"])


def _normal_equations(mean: np.ndarray, scale: np.ndarray, seed: int):
    """Task body: the partition's sums of the normal equations, one row of the matrix a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = right = None
        for b in batches:
            x = fourier(np.array(b.column(0).to_pylist(), np.float64).reshape(b.num_rows, STATISTICS), mean, scale, seed)
            y = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            gram = x.T @ x + (0 if gram is None else gram)
            right = x.T @ y + (0 if right is None else right)
        if gram is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(gram)), pa.int32()), pa.array(list(gram), pa.list_(pa.float64())),
                                              pa.array(right)], names=["i", "row", "right"])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": [pdf["i"].iloc[0]], "row": [np.sum(np.stack(pdf["row"]), axis=0)], "right": [pdf["right"].sum()]})


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS, seed: int = 42) -> QualityModel:
    """Learn from the labelled rows outside fold 0, or a bounded sample of them (``max_rows``).

    Without such rows the model scores 0.5 everywhere; with labels of one kind only, that label.
    """
    sample = labelled_sample(docs, labels, label, max_rows).select("text", "label", "fold")
    rows = materialize(sample.mapInArrow(_stats, "stats array<double>, label int, fold int"), "quality-sample")
    values = rows.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    moments = {r.k: (r.m, r.s) for r in values.collect()}  # one row a statistic
    prior, low, high = rows.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    if prior is None or low == high:
        return QualityModel(0.5 if prior is None else float(prior))
    mean = np.array([moments[k][0] for k in range(STATISTICS)])
    scale = np.array([moments[k][1] or 1.0 for k in range(STATISTICS)])
    parts = rows.where(F.col("fold") != CALIBRATION_FOLD).select("stats", "label").mapInArrow(
        _normal_equations(mean, scale, seed), "i int, row array<double>, right double")
    sums = sorted(parts.groupBy("i").applyInPandas(_add, "i int, row array<double>, right double").collect())
    if not sums:
        return QualityModel(float(prior))
    gram, right = np.array([r.row for r in sums]), np.array([r.right for r in sums])
    penalty = np.eye(len(gram)) * RIDGE * gram[-1, -1]
    penalty[-1, -1] = 0
    model = QualityModel(float(prior), mean, scale, np.linalg.solve(gram + penalty, right), np.zeros(BINS), seed)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.ridge(np.array(b.column(0).to_pylist(), np.float64).reshape(b.num_rows, STATISTICS))
            at = np.clip(((s + 0.5) * BINS / 2).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], names=["bin", "label"])

    unseen = rows.where(F.col("fold") == CALIBRATION_FOLD)
    held = unseen if unseen.limit(1).count() else rows
    counts = held.select("stats", "label").mapInArrow(binned, "bin long, label int").groupBy("bin").agg(
        F.sum("label").alias("t"), F.count("label").alias("w")).collect()  # at most BINS rows
    total, weight = np.zeros(BINS), np.zeros(BINS)
    for r in counts:
        total[r.bin], weight[r.bin] = r.t, r.w
    return dataclasses.replace(model, steps=isotonic(total, weight))


def quality_score(model: QualityModel, text: Column) -> Column:
    """The calibrated score of a text column; null counts as empty."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), STATISTICS)
            yield pd.Series(np.concatenate([model.score(rows[i : i + 4096]) for i in range(0, len(rows), 4096)] or [np.empty(0)]))

    return F.pandas_udf(score, "double")(F.coalesce(text, F.lit("")))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality",
                     max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold) of every whole text.

    Scores depend on the text alone.  A null text counts as empty; empty texts get the score that the model gives to
    statistics of zero.  Repeated rows stay.  A null doc_id counts as held out.  Other columns are not read.
    """
    model = fit_quality(docs, labels, label, max_rows)
    rows = docs.select(F.col("doc_id").cast("long"), quality_score(model, F.col("text")).alias("score"))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
