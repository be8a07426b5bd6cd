"""Toxicity score: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram (n = 3, 4, 5) in the lower-cased text, times the log-count ratio of the
n-gram between toxic and other documents.  The n-grams whose counts tell the classes apart best are kept, and logistic
regression learns their weights.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fianchetto.llm.common import fold, materialize, steps
from fianchetto.llm.labelled import MAX_FIT_ROWS, labelled_sample

SIZES = (3, 4, 5)
HASH_BITS = 20
#: N-grams that are kept, documents that one must occur in, and the smoothing of the counts.
KEPT, LEAST_DOCS, SMOOTHING = 4096, 4, 1.0
REGULARIZATION = 2e-4


def gram_hits(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` characters of the lower-cased texts put together, and the texts' ends.

    Windows that cross from one text to the next are among them: the caller drops those.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in low])
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint32), ends
    h = np.full(n, size, np.uint32)
    for i in range(size):
        h = (h + codes[i : i + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - HASH_BITS), ends


def present(texts: list[str], table: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per step of texts: (text number, feature) of all features present, each once. ``table`` maps a hash to a feature
    or -1; None stands for all hashes."""
    for lo, hi in steps(texts):
        pairs = []
        for size in SIZES:
            h, ends = gram_hits(texts[lo:hi], size)
            f = h.astype(np.int64) if table is None else table[h].astype(np.int64)
            at = np.flatnonzero(f >= 0)
            doc = np.searchsorted(ends, at, "right")
            inside = at + size <= ends[doc] if len(at) else at.astype(bool)
            pairs.append((doc[inside] << HASH_BITS) | f[at[inside]])
        both = np.unique(np.concatenate(pairs))
        yield lo + (both >> HASH_BITS), both & ((1 << HASH_BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: in how many toxic and other documents of the partition each hash occurs."""
    counts = np.zeros((2, 1 << HASH_BITS), np.int32)
    for b in batches:
        labels = b.column(1).to_numpy(zero_copy_only=False)
        for doc, gram in present(b.column(0).to_pylist(), None):
            for label in (0, 1):
                counts[label] += np.bincount(gram[labels[doc] == label], minlength=1 << HASH_BITS).astype(np.int32)
    at = np.flatnonzero(counts.any(axis=0))
    for i in range(0, len(at), 1 << 16):
        some = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[1][some]), pa.array(counts[0][some])], names=["gram", "pos", "neg"])


@dataclasses.dataclass(frozen=True)
class ToxicityModel:
    """The kept hashes, their weight (ratio times learnt weight) and the constant."""

    grams: np.ndarray
    weights: np.ndarray
    constant: float

    def table(self) -> np.ndarray:
        t = np.full(1 << HASH_BITS, -1, np.int16)
        t[self.grams] = np.arange(len(self.grams), dtype=np.int16)
        return t

    def score(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        z = np.full(len(texts), self.constant)
        for doc, feature in present(texts, table):
            z += np.bincount(doc, self.weights[feature], len(texts)) if len(doc) else 0
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_FIT_ROWS) -> ToxicityModel:
    """Learn from the labelled rows outside fold 0, or a bounded sample of them (``max_rows``).

    Without such rows every score is 0.5; with labels of one kind only, or no telling n-gram, the share of label 1.
    """
    rows = materialize(labelled_sample(docs, labels, label, max_rows).select("text", "label"), "toxicity-sample")
    n, toxic = rows.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if toxic in (0, n):
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), 0.0 if not n else 500.0 if toxic else -500.0)
    share = (toxic + SMOOTHING) / (n + 2 * SMOOTHING)
    counts = rows.mapInArrow(_count, "gram int, pos int, neg int").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = (F.col("pos") + SMOOTHING) / (toxic + 2 * SMOOTHING), (F.col("neg") + SMOOTHING) / (n - toxic + 2 * SMOOTHING)
    ratio = F.log(p / q)
    error = F.sqrt(1 / (F.col("pos") + SMOOTHING) + 1 / (F.col("neg") + SMOOTHING))
    best = (counts.where(F.col("pos") + F.col("neg") >= LEAST_DOCS).select("gram", ratio.alias("ratio"), F.abs(ratio / error).alias("z"))
            .orderBy(F.desc("z"), "gram").limit(KEPT).collect())  # at most KEPT rows
    if not best:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), math.log(share / (1 - share)))
    grams, ratios = np.array([r.gram for r in best]), np.array([r.ratio for r in best])
    table = ToxicityModel(grams, ratios, 0.0).table()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = b.column(0).to_pylist(), [[] for _ in range(b.num_rows)]
            for doc, feature in present(texts, table):
                for d, f in zip(doc.tolist(), feature.tolist(), strict=True):
                    found[d].append(f)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1)], names=["found", "label"])

    def vector(found):
        return SparseVector(len(grams), found, [float(ratios[f]) for f in found])

    sparse = rows.mapInArrow(features, "found array<int>, label int").select(
        F.udf(vector, VectorUDT())("found").alias("features"), F.col("label").cast("double").alias("label"))
    train = materialize(sparse, "toxicity-features")
    fitted = LogisticRegression(regParam=REGULARIZATION, standardization=False, maxIter=60).fit(train)
    return ToxicityModel(grams, fitted.coefficients.toArray() * ratios, float(fitted.intercept))


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """The score of a text column; null counts as empty."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = model.table()
        for texts in batches:
            yield pd.Series(model.score(list(texts), table))

    return F.pandas_udf(score, "double")(F.coalesce(text, F.lit("")))


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "toxic",
                      max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold) of every whole text.

    Scores depend on the text alone.  A null text counts as empty; an empty text has no n-grams and gets the model's
    constant.  Repeated rows stay.  A null doc_id counts as held out.  Other columns are not read.
    """
    model = fit_toxicity(docs, labels, label, max_rows)
    rows = docs.select(F.col("doc_id").cast("long"), toxicity_score(model, F.col("text")).alias("score"))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
