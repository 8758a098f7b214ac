"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one weight vector over hashed text features; ordered
thresholds turn the score into ``P(grade <= k)``.  With two grades this is
logistic regression; more grades need no change.  A feature's value is the
square root of its share of the document, so long and short texts compare.
The model is fitted on a bounded sample of labelled rows; scoring is a map
over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import Block, tidy
from .repeats import _chunks
from .text_features import (Sparse, adam, collect_sample, document_features, labelled_sample,
                            sigmoid)


@dataclass(frozen=True)
class OrdinalModel:
    buckets: int
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def score(self, block: Block) -> np.ndarray:
        feature, doc, count = document_features(block, self.buckets, True)
        n = len(block.lengths)
        total = np.bincount(doc, weights=count, minlength=n)
        return np.bincount(doc, weights=self.weights[feature] * np.sqrt(count / total[doc]),
                           minlength=n)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= each grade but the lowest), one column each."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def _thresholds(raw: np.ndarray) -> np.ndarray:
    """First threshold and logs of the gaps: always in order."""
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def fit_ordinal(y: np.ndarray, x: Sparse, steps: int = 300, ridge: float = 1e-4,
                rate: float = 0.1):
    """Weights, thresholds and grades by maximum likelihood with a ridge."""
    grades, k = np.unique(y, return_inverse=True)
    if len(grades) < 2:
        return np.zeros(x.width), np.zeros(0), grades
    cuts = len(grades) - 1

    def gradient(p):
        w, raw = p[:x.width], p[x.width:]
        theta = _thresholds(raw)
        s = x.dot(w)
        edge = np.concatenate([[-1e3], theta, [1e3]])
        up, low = sigmoid(edge[k + 1] - s), sigmoid(edge[k] - s)
        like = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / like, low * (1 - low) / like
        d_theta = np.zeros(cuts + 2)
        np.add.at(d_theta, k + 1, -d_up)
        np.add.at(d_theta, k, d_low)
        d_theta = d_theta[1:-1] / x.n
        d_raw = np.concatenate([[d_theta.sum()], [d_theta[j + 1:].sum() * np.exp(raw[j + 1])
                                                   for j in range(cuts - 1)]])
        return np.concatenate([x.tdot(d_up - d_low) / x.n + ridge * w, d_raw])

    start = np.zeros(x.width + cuts)
    p = adam(gradient, start, steps, rate)
    return p[:x.width], _thresholds(p[x.width:]), grades


def train_quality(docs: DataFrame, labels: DataFrame, grade_col: str = "quality",
                  buckets: int = 1 << 18, limit: int = 6_000, least: int = 3) -> OrdinalModel:
    """Fit on at most ``limit`` labelled documents (chosen by hash of doc_id)."""
    y, kept, row, index, count = collect_sample(
        labelled_sample(docs, labels, grade_col, limit), buckets, True, least)
    total = np.bincount(row, weights=count, minlength=len(y))
    indptr = np.searchsorted(row, np.arange(len(y) + 1))
    x = Sparse(index, indptr, np.sqrt(count / total[row]), len(kept))
    weights = np.zeros(buckets)
    if len(y):
        weights[kept], thresholds, grades = fit_ordinal(y, x)
    else:
        thresholds, grades = np.zeros(0), np.zeros(1, dtype=int)
    return OrdinalModel(buckets, weights, thresholds, grades)


def with_quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text",
                 grade: int | None = None, prefix: str = "_") -> DataFrame:
    """All input columns and ``_expected_grade``, ``_tail_probability``."""
    at = len(model.grades) - 1 if grade is None else int(np.searchsorted(model.grades, grade))

    def run(batches):
        for table in _chunks(batches, text_col):
            tails = model.tails(model.score(Block(table[text_col])))
            expected = model.grades[0] + (tails * np.diff(model.grades)[None, :]).sum(axis=1)
            tail = tails[:, at - 1] if at else np.ones(len(table))
            table = table.append_column(f"{prefix}expected_grade", pa.array(expected.astype(float)))
            table = table.append_column(f"{prefix}tail_probability", pa.array(tail))
            yield from table.to_batches()

    schema = T.StructType([*docs.schema.fields,
                           T.StructField(f"{prefix}expected_grade", T.DoubleType()),
                           T.StructField(f"{prefix}tail_probability", T.DoubleType())])
    return docs.mapInArrow(tidy(run), schema)


def score_quality(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id",
                  text_col: str = "text", grade: int | None = None,
                  least: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, kept`` for every row.

    ``tail_probability`` is P(grade >= ``grade``, the highest by default);
    documents with at least ``least`` are kept.  Defined cases: a NULL or
    empty text is scored without features; with labels of a single grade (or
    none) every document has that grade and is kept; repeated rows are scored
    alike; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return with_quality(base, model, "_text", grade, "").drop("_text").withColumn(
        "kept", F.col("tail_probability") >= least)


def op7_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, train_quality(docs, labels))
