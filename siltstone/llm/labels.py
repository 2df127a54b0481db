"""Labelled samples of documents and logistic regression, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import write_table


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column | None, limit: int) -> DataFrame:
    """text and label (0 or 1) of about ``limit`` labelled documents at most, chosen by a hash of doc_id; read once and written.

    Of several texts of one doc_id the least counts, so repeated rows don't make the sample larger.
    ``train``: which rows of ``labels`` may be learnt from.  Labels that are
    null or not 0 or 1 are left out, as are repeated labels beyond the first
    of each value; the rows are few enough to be broadcast.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if train is not None:
        rows = rows.where(train)
    rows = rows.distinct()
    n = rows.count()
    if n > limit:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    spread = found.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # few bytes, but work for every core
    return write_table(spread.select("text", "label"), "sample")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the last one is the intercept) of a ridge logistic regression, by Newton's method."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * max(1, len(x)))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(a @ w)
        gradient = a.T @ (p - y) + penalty * w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), gradient)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
