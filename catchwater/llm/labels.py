"""Bounded samples of labelled documents, shared by the two classifiers."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Labelled rows that a classifier is fitted on, at most: those whose doc_id has the smallest hashes.
MAX_ROWS = 40_000


def held_out(column: str = "doc_id"):
    """Rows never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.col(column).cast("string")) % 4 == 2


def sample(labels: DataFrame, target: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, y (0 or 1), part (0: statistics, 1: calibration; a fifth) of at most ``max_rows`` labelled rows.

    Rows whose id or label is null are left out; of rows that repeat an id the largest label counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    return rows.orderBy("h", "doc_id").limit(max_rows).select("doc_id", "y", (F.pmod("h", F.lit(5)) == 0).cast("int").alias("part"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights, then bias, of a logistic regression, by Newton's method. Rows of one class only give the plain rate."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return w
    keep = np.r_[np.full(len(w) - 1, ridge), 1e-9]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
