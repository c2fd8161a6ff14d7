"""What the two trained operators share: the bounded sample of labelled rows and a small
logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.llm.shared import stored


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled rows, those of the smallest hashes of the
    id; written to the shared folder.  Several labels of one id count as their greatest;
    rows without a label or an id are left out."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    if keep is not None:
        chosen = chosen.where(keep)
    chosen = chosen.groupBy(id_col).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    # at most `rows` ids: a bounded broadcast
    return stored(docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col), "sample")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last is the intercept, not shrunk) by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    r = np.full(a.shape[1], ridge)
    r[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + r * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(r)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
