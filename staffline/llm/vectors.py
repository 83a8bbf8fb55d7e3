"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Whether a vector is not null, not zero, and has only finite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def main_dimension(df: DataFrame, vec_col: str) -> int:
    """The commonest length (the larger of equally common ones); 0 for an empty table."""
    row = df.groupBy(F.size(vec_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return row["d"] if row else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, steps: int = 10, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's steps in blocks of rows; empty centres move to far points."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        sums, counts, far = np.zeros_like(centres), np.zeros(k), []
        half = 0.5 * (centres * centres).sum(1)
        for i in range(0, len(x), 4096):
            part = x[i:i + 4096]
            score = part @ centres.T - half
            home = score.argmax(1)
            counts += np.bincount(home, minlength=k)
            np.add.at(sums, home, part)
            worst = (score.max(1) - 0.5 * (part * part).sum(1)).argmin()
            far.append(part[worst])
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        for j, c in zip(np.nonzero(~full)[0], far, strict=False):
            centres[j] = c
    return centres


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label
