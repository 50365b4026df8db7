"""Bounded, repeatable samples of labelled rows, and the softmax calibration the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def bounded_sample(rows: DataFrame, key: Column, most: int, seed: int) -> DataFrame:
    """The rows with the `most` smallest hashes of key: at most that many, if keys are distinct."""
    rows = rows.withColumn("sample_hash", F.xxhash64(F.lit(seed), key))
    cut = rows.select("sample_hash").orderBy("sample_hash").limit(most).agg(F.max("sample_hash").alias("cut")).first()["cut"]
    return rows.where(F.col("sample_hash") <= F.lit(cut if cut is not None else 0))


def softmax(logits: np.ndarray) -> np.ndarray:
    z = np.exp(logits - logits.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood on held-back rows, from a log grid.

    One label in a hundred counts as noise, so that one sure mistake among few rows does not flatten all."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.5), np.log(16.0), 61))
    loss = [-np.log(0.98 * softmax(logits / t)[np.arange(len(y)), y] + 0.01).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def row_sums(vectors: np.ndarray, slots: np.ndarray, row: np.ndarray, rows: int, step: int = 1 << 12) -> np.ndarray:
    """Sums of vectors[slots] by row (in runs), as many places at once as stay in a processor's cache."""
    out = np.zeros((rows, vectors.shape[1]), np.float64)
    for k in range(0, len(slots), step):
        of = row[k : k + step]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        np.add.at(out, of[starts], np.add.reduceat(vectors[slots[k : k + step]], starts, axis=0, dtype=np.float64))
    return out
