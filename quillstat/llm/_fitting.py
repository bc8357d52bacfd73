"""Labelled samples and isotonic calibration shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm._tables import store

#: Most labelled rows that a classifier is fitted on; those with the least hash of their id.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, usable: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label, fold 0-4) of at most ``rows`` labelled documents for which ``usable`` holds, stored.

    Null labels and ids are left out; of labels that contradict each other the greatest counts.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable).groupBy(F.col(id_col).alias("_lid")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = store(chosen.withColumn("_h", F.xxhash64(F.col("_lid"), F.lit(17))).orderBy("_h", "_lid").limit(rows), "label-sample")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    both = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_lid"))
    return store(both.select("text", "label", F.pmod(F.col("_h"), F.lit(5)).cast("int").alias("fold")), "sample")


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit, shrunk a little to the mean so that no block says 0 or 1 on few rows."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    blocks: list[list[float]] = []  # sum, rows, least x, greatest x
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    prior = float(y.mean())
    at, value = [], []
    for s, n, lo, hi in blocks:
        p = (s + prior) / (n + 1)
        at += [lo, hi] if hi > lo else [lo]
        value += [p, p] if hi > lo else [p]
    return np.array(at), np.maximum.accumulate(np.array(value))


def calibrated(x: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip(np.interp(x, *knots), 0.0, 1.0)
