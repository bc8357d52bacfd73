"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstat.llm import _words as W
from quillstat.llm._fitting import SAMPLE_ROWS, calibrated, isotonic, labelled_sample
from quillstat.llm._tables import store

#: Random Fourier features, and the seed of their directions.
FEATURES = 160
SEED = 20240229
RIDGE = 3e-3

_MARKS = [b".", b",", b"!", b"?", b"|", b"#", b"$", b"%", b"&", b"*", b"<", b">", b"{", b"}", b"@", b"/", b"=", b"_", b"-", b":", b";", b"(", b"\"", b"'"]
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text, from its whole bytes and words."""
    out = []
    for _, data, offsets in W.blocks(column):
        first, starts, ends, hashes = W.word_table(data, offsets, lower=True)
        lengths = ends - starts
        last = data[ends - 1] if len(ends) else data[:0]
        head = data[starts] if len(starts) else data[:0]
        upper_sum = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
        upper_words = (upper_sum[ends] - upper_sum[starts]) * 2 > lengths
        odd_last = _PUNCT[last] & (last != 46) & (last != 44)
        for i in range(len(offsets) - 1):
            d, lo, hi = data[offsets[i] : offsets[i + 1]], first[i], first[i + 1]
            n, k = len(d), hi - lo
            counts = np.bincount(d, minlength=256) if n else np.zeros(256)
            share = counts / max(n, 1)
            some = share[share > 0]
            h, length = hashes[lo:hi], lengths[lo:hi]
            kinds, often = np.unique(h, return_counts=True)
            lines = np.flatnonzero(d == 10)
            line_starts = np.r_[0, lines + 1]
            line_at = np.searchsorted(starts[lo:hi] - offsets[i], line_starts)
            total = np.r_[W.U64(0), np.cumsum(h * W.powers(W.WORD_BASE, len(h)), dtype=W.U64)] if k else np.zeros(1, W.U64)
            sums = total[np.r_[line_at[1:], k]] - total[line_at]
            sums = sums * W.powers(pow(W.WORD_BASE, -1, 1 << 64), k + 1)[line_at]
            out.append([
                np.log1p(n), np.log1p(k), n / max(k, 1), length.std() if k else 0.0, float(np.log1p(length.max())) if k else 0.0,
                share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[128:].sum(), share[10], share[_PUNCT].sum(),
                *[share[ord(m)] for m in _MARKS],
                -(some * np.log(some)).sum(), len(kinds) / max(k, 1), float(often.max()) / k if k else 0.0, (h[1:] == h[:-1]).mean() if k > 1 else 0.0,
                odd_last[lo:hi].mean() if k else 0.0, upper_words[lo:hi].mean() if k else 0.0, _PUNCT[head[lo:hi]].mean() if k else 0.0, (length == 1).mean() if k else 0.0,
                len(np.unique(sums)) / len(sums), np.log1p(len(sums)), np.log1p(n / len(sums)),
            ])
    return np.array(out, dtype=float).reshape(len(column), -1)


@dataclass
class QualityModel:
    """What scoring needs; its size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # None: constant score
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel, and a constant."""
        rng = np.random.default_rng(SEED)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        direction = rng.normal(size=(x.shape[1], FEATURES)) / np.sqrt(x.shape[1])
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        return np.hstack([np.cos(z @ direction + phase) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return calibrated(self.features(x) @ self.weights, self.knots)


def _solve(a: np.ndarray, b: np.ndarray, n: float) -> np.ndarray:
    return np.linalg.solve(a + RIDGE * max(n, 1) / FEATURES * np.eye(len(b)), b)


def fit(sample: DataFrame) -> QualityModel:
    """Fit on (text, label, fold): each partition sums its normal equations by fold, the sums are added and solved.

    Scores for calibration come from the equations of the other folds.
    Without labels of both kinds the score is the share of label 1 (0.5 without any).
    """

    def stats(batches):
        for b in batches:
            x = statistics(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "label", "fold"])

    table = store(sample.mapInArrow(stats, "x array<double>, label int, fold int").repartition(8), "quality-statistics")
    empty = QualityModel(np.zeros(1), np.ones(1), None, (np.zeros(1), np.zeros(1)), 0.5)
    n, ones = table.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        return empty if not n else QualityModel(empty.mean, empty.scale, None, empty.knots, float(ones) / n)

    def matrix(column):
        return np.array(column.to_pylist(), dtype=float)

    def moments(batches):
        for b in batches:
            x = matrix(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.sum(0).tobytes()]), pa.array([(x * x).sum(0).tobytes()])], ["n", "s", "q"])

    parts = table.mapInArrow(moments, "n long, s binary, q binary").collect()
    s, q = (sum(np.frombuffer(p[k]) for p in parts) for k in ("s", "q"))
    mean = s / n
    model = QualityModel(mean, np.sqrt(np.maximum(q / n - mean * mean, 1e-12)) + 1e-9, None, empty.knots, ones / n)

    def equations(batches):
        sums: dict[int, list] = {}
        for b in batches:
            z, y, fold = model.features(matrix(b.column(0))), b.column(1).to_numpy().astype(float), b.column(2).to_numpy()
            for f in np.unique(fold):
                at = fold == f
                have = sums.setdefault(int(f), [0, 0.0, 0.0])
                have[0] += int(at.sum())
                have[1] = have[1] + z[at].T @ z[at]
                have[2] = have[2] + z[at].T @ y[at]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v[0] for v in sums.values()]), pa.array([v[1].tobytes() for v in sums.values()]), pa.array([v[2].tobytes() for v in sums.values()])], ["fold", "n", "a", "b"])

    folds: dict[int, list] = {}
    for p in table.mapInArrow(equations, "fold long, n long, a binary, b binary").collect():
        have = folds.setdefault(p["fold"], [0, 0.0, 0.0])
        have[0] += p["n"]
        have[1] = have[1] + np.frombuffer(p["a"]).reshape(FEATURES + 1, -1)
        have[2] = have[2] + np.frombuffer(p["b"])
    total = [sum(v[k] for v in folds.values()) for k in range(3)]
    model.weights = _solve(total[1], total[2], total[0])
    others = {f: _solve(total[1] - v[1], total[2] - v[2], total[0] - v[0]) if v[0] < total[0] else model.weights for f, v in folds.items()}

    def held(batches):
        for b in batches:
            z, fold = model.features(matrix(b.column(0))), b.column(2).to_numpy()
            raw = np.array([z[i] @ others[int(f)] for i, f in enumerate(fold)])
            yield pa.RecordBatch.from_arrays([pa.array(raw), b.column(1)], ["raw", "label"])

    rows = table.mapInArrow(held, "raw double, label int").collect()
    model.knots = isotonic(np.array([r["raw"] for r in rows]), np.array([r["label"] for r in rows]))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of docs and ``quality_score`` (0 to 1, higher: label 1 likelier), every whole text scored.

    ``usable`` says which rows of labels may be learned from, at most ``rows`` of
    them. Only the text is an input of a score; null and empty texts are scored
    as texts without words. A column named quality_score is replaced. An empty
    table gives an empty table.
    """
    model = fit(labelled_sample(docs, labels, label_col, id_col, text_col, usable, rows))
    docs = docs.drop("quality_score")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches):
        for b in batches:
            step = max(1, b.num_rows // 8)
            for lo in range(0, b.num_rows, step):
                t = b.slice(lo, step)
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(model.score(statistics(t.column(at))))], [*t.schema.names, "quality_score"])

    return docs.mapInArrow(run, schema)
