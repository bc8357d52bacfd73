"""CROSSTABS: cells and statistics of contingency tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.frame import Frame
from quillstat.functions.special import chisq_cdf, distribution, normal_inverse

#: Most cells of a table that statistics are computed of; a table is bounded by its variables' values, not by cases.
CELLS = 250_000


def cells(frame: Frame, row: str, column: str, layers: list[str] = ()) -> DataFrame:
    """Every row-column combination of each layer, with count, row, column and total percent, expected, residual and standardised residuals."""
    by = list(layers)
    seen = frame.cases().where(frame.valid(row).isNotNull() & frame.valid(column).isNotNull()).groupBy(*by, F.col(row).alias("__r"), F.col(column).alias("__c")).agg(F.sum("__w").alias("count"))
    rows, cols = seen.select(*by, "__r").distinct(), seen.select(*by, "__c").distinct()
    grid = rows.join(cols, by) if by else rows.crossJoin(cols)  # the values of two variables, which every table prints
    full = grid.join(seen, [*by, "__r", "__c"], "left").fillna(0.0, ["count"])
    total, rt, ct = (F.sum("count").over(Window.partitionBy(*by, *k)) for k in ((), ("__r",), ("__c",)))
    full = full.withColumns({"row_total": rt, "column_total": ct, "total": total})
    full = full.withColumn("expected", F.try_divide(F.col("row_total") * F.col("column_total"), F.col("total"))).withColumn("residual", F.col("count") - F.col("expected"))
    full = full.withColumns({
        "row_percent": F.try_divide(100 * F.col("count"), F.col("row_total")), "column_percent": F.try_divide(100 * F.col("count"), F.col("column_total")), "total_percent": F.try_divide(100 * F.col("count"), F.col("total")),
        "std_residual": F.try_divide(F.col("residual"), F.sqrt("expected")),
        "adj_residual": F.try_divide(F.col("residual"), F.sqrt(F.col("expected") * (1 - F.try_divide("row_total", "total")) * (1 - F.try_divide("column_total", "total")))),
    })
    return full.withColumnsRenamed({"__r": row, "__c": column})


def chi_square(frame: Frame, row: str, column: str, layers: list[str] = ()) -> DataFrame:
    """Pearson and likelihood-ratio chi-square, degrees of freedom, phi, V and contingency coefficient of each layer, from its cells."""
    c = cells(frame, row, column, layers)
    out = c.groupBy(*layers).agg(
        F.sum(F.try_divide(F.col("residual") ** 2, F.col("expected"))).alias("pearson"),
        (2 * F.sum(F.when(F.col("count") > 0, F.col("count") * F.log(F.try_divide("count", "expected"))).otherwise(0.0))).alias("likelihood_ratio"),
        F.countDistinct(row).alias("r"), F.countDistinct(column).alias("k"), F.sum("count").alias("n"),
    )
    q = F.least("r", "k")
    return out.withColumns({
        "df": ((F.col("r") - 1) * (F.col("k") - 1)).cast("double"), "phi": F.sqrt(F.try_divide("pearson", "n")),
        "cramers_v": F.sqrt(F.try_divide(F.col("pearson"), F.col("n") * (q - 1))), "contingency": F.sqrt(F.try_divide(F.col("pearson"), F.col("pearson") + F.col("n"))),
    }).drop("r", "k").withColumns({f"{k}_p": distribution("sig.chisq", F.col(k), F.col("df")) for k in ("pearson", "likelihood_ratio")})


def table(frame: Frame, row: str, column: str) -> np.ndarray:
    """The table itself, rows and columns in order; refuses more than CELLS cells."""
    seen = frame.cases().where(frame.valid(row).isNotNull() & frame.valid(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.sum("__w").alias("n"))
    found = seen.limit(CELLS + 1).collect()
    if len(found) > CELLS:
        raise ValueError(f"more than {CELLS} cells")
    rows, cols = sorted({x["r"] for x in found}), sorted({x["c"] for x in found})
    out = np.zeros((len(rows), len(cols)))
    for x in found:
        out[rows.index(x["r"]), cols.index(x["c"])] = x["n"]
    return out


def association(t: np.ndarray, x: np.ndarray | None = None, y: np.ndarray | None = None, same: bool = True, confidence: float = 0.95) -> dict[str, float]:
    """Ordinal, nominal and numeric measures of a table; x and y are the row and column values (default 0, 1, ...).

    ``same`` tells whether rows and columns have the same categories, without which there is no kappa. A
    table of one row or one column has no statistics.
    """
    n, r, c = t.sum(), t.sum(1), t.sum(0)
    rows, cols = t.shape
    if rows < 2 or cols < 2:
        return {}
    x = np.arange(rows, dtype=float) if x is None else np.asarray(x, float)
    y = np.arange(cols, dtype=float) if y is None else np.asarray(y, float)
    below = np.zeros((rows + 1, cols + 1))
    below[1:, 1:] = t.cumsum(0).cumsum(1)
    i, j = np.indices(t.shape)
    upper_left, upper_right = below[i, j], below[i, cols] - below[i, j + 1]
    conc, disc = 2 * (t * upper_left).sum(), 2 * (t * upper_right).sum()
    wr, wc = n * n - (r**2).sum(), n * n - (c**2).sum()
    q = min(rows, cols)
    mx, my = (r @ x) / n, (c @ y) / n
    sxx, syy, sxy = r @ (x - mx) ** 2, c @ (y - my) ** 2, (x - mx) @ t @ (y - my)
    pearson = sxy / math.sqrt(sxx * syy)
    rank = lambda m: m.cumsum() - m / 2 + 0.5
    rx, ry = rank(r), rank(c)
    spearman = ((rx - (n + 1) / 2) @ t @ (ry - (n + 1) / 2)) / math.sqrt((r @ (rx - (n + 1) / 2) ** 2) * (c @ (ry - (n + 1) / 2) ** 2))
    h = lambda p: -sum(v / n * math.log(v / n) for v in p.ravel() if v > 0)
    hx, hy, hxy = h(r), h(c), h(t)
    row_max, col_max = t.max(1).sum(), t.max(0).sum()
    out = {
        "tau_b": (conc - disc) / math.sqrt(wr * wc), "tau_c": q * (conc - disc) / (n * n * (q - 1)), "gamma": (conc - disc) / (conc + disc),
        "somers_d_row": (conc - disc) / wc, "somers_d_column": (conc - disc) / wr, "somers_d": 2 * (conc - disc) / (wr + wc),
        "pearson_r": pearson, "spearman": spearman, "linear_by_linear": (n - 1) * pearson**2,
        "lambda": (row_max + col_max - c.max() - r.max()) / (2 * n - r.max() - c.max()), "lambda_row": (col_max - r.max()) / (n - r.max()), "lambda_column": (row_max - c.max()) / (n - c.max()),
        "gk_tau_row": (n * (t**2 / c).sum() - (r**2).sum()) / (n * n - (r**2).sum()), "gk_tau_column": (n * (t**2 / r[:, None]).sum() - (c**2).sum()) / (n * n - (c**2).sum()),
        "uncertainty": 2 * (hx + hy - hxy) / (hx + hy), "uncertainty_row": (hx + hy - hxy) / hx, "uncertainty_column": (hx + hy - hxy) / hy,
        "eta_row": math.sqrt(max(0.0, 1 - sum((t[:, k] @ x**2) - (t[:, k] @ x) ** 2 / c[k] for k in range(cols)) / sxx)), "eta_column": math.sqrt(max(0.0, 1 - sum((t[k] @ y**2) - (t[k] @ y) ** 2 / r[k] for k in range(rows)) / syy)),
    }
    if rows == cols and same and (r @ c) < n**2:
        po, pe = np.trace(t) / n, (r @ c) / n**2
        out["kappa"] = (po - pe) / (1 - pe)
    if t.shape == (2, 2):
        (a, b), (d, e) = t
        out["yates"] = max(abs(a * e - b * d) - n / 2, 0) ** 2 * n / (r.prod() * c.prod())
        out["odds_ratio"] = a * e / (b * d) if b * d else math.inf
        z = normal_inverse(0.5 + confidence / 2)
        cohorts = [("risk_first", a, b, d, e), ("risk_second", b, a, e, d)]
        for name, hit, miss, hit2, miss2 in cohorts:
            if hit and hit2:
                ratio, se = hit * (hit2 + miss2) / (hit2 * (hit + miss)), math.sqrt(miss / (hit * (hit + miss)) + miss2 / (hit2 * (hit2 + miss2)))
                out |= {name: ratio, f"{name}_low": ratio * math.exp(-z * se), f"{name}_high": ratio * math.exp(z * se)}
        if min(a, b, d, e):
            se = math.sqrt(1 / a + 1 / b + 1 / d + 1 / e)
            out |= {"odds_ratio_low": out["odds_ratio"] * math.exp(-z * se), "odds_ratio_high": out["odds_ratio"] * math.exp(z * se)}
        out["fisher_two_sided"], out["fisher_one_sided"] = fisher(t), fisher(t, False)
        out["mcnemar"] = (abs(b - d) - 1) ** 2 / (b + d) if b + d else math.nan
    pe = np.outer(r, c) / n
    out["pearson"] = ((t - pe) ** 2 / pe).sum()
    out["pearson_p"] = 1 - chisq_cdf(out["pearson"], (rows - 1) * (cols - 1))
    return out


def fisher(t: np.ndarray, two_sided: bool = True) -> float:
    """Exact probability of a 2 x 2 table: of all tables no likelier than the one seen, or of the lesser tail with it."""
    (a, b), (c, d) = t.astype(int)
    r, k, n = a + b, a + c, a + b + c + d
    prob = lambda x: math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r)
    seen = prob(a)
    least, most = max(0, r + k - n), min(r, k)
    if not two_sided:
        return min(1.0, sum(map(prob, range(least, a + 1))), sum(map(prob, range(a, most + 1))))
    return min(1.0, sum(p for x in range(max(0, r + k - n), min(r, k) + 1) if (p := prob(x)) <= seen * (1 + 1e-9)))
