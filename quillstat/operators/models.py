"""REGRESSION, LOGISTIC REGRESSION, GLM, FACTOR, RELIABILITY, ROC and QUICK CLUSTER: one-pass cross products, small algebra on the driver."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat import ordering
from quillstat.frame import Frame
from quillstat.functions import special as S


#: Most cells of a design, which are coded on the driver.
CELLS = 100_000


def cross_products(df: DataFrame, terms: list[Column], w: Column) -> np.ndarray:
    """Sum of w * t * t' in one pass; its size depends on the terms only."""
    k = len(terms)
    sums = df.agg(*[F.sum(w * terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = sums[f"s{i}_{j}"] or 0.0
    return out


def _complete(frame: Frame, names: list[str]) -> DataFrame:
    return frame.cases().where(reduce(lambda a, b: a & b, [frame.valid(n).isNotNull() for n in names]))


def swept(a: np.ndarray, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(inverse, used) of a symmetric matrix over its pivots in order; a term that is a combination of those before it is not used, its rows are 0."""
    used, k = np.zeros(len(a), bool), len(a)
    for j in range(k):
        at = np.flatnonzero(used)
        left = a[j, j] - a[j, at] @ np.linalg.solve(a[np.ix_(at, at)], a[at, j]) if len(at) else a[j, j]
        used[j] = left > tolerance * a[j, j] > 0
    out, at = np.zeros((k, k)), np.flatnonzero(used)
    out[np.ix_(at, at)] = np.linalg.inv(a[np.ix_(at, at)])
    return out, used


def regression(frame: Frame, y: str, xs: list[str]) -> dict:
    """Ordinary least squares with a constant: coefficients, standard errors, t, p, R2 and the ANOVA sums.

    Terms are centred first, for accuracy. A term that the ones before it determine gets the coefficient 0 and no t.
    """
    names = [*xs, y]
    cases = _complete(frame, names)
    w = F.col("__w")
    means = cases.agg(F.sum(w).alias("n"), *[(F.sum(w * frame.valid(v)) / F.sum(w)).alias(v) for v in names]).first()
    centred = [frame.valid(v).cast("double") - F.lit(float(means[v])) for v in names]
    s = cross_products(cases, centred, w)
    k, n = len(xs), float(means["n"])
    inverse, used = swept(s[:k, :k])
    b = inverse @ s[:k, k]
    total = s[k, k]
    model = float(b @ s[:k, k])
    resid = total - model
    df = n - used.sum() - 1
    ratio = lambda a, c: a / c if c else math.nan
    mse = ratio(resid, df)
    m = np.array([means[v] for v in xs])
    constant = means[y] - b @ m
    se = np.sqrt(mse * np.r_[1 / n + m @ inverse @ m, np.diag(inverse)])
    coef = np.r_[constant, b]
    t = np.array([ratio(c, e) for c, e in zip(coef, se, strict=True)])
    return {"terms": ["(Constant)", *xs], "b": coef, "se": se, "t": t, "p": np.array([S.t_two_sided(v, df) for v in t]), "r2": ratio(model, total), "ss_model": model, "ss_residual": resid, "df_residual": df, "f": ratio(ratio(model, used.sum()), mse), "n": n, "cov": mse * inverse}


def predict(frame: Frame, fit: dict, into: str = "pred", residual: tuple[str, str] | None = None) -> DataFrame:
    value = reduce(lambda a, c: a + frame.valid(c[0]) * float(c[1]), zip(fit["terms"][1:], fit["b"][1:], strict=True), F.lit(float(fit["b"][0])))
    out = frame.df.withColumn(into, value)
    return out.withColumn(residual[0], frame.valid(residual[1]) - F.col(into)) if residual else out


def indicators(frame: Frame, name: str, most: int = 1000) -> list[tuple[str, Column]]:
    """(label, 0/1 column) of each value of a categorical variable but the last, which is the reference."""
    values = [r[0] for r in frame.cases().select(frame.valid(name).alias("v")).where("v is not null").distinct().orderBy("v").limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{name} has more than {most} values")
    return [(f"{name}({v})", (frame.valid(name) == v).cast("double")) for v in values[:-1]]


def logistic(frame: Frame, y: str, xs: list[str], rounds: int = 20, tolerance: float = 1e-8, categorical: list[str] = ()) -> dict:
    """Binary logit by Newton steps; each is one aggregation of gradient and Hessian. Categorical predictors become indicators of all values but the last."""
    cases = _complete(frame, [y, *xs])
    coded = [t for x in xs for t in (indicators(frame, x) if x in categorical else [(x, frame.valid(x).cast("double"))])]
    terms, xs = [F.lit(1.0), *[c for _, c in coded]], [n for n, _ in coded]
    w, target = F.col("__w"), frame.valid(y).cast("double")
    b = np.zeros(len(terms))
    for _ in range(rounds):
        eta = reduce(lambda a, c: a + c, [t * float(v) for t, v in zip(terms, b, strict=True)])
        p = 1 / (1 + F.exp(-eta))
        spread = w * p * (1 - p)
        k = len(terms)
        row = cases.agg(*[F.sum(w * (target - p) * t).alias(f"g{i}") for i, t in enumerate(terms)], *[F.sum(spread * terms[i] * terms[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)], F.sum(w * F.log(F.when(target == 1, p).otherwise(1 - p))).alias("ll")).first()
        g = np.array([row[f"g{i}"] for i in range(k)])
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        inverse, _ = swept(h)
        step = inverse @ g
        b = b + step
        if np.abs(step).max() < tolerance:
            break
    se = np.sqrt(np.diag(inverse))
    wald = np.array([(v / e) ** 2 if e else math.nan for v, e in zip(b, se, strict=True)])
    return {"terms": ["Constant", *xs], "b": b, "se": se, "wald": wald, "p": np.array([1 - S.chisq_cdf(v, 1) if v == v else v for v in wald]), "exp_b": np.exp(b), "minus_2ll": -2 * row["ll"], "columns": terms}


def classification(frame: Frame, fit: dict, y: str, names: list[str], cut: float = 0.5) -> DataFrame:
    """observed, predicted (probability above ``cut``) and weight of the complete cases of a logistic fit."""
    eta = reduce(lambda a, c: a + c, [t * float(v) for t, v in zip(fit["columns"], fit["b"], strict=True)])
    p = 1 / (1 + F.exp(-eta))
    return _complete(frame, [y, *names]).groupBy(frame.valid(y).alias("observed"), (p > cut).cast("int").alias("predicted")).agg(F.sum("__w").alias("n"))


def glm(frame: Frame, y: str, factors: list[str], interactions: list[tuple[str, ...]] = (), kind: int = 3) -> dict[str, tuple[float, float, float]]:
    """Univariate ANOVA: (sum of squares, df, F) of each term of type 1, 2 or 3. Cases are reduced to cells first; effects are coded on cells."""
    cases = _complete(frame, [y, *factors])
    w = F.col("__w")
    mean = cases.agg(F.try_divide(F.sum(w * frame.valid(y)), F.sum(w)).cast("double")).first()[0] or 0.0
    x = frame.valid(y).cast("double") - F.lit(mean)  # sums of squares of a large mean would swallow those of the effects
    cells = cases.groupBy(*factors).agg(F.sum(w).alias("__n"), F.sum(w * x).alias("__s"), F.sum(w * x * x).alias("__q")).limit(CELLS + 1).collect()
    if len(cells) > CELLS:
        raise ValueError(f"more than {CELLS} cells")
    n, s, q = (np.array([c[k] for c in cells], float) for k in ("__n", "__s", "__q"))
    effects = {}
    for f in factors:
        levels = sorted({c[f] for c in cells})
        at = np.array([levels.index(c[f]) for c in cells])
        m = np.zeros((len(cells), len(levels) - 1))
        for j in range(len(levels) - 1):
            m[at == j, j] = 1
        m[at == len(levels) - 1] = -1
        effects[(f,)] = m
    for t in interactions:
        m = effects[(t[0],)]
        for f in t[1:]:
            m = (m[:, :, None] * effects[(f,)][:, None, :]).reshape(len(cells), -1)
        effects[tuple(t)] = m
    terms = list(effects)

    def residual(used) -> float:
        d = np.hstack([np.ones((len(cells), 1)), *[effects[t] for t in used]])
        b = np.linalg.lstsq(d.T @ (d * n[:, None]), d.T @ s, rcond=None)[0]
        return float(q.sum() - b @ (d.T @ s))

    full = residual(terms)
    free = n.sum() - 1 - sum(effects[t].shape[1] for t in terms)
    out = {}
    for i, t in enumerate(terms):
        if kind == 1:
            ss = residual(terms[:i]) - residual(terms[: i + 1])
        elif kind == 2:
            rest = [u for u in terms if not set(t) <= set(u)]
            ss = residual(rest) - residual([*rest, t])
        else:
            ss = residual([u for u in terms if u != t]) - full
        k = effects[t].shape[1]
        out["*".join(t)] = (ss, k, ss / k / (full / free))
    return out


def correlation_matrix(frame: Frame, names: list[str]) -> tuple[np.ndarray, float]:
    cases, w = _complete(frame, names), F.col("__w")
    means = cases.agg(F.sum(w).alias("__n"), *[(F.sum(w * frame.valid(v)) / F.sum(w)).alias(v) for v in names]).first()
    s = cross_products(cases, [frame.valid(v).cast("double") - F.lit(float(means[v])) for v in names], w)
    d = np.sqrt(np.diag(s))
    return s / np.outer(d, d), float(means["__n"])


def factor(frame: Frame, names: list[str], extraction: str = "pc", min_eigen: float = 1.0, rotation: str | None = "varimax", rounds: int = 25) -> dict:
    """Principal components or principal axis factoring of the correlation matrix, with Kaiser-normalised orthogonal rotation."""
    r, n = correlation_matrix(frame, names)
    values = np.linalg.eigvalsh(r)[::-1]
    k = max(1, int((values >= min_eigen).sum()))
    reduced, communal = r.copy(), np.ones(len(r))
    if extraction == "paf":
        communal = 1 - 1 / np.maximum(np.diag(np.linalg.pinv(r)), 1.0)
    for _ in range(1 if extraction == "pc" else rounds):
        np.fill_diagonal(reduced, communal)
        e, v = np.linalg.eigh(reduced)
        loadings = v[:, ::-1][:, :k] * np.sqrt(np.maximum(e[::-1][:k], 0))
        fresh = (loadings**2).sum(1)
        done = np.abs(fresh - communal).max() < 1e-3
        communal = fresh
        if done and extraction != "pc":
            break
    loadings = loadings * np.where(loadings.sum(0) < 0, -1, 1)
    inverse = np.linalg.pinv(r)
    partial = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    off = ~np.eye(len(r), dtype=bool)
    kmo = (r[off] ** 2).sum() / ((r[off] ** 2).sum() + (partial[off] ** 2).sum())
    gamma = {"varimax": 1.0, "quartimax": 0.0, "equamax": k / 2}.get(rotation or "")
    rotated = rotate(loadings, gamma) if gamma is not None and k > 1 else loadings
    out = {"eigenvalues": values, "percent": 100 * values / len(r), "loadings": loadings, "rotated": rotated, "communalities": (loadings**2).sum(1), "kmo": kmo, "n": n}
    if rotation == "promax" and k > 1:
        out["rotated"], out["structure"], out["factor_correlations"] = promax(loadings)
    return out


def promax(loadings: np.ndarray, power: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pattern, structure, factor correlations): an oblique rotation of varimax loadings towards their powers."""
    start = rotate(loadings, 1.0)
    norm = np.sqrt((start**2).sum(1, keepdims=True))
    a = start / norm
    target = a * np.abs(a) ** (power - 1)
    turn = np.linalg.lstsq(a, target, rcond=None)[0]
    turn = turn * np.sqrt(np.diag(np.linalg.inv(turn.T @ turn)))  # factors of variance 1
    pattern = a @ turn * norm
    inverse = np.linalg.inv(turn)
    between = inverse @ inverse.T
    return pattern, pattern @ between, between


def rotate(loadings: np.ndarray, gamma: float, rounds: int = 100) -> np.ndarray:
    """Orthomax rotation with Kaiser's weights: each pair of factors is turned by the angle that maximises the criterion in their plane.

    As complex numbers z = (x + iy)^2 of a pair, the criterion depends on the angle through the real part of a quartic moment's phase.
    """
    h = np.sqrt((loadings**2).sum(1, keepdims=True))
    a = loadings / h
    p, k = a.shape
    for _ in range(rounds):
        most = 0.0
        for i in range(k):
            for j in range(i + 1, k):
                z = (a[:, i] + 1j * a[:, j]) ** 2
                angle = np.angle((z**2).sum() - gamma / p * z.sum() ** 2) / 4
                turned = (a[:, i] + 1j * a[:, j]) * np.exp(-1j * angle)
                a[:, i], a[:, j] = turned.real, turned.imag
                most = max(most, abs(angle))
        if most < 1e-10:
            break
    return a * h


def reliability(frame: Frame, names: list[str]) -> DataFrame:
    """Cronbach's alpha over complete cases (weights count)."""
    cases = _complete(frame, names)
    total = reduce(lambda a, b: a + b, [frame.valid(v).cast("double") for v in names])
    from quillstat.operators.aggregate import moments

    var = lambda c: moments(frame, c)["variance"]
    k = len(names)
    out = cases.agg(F.sum("__w").alias("n"), *[var(frame.valid(v).cast("double")).alias(f"v{i}") for i, v in enumerate(names)], var(total).alias("vt"))
    parts = reduce(lambda a, b: a + b, [F.col(f"v{i}") for i in range(k)])
    return out.select("n", (k / (k - 1) * (1 - F.try_divide(parts, F.col("vt")))).alias("alpha"))


def reliability_items(frame: Frame, names: list[str]) -> DataFrame:
    """A row an item: mean and variance of the scale without it, its correlation with the rest, and alpha without it; one pass over complete cases."""
    from quillstat.operators.aggregate import moments

    cases, k = _complete(frame, names), len(names)
    x = {v: frame.valid(v).cast("double") for v in names}
    add = lambda a, b: a + b
    total = reduce(add, x.values())
    aggs = []
    for i, v in enumerate(names):
        rest, own, whole = moments(frame, total - x[v]), moments(frame, x[v]), moments(frame, total)
        aggs += [rest["mean"].alias(f"m{i}"), rest["variance"].alias(f"r{i}"), own["variance"].alias(f"v{i}")]
    one = cases.agg(*aggs, whole["variance"].alias("t"))
    every = reduce(add, [F.col(f"v{i}") for i in range(k)])
    rows = []
    for i, v in enumerate(names):
        rest, own = F.col(f"r{i}"), F.col(f"v{i}")
        r = F.try_divide(F.col("t") - rest - own, 2 * F.sqrt(rest * own))
        alpha = (k - 1) / (k - 2) * (1 - F.try_divide(every - own, rest)) if k > 2 else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(v).alias("item"), F.col(f"m{i}").alias("mean_if_deleted"), rest.alias("variance_if_deleted"), r.alias("item_total_r"), alpha.alias("alpha_if_deleted")))
    return one.select(F.inline(F.array(*rows)))


def split_half(frame: Frame, first: list[str], second: list[str]) -> DataFrame:
    from quillstat.operators.aggregate import moments

    a, b = (reduce(lambda x, y: x + y, [frame.valid(v).cast("double") for v in names]) for names in (first, second))
    var = lambda c: moments(frame, c)["variance"]
    out = _complete(frame, [*first, *second]).agg(var(a).alias("va"), var(b).alias("vb"), var(a + b).alias("vt"))
    r = F.try_divide(F.col("vt") - F.col("va") - F.col("vb"), 2 * F.sqrt(F.col("va") * F.col("vb")))
    na, nb = len(first), len(second)
    k = (1 - r * r) * (na * nb / (na + nb) ** 2)
    return out.select(r.alias("r"), F.try_divide(2 * r, 1 + r).alias("spearman_brown"), F.try_divide(F.sqrt(r**4 + 4 * r * r * k) - r * r, 2 * k).alias("spearman_brown_unequal"), F.try_divide(2 * (F.col("vt") - F.col("va") - F.col("vb")), F.col("vt")).alias("guttman"))


def roc_cells(frame: Frame, x: str, state: str, positive) -> DataFrame:
    """Distinct x with weights of positive and negative cases, and those of greater x."""
    hit = frame.valid(state) == positive
    c = frame.cases().where(frame.valid(x).isNotNull() & frame.valid(state).isNotNull()).groupBy(frame.valid(x).alias("x")).agg(F.sum(F.when(hit, F.col("__w")).otherwise(0.0)).alias("pos"), F.sum(F.when(hit, 0.0).otherwise(F.col("__w"))).alias("neg"))
    # The weight of positive cases and that of all are cumulated from the greatest value down; both runs agree on the order.
    c = ordering.ranked(c.withColumn("both", F.col("pos") + F.col("neg")), [], "x", "both", descending=True).select("x", "pos", "neg", "both", (F.col("__cc") - F.col("both")).alias("above"))
    return ordering.ranked(c, [], "x", "pos", descending=True).select("x", "pos", "neg", (F.col("__cc") - F.col("pos")).alias("pos_above"), (F.col("above") - F.col("__cc") + F.col("pos")).alias("neg_above"))


def roc(frame: Frame, x: str, state: str, positive) -> DataFrame:
    """Area, its standard error from the counts, and the numbers of cases."""
    c = roc_cells(frame, x, state, positive)
    n = c.agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    c = c.crossJoin(F.broadcast(n))
    p, q, pa, na = (F.col(k) for k in ("pos", "neg", "pos_above", "neg_above"))
    neg_below = F.col("__n") - na - q
    s = c.agg(F.sum(q * (pa + p / 2)).alias("s"), F.sum(q * (pa**2 + pa * p + p**2 / 3)).alias("s1"), F.sum(p * (neg_below**2 + neg_below * q + q**2 / 3)).alias("s2"), F.max("__p").alias("n_positive"), F.max("__n").alias("n_negative"))
    n1, n2 = F.col("n_positive"), F.col("n_negative")
    s = s.withColumn("auc", F.try_divide(F.col("s"), n1 * n2)).withColumn("q1", F.try_divide(F.col("s1"), n2 * n1**2)).withColumn("q2", F.try_divide(F.col("s2"), n1 * n2**2))
    a = F.col("auc")
    return s.withColumn("se", F.sqrt(F.try_divide(a * (1 - a) + (n1 - 1) * (F.col("q1") - a * a) + (n2 - 1) * (F.col("q2") - a * a), n1 * n2))).select("n_positive", "n_negative", "auc", "se")


def roc_coordinates(frame: Frame, x: str, state: str, positive) -> DataFrame:
    c = roc_cells(frame, x, state, positive)
    n = c.agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    return c.crossJoin(F.broadcast(n)).select(F.col("x").alias("cutoff"), F.try_divide(F.col("pos_above") + F.col("pos"), F.col("__p")).alias("sensitivity"), F.try_divide(F.col("neg_above") + F.col("neg"), F.col("__n")).alias("one_minus_specificity"))


def quick_cluster(frame: Frame, names: list[str], k: int, rounds: int = 10) -> tuple[np.ndarray, DataFrame]:
    """k-means from rows of the identity matrix, ties to the lowest cluster; centres in order of the first variable, and the cases with their cluster."""
    cases = _complete(frame, names)
    centres = np.eye(k, len(names))
    xs = [frame.valid(v).cast("double") for v in names]

    def nearest(centres):
        far = [reduce(lambda a, b: a + b, [(x - float(v)) * (x - float(v)) for x, v in zip(xs, c, strict=True)]) for c in centres]
        out = F.lit(len(far) - 1)
        for i in reversed(range(len(far) - 1)):
            out = F.when(reduce(lambda a, b: a & b, [far[i] <= f for f in far[i + 1 :]]), i).otherwise(out)
        return out

    for _ in range(rounds):
        rows = cases.groupBy(nearest(centres).alias("__c")).agg(*[(F.sum(F.col("__w") * x) / F.sum("__w")).alias(f"m{i}") for i, x in enumerate(xs)]).collect()
        fresh = centres.copy()
        for r in rows:
            fresh[r["__c"]] = [r[f"m{i}"] for i in range(len(names))]
        if np.allclose(fresh, centres, rtol=0, atol=1e-12):
            break
        centres = fresh
    centres = centres[np.argsort(centres[:, 0], kind="stable")]
    return centres, frame.df.withColumn("cluster", nearest(centres) + 1)
