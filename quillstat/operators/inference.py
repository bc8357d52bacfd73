"""T-TEST, ONEWAY, CORRELATIONS and NPAR TESTS: statistics as aggregates, tails on one row."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat import ordering
from quillstat.frame import Frame
from quillstat.functions import special as S
from quillstat.operators.aggregate import moments


def _groups(frame: Frame, x: str, by: str) -> DataFrame:
    m = moments(frame, frame.valid(x).cast("double"))
    return frame.cases().where(frame.valid(x).isNotNull() & frame.valid(by).isNotNull()).groupBy(F.col(by).alias("g")).agg(*[m[k].alias(k) for k in ("n", "mean", "variance", "sum")])


def _two_sided(t: Column, df: Column) -> Column:
    """Two-sided probability of Student's t."""
    return 2 * (1 - S.distribution("cdf.t", F.abs(t), df))


def _t_test(m: DataFrame, difference: Column, confidence: float) -> DataFrame:
    """t, df, two-sided p and the interval of a mean difference, from n, mean, sd and se_mean."""
    out = m.withColumn("difference", difference).withColumn("t", F.try_divide("difference", "se_mean")).withColumn("df", F.col("n") - 1)
    half = S.distribution("idf.t", F.lit(0.5 + confidence / 2), F.col("df")) * F.col("se_mean")
    return out.withColumn("p", _two_sided(F.col("t"), F.col("df"))).withColumn("ci_low", F.col("difference") - half).withColumn("ci_high", F.col("difference") + half)


def t_one_sample(frame: Frame, x: str, value: float, confidence: float = 0.95) -> DataFrame:
    m = moments(frame, frame.valid(x).cast("double"))
    return _t_test(frame.cases().agg(*[m[k].alias(k) for k in ("n", "mean", "sd", "se_mean")]), F.col("mean") - value, confidence)


def t_paired(frame: Frame, a: str, b: str, confidence: float = 0.95) -> DataFrame:
    m = moments(frame, (frame.valid(a) - frame.valid(b)).cast("double"))
    return _t_test(frame.cases().agg(*[m[k].alias(k) for k in ("n", "mean", "sd", "se_mean")]), F.col("mean"), confidence)


def t_independent(frame: Frame, x: str, by: str, one, two, confidence: float = 0.95) -> DataFrame:
    """Pooled and unequal-variance t of two groups with p and intervals of the difference, from conditional moments in one pass."""
    v = frame.valid(x).cast("double")
    a, b = (moments(frame, F.when(frame.valid(by) == g, v)) for g in (one, two))
    s = frame.cases().agg(*[m[k].alias(f"{p}{k}") for p, m in (("a_", a), ("b_", b)) for k in ("n", "mean", "variance")])
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("a_n", "b_n", "a_mean", "b_mean", "a_variance", "b_variance"))
    div = F.try_divide
    pooled = div((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    e1, e2 = div(v1, n1), div(v2, n2)
    s = s.withColumns({"difference": m1 - m2, "se_pooled": F.sqrt(pooled * (div(F.lit(1.0), n1) + div(F.lit(1.0), n2))), "se_unequal": F.sqrt(e1 + e2)})
    s = s.withColumns({"df_pooled": n1 + n2 - 2, "df_unequal": div((e1 + e2) ** 2, div(e1**2, n1 - 1) + div(e2**2, n2 - 1))})
    for kind in ("pooled", "unequal"):
        t, df, se = F.col(f"t_{kind}"), F.col(f"df_{kind}"), F.col(f"se_{kind}")
        half = S.distribution("idf.t", F.lit(0.5 + confidence / 2), df) * se
        s = s.withColumn(f"t_{kind}", div(F.col("difference"), se)).withColumns({f"p_{kind}": _two_sided(t, df), f"ci_low_{kind}": F.col("difference") - half, f"ci_high_{kind}": F.col("difference") + half})
    return s


def levene(frame: Frame, x: str, by: str) -> DataFrame:
    """F of the absolute deviations from the group means."""
    g = _groups(frame, x, by).select(F.col("g").alias("__g"), F.col("mean").alias("__mean"))
    dev = frame.cases().join(g, frame.valid(by) == F.col("__g")).withColumn("__d", F.abs(frame.valid(x) - F.col("__mean"))).where("__d is not null")
    return anova(Frame(dev.withColumnRenamed("__w", "__wt"), weight_by="__wt"), "__d", "__g")


def anova(frame: Frame, x: str, by: str) -> DataFrame:
    """Between and within sums of squares, degrees of freedom, F and its significance. The grand mean is taken over the groups, of which there is a row each."""
    g, every = _groups(frame, x, by), Window.partitionBy()
    g = g.withColumn("grand", F.try_divide(F.sum(F.col("n") * F.col("mean")).over(every), F.sum("n").over(every)))
    out = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ss_between"), F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("variance")).otherwise(0.0)).alias("ss_within"))
    out = out.withColumn("df_between", (F.col("k") - 1).cast("double")).withColumn("df_within", F.col("n") - F.col("k"))
    out = out.withColumn("f", F.try_divide(F.try_divide("ss_between", "df_between"), F.try_divide("ss_within", "df_within")))
    return out.withColumn("p", S.distribution("sig.f", F.col("f"), F.col("df_between"), F.col("df_within"))).drop("k")


def contrast(frame: Frame, x: str, by: str, coefficients: dict) -> dict[str, float]:
    """A contrast of group means with pooled and with unequal variances."""
    g = {r["g"]: r for r in _groups(frame, x, by).where(F.col("g").isin(*coefficients)).collect()}
    w = anova(frame, x, by).first()
    value = sum(c * g[k]["mean"] for k, c in coefficients.items())
    se = math.sqrt(w["ss_within"] / w["df_within"] * sum(c * c / g[k]["n"] for k, c in coefficients.items())) if w["df_within"] else 0.0
    parts = [c * c * (g[k]["variance"] or 0.0) / g[k]["n"] for k, c in coefficients.items()]
    spread = sum(p * p / (g[k]["n"] - 1) for p, k in zip(parts, coefficients, strict=True) if p)
    free = sum(parts) ** 2 / spread if spread else 0.0
    t = value / se if se else math.nan
    unequal = value / math.sqrt(sum(parts)) if sum(parts) else math.nan
    return {"value": value, "t": t, "df": w["df_within"], "p": S.t_two_sided(t, w["df_within"]) if se else math.nan, "t_unequal": unequal, "df_unequal": free, "p_unequal": S.t_two_sided(unequal, free) if free else math.nan}


def post_hoc(frame: Frame, x: str, by: str) -> DataFrame:
    """All pairs of groups: difference, standard error, t, and p by LSD, Bonferroni, Sidak, Scheffe, Tukey and, with each pair's own variances, Games-Howell. Groups, not cases, are paired."""
    g = _groups(frame, x, by).select("g", "n", "mean", "variance")
    w = anova(frame, x, by)
    a, b = (g.toDF(*[f"{p}_{c}" for c in g.columns]) for p in "ab")
    k = g.agg(F.count("*").cast("double").alias("groups"))
    pairs = a.join(b, F.col("a_g") < F.col("b_g")).crossJoin(F.broadcast(w.select("ss_within", "df_within"))).crossJoin(F.broadcast(k))  # one row each
    div = F.try_divide
    se = F.sqrt(div("ss_within", "df_within") * (div(F.lit(1.0), "a_n") + div(F.lit(1.0), "b_n")))
    pairs = pairs.withColumn("difference", F.col("a_mean") - F.col("b_mean")).withColumn("se", se).withColumn("t", div("difference", "se"))
    m = F.col("groups") * (F.col("groups") - 1) / 2
    pairs = pairs.withColumn("lsd", _two_sided(F.col("t"), F.col("df_within"))).withColumn("bonferroni", F.least(F.lit(1.0), F.col("lsd") * m)).withColumn("sidak", 1 - F.pow(1 - F.col("lsd"), m))
    pairs = pairs.withColumn("scheffe", S.distribution("sig.f", div(F.col("t") ** 2, F.col("groups") - 1), F.col("groups") - 1, F.col("df_within")))
    pairs = pairs.withColumn("tukey", S.distribution("sig.srange", F.abs("t") * F.sqrt(F.lit(2.0)), F.col("groups"), F.col("df_within")))
    e1, e2 = div("a_variance", "a_n"), div("b_variance", "b_n")
    pairs = pairs.withColumn("se_own", F.sqrt(e1 + e2)).withColumn("df_own", div((e1 + e2) ** 2, div(e1**2, F.col("a_n") - 1) + div(e2**2, F.col("b_n") - 1)))
    pairs = pairs.withColumn("games_howell", S.distribution("sig.srange", F.abs(div("difference", "se_own")) * F.sqrt(F.lit(2.0)), F.col("groups"), F.col("df_own")))
    return pairs.select(F.col("a_g").alias("g1"), F.col("b_g").alias("g2"), "difference", "se", "t", "lsd", "bonferroni", "sidak", "scheffe", "tukey", "se_own", "df_own", "games_howell")


def correlations(frame: Frame, names: list[str], listwise: bool = False) -> DataFrame:
    """Pearson r, n, t, two-sided p, covariance and cross-product deviations of each pair; all pairs in one pass.

    Weighted sums are taken of deviations from the means over all cases, which are aggregated first.
    """
    cases, w = frame.cases(), F.col("__w")
    if listwise:
        cases = cases.where(reduce(lambda a, b: a & b, [frame.valid(n).isNotNull() for n in names]))
    about = {n: 0.0 for n in names}
    if frame.weight_by is not None:
        first = cases.agg(*[F.try_divide(F.sum(w * frame.valid(n)), F.sum(F.when(frame.valid(n).isNotNull(), w))).cast("double").alias(f"m{i}") for i, n in enumerate(names)]).first()
        about = {n: first[f"m{i}"] or 0.0 for i, n in enumerate(names)}
    aggs, pairs = [], [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for i, (a, b) in enumerate(pairs):
        both = frame.valid(a).isNotNull() & frame.valid(b).isNotNull()
        x, y = (F.when(both, frame.valid(v).cast("double") - F.lit(about[v])) for v in (a, b))
        aggs.append(F.sum(F.when(both, w)).alias(f"n{i}"))
        if frame.weight_by is None:
            aggs += [F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"r{i}"), (F.covar_pop(x, y) * F.count(x)).alias(f"d{i}")]
        else:
            n, sx, sy = F.sum(F.when(both, w)), F.sum(w * x), F.sum(w * y)
            sxy, sxx, syy = F.sum(w * x * y) - F.try_divide(sx * sy, n), F.sum(w * x * x) - F.try_divide(sx * sx, n), F.sum(w * y * y) - F.try_divide(sy * sy, n)
            aggs += [F.try_divide(sxy, F.sqrt(sxx * syy)).alias(f"r{i}"), sxy.alias(f"d{i}")]
    one = cases.agg(*aggs)
    rows = []
    for i, (a, b) in enumerate(pairs):
        n, r, d = (F.col(f"{k}{i}") for k in ("n", "r", "d"))
        t = r * F.sqrt(F.try_divide(n - 2, 1 - r * r))
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), r.alias("r"), t.alias("t"), d.alias("cross_product"), F.try_divide(d, n - 1).alias("covariance")))
    return one.select(F.inline(F.array(*rows))).withColumn("p", F.when(F.abs("r") >= 1, 0.0).otherwise(_two_sided(F.col("t"), F.col("n") - 2)))


# -- nonparametric tests -----------------------------------------------------------------


def _normal_two_sided(z: Column) -> Column:
    return 2 * S.distribution("cdfnorm", -F.abs(z))


def mean_ranks(df: DataFrame, x: Column, w: Column, keep: list[str] = ()) -> DataFrame:
    """Distinct x with weight, mean rank and the keep columns' cells; ranks are cumulated over distinct values."""
    cells = df.where(x.isNotNull() & (w > 0)).groupBy(x.alias("x"), *keep).agg(F.sum(w).alias("c"))
    values = ordering.ranked(cells.groupBy("x").agg(F.sum("c").alias("tw")), [], "x", "tw")
    return cells.join(values.select("x", "tw", (F.col("__cc") - (F.col("tw") - 1) / 2).alias("rank")), "x")


def mann_whitney(frame: Frame, x: str, by: str, one, two) -> DataFrame:
    cases = frame.cases().where(frame.valid(by).isin(one, two))
    r = mean_ranks(cases, frame.valid(x), F.col("__w"), [by])
    first = F.col(by) == one
    out = r.agg(F.sum(F.when(first, F.col("c"))).alias("n1"), F.sum(F.when(~first, F.col("c"))).alias("n2"), F.sum(F.when(first, F.col("c") * F.col("rank"))).alias("rank_sum_1"), F.sum(F.when(~first, F.col("c") * F.col("rank"))).alias("rank_sum_2"), F.sum(F.col("c") * (F.col("tw") ** 2 - 1)).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u1 = n1 * n2 + n1 * (n1 + 1) / 2 - F.col("rank_sum_1")
    u = F.least(u1, n1 * n2 - u1)
    return out.withColumn("u", u).withColumn("z", F.try_divide(F.col("u") - n1 * n2 / 2, F.sqrt(F.try_divide(n1 * n2, n * (n - 1)) * ((n**3 - n - F.col("ties")) / 12)))).withColumn("p", _normal_two_sided(F.col("z"))).drop("ties")


def kruskal_wallis(frame: Frame, x: str, by: str) -> DataFrame:
    r = mean_ranks(frame.cases().where(frame.valid(by).isNotNull()), frame.valid(x), F.col("__w"), [by])
    ties = r.agg(F.sum(F.col("c") * (F.col("tw") ** 2 - 1)).alias("ties"))
    g = r.groupBy(by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("s"))
    out = g.agg(F.sum("n").alias("n"), F.sum(F.try_divide(F.col("s") ** 2, F.col("n"))).alias("q"), (F.count("*") - 1).cast("double").alias("df")).crossJoin(F.broadcast(ties))
    n = F.col("n")
    return out.withColumn("h", F.try_divide(F.try_divide(F.lit(12.0), n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.try_divide("ties", n**3 - n))).withColumn("p", S.distribution("sig.chisq", F.col("h"), F.col("df"))).select("n", "df", "h", "p")


def _by_case(frame: Frame, names: list[str], keep: list[str] = ()) -> DataFrame:
    return frame.cases().where(reduce(lambda a, b: a & b, [frame.valid(v).isNotNull() for v in names])).select("__w", *keep, *[frame.valid(v).cast("double").alias(v) for v in names])


def friedman(frame: Frame, names: list[str]) -> DataFrame:
    """Chi-square of the ranks within each case, with tie correction, and Kendall's W. Ranks within a case are plain expressions."""
    c, k = _by_case(frame, names), len(names)
    ranks = {v: sum(((F.col(u) < F.col(v)).cast("double") + (F.col(u) == F.col(v)).cast("double") / 2 for u in names if u != v), F.lit(0.0)) + 1 for v in names}
    tied = sum((sum(((F.col(u) == F.col(v)).cast("double") for u in names), F.lit(0.0)) ** 2 - 1 for v in names), F.lit(0.0))
    out = c.agg(F.sum("__w").alias("n"), *[F.sum(F.col("__w") * r).alias(f"r_{v}") for v, r in ranks.items()], F.sum(F.col("__w") * tied).alias("ties"))
    n = F.col("n")
    q = sum((F.col(f"r_{v}") ** 2 for v in names), F.lit(0.0))
    chi = F.try_divide(F.try_divide(F.lit(12.0), n * k * (k + 1)) * q - 3 * n * (k + 1), 1 - F.try_divide(F.col("ties"), n * k * (k * k - 1)))
    return out.select("n", chi.alias("chi_square"), F.lit(float(k - 1)).alias("df"), F.try_divide(chi, n * (k - 1)).alias("kendall_w")).withColumn("p", S.distribution("sig.chisq", F.col("chi_square"), F.col("df")))


def cochran(frame: Frame, names: list[str], success: float) -> DataFrame:
    hit = {v: (F.col(v) == success).cast("double") for v in names}
    c, k, w = _by_case(frame, names), len(names), F.col("__w")
    row = sum(hit.values(), F.lit(0.0))
    out = c.agg(F.sum(w).alias("n"), *[F.sum(w * h).alias(f"c_{v}") for v, h in hit.items()], F.sum(w * row).alias("total"), F.sum(w * row**2).alias("rows"))
    squares = sum((F.col(f"c_{v}") ** 2 for v in names), F.lit(0.0))
    return out.select("n", F.try_divide((k - 1) * (k * squares - F.col("total") ** 2), k * F.col("total") - F.col("rows")).alias("q"), F.lit(float(k - 1)).alias("df")).withColumn("p", S.distribution("sig.chisq", F.col("q"), F.col("df")))


def wilcoxon(frame: Frame, a: str, b: str) -> DataFrame:
    c = _by_case(frame, [a, b]).withColumn("d", F.col(a) - F.col(b)).where("d <> 0").withColumn("m", F.abs("d")).withColumn("sign", F.signum("d"))
    r = mean_ranks(c, F.col("m"), F.col("__w"), ["sign"])
    out = r.agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("sign") > 0, F.col("c") * F.col("rank"))), F.lit(0.0)).alias("positive"), F.coalesce(F.sum(F.when(F.col("sign") < 0, F.col("c") * F.col("rank"))), F.lit(0.0)).alias("negative"), F.sum(F.col("c") * (F.col("tw") ** 2 - 1)).alias("ties"))
    n = F.col("n")
    return out.withColumn("z", F.try_divide(F.least("positive", "negative") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))).withColumn("p", _normal_two_sided(F.col("z"))).drop("ties")


def sign_test(frame: Frame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    out = _by_case(frame, [a, b]).agg(F.sum(F.when(d > 0, F.col("__w")).otherwise(0.0)).alias("positive"), F.sum(F.when(d < 0, F.col("__w")).otherwise(0.0)).alias("negative"), F.sum(F.when(d == 0, F.col("__w")).otherwise(0.0)).alias("ties"))
    return out.withColumn("p", F.least(F.lit(1.0), 2 * S.distribution("cdf.binom", F.least("positive", "negative"), F.col("positive") + F.col("negative"), F.lit(0.5))))


def mcnemar(frame: Frame, a: str, b: str, low: float, high: float) -> DataFrame:
    """Exact two-sided p of the changes; capped at 1."""
    out = _by_case(frame, [a, b]).agg(F.sum(F.when((F.col(a) == low) & (F.col(b) == high), F.col("__w")).otherwise(0.0)).alias("n01"), F.sum(F.when((F.col(a) == high) & (F.col(b) == low), F.col("__w")).otherwise(0.0)).alias("n10"))
    return out.withColumn("p", F.least(F.lit(1.0), 2 * S.distribution("cdf.binom", F.least("n01", "n10"), F.col("n01") + F.col("n10"), F.lit(0.5))))


def chi_square_one(frame: Frame, x: str, expected: dict | None = None) -> DataFrame:
    c = frame.cases().where(frame.valid(x).isNotNull()).groupBy(F.col(x).alias("v")).agg(F.sum("__w").alias("o"))
    whole = Window.partitionBy()
    share = F.lit(1.0)
    for v, e in (expected or {}).items():
        share = F.when(F.col("v") == v, float(e)).otherwise(share)
    c = c.withColumn("e", share).withColumn("e", F.try_divide(F.col("e"), F.sum("e").over(whole)) * F.sum("o").over(whole))
    return c.agg(F.sum(F.try_divide((F.col("o") - F.col("e")) ** 2, F.col("e"))).alias("chi_square"), (F.count("*") - 1).cast("double").alias("df"), F.sum("o").alias("n")).withColumn("p", S.distribution("sig.chisq", F.col("chi_square"), F.col("df")))


def binomial(frame: Frame, x: str, cut: float, p: float = 0.5) -> DataFrame:
    """Cases at or below the cut are the first group; the tail is doubled for p = 0.5 only."""
    low = frame.valid(x) <= cut
    out = frame.cases().where(frame.valid(x).isNotNull()).agg(F.sum(F.when(low, F.col("__w")).otherwise(0.0)).alias("n1"), F.sum(F.when(low, 0.0).otherwise(F.col("__w"))).alias("n2"))
    n = F.col("n1") + F.col("n2")
    tail = S.distribution("cdf.binom", F.least("n1", "n2"), n, F.lit(0.5)) * 2 if p == 0.5 else F.when(F.try_divide(F.col("n1"), n) < p, S.distribution("cdf.binom", F.col("n1"), n, F.lit(p))).otherwise(1 - S.distribution("cdf.binom", F.col("n1") - 1, n, F.lit(p)))
    return out.withColumn("p", F.least(F.lit(1.0), tail))


def ks_one_sample(frame: Frame, x: str, family: str, *parameters: float) -> DataFrame:
    """Largest deviations of the sample from a normal (mean, sd), uniform (low, high), poisson (mean) or exponential (mean) distribution; parameters that are not given come from the sample."""
    v = frame.valid(x).cast("double")
    m = moments(frame, v)
    from_sample = {"normal": [m["mean"], m["sd"]], "uniform": [F.min(v), F.max(v)], "poisson": [m["mean"]], "exponential": [m["mean"]]}[family]
    given = [F.max(F.lit(float(p))) for p in parameters] or from_sample
    stats = frame.cases().agg(m["n"].alias("n"), *[c.alias(f"p{i}") for i, c in enumerate(given)])
    cells = ordering.ranked(frame.cases().where(v.isNotNull()).groupBy(v.alias("v")).agg(F.sum("__w").alias("c")), [], "v", "c").withColumnRenamed("__cc", "cc")
    rows = cells.crossJoin(F.broadcast(stats))  # one row
    p0, p1, at = F.col("p0"), F.col("p1") if len(given) > 1 else None, F.col("v")
    cdf = {
        "normal": lambda at: S.distribution("cdf.normal", at, p0, p1),
        "uniform": lambda at: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(at - p0, p1 - p0))),
        "poisson": lambda at: F.when(at < 0, 0.0).otherwise(S.distribution("cdf.poisson", F.floor(at), p0)),
        "exponential": lambda at: F.when(at < 0, 0.0).otherwise(1 - F.exp(-F.try_divide(at, p0))),
    }[family]
    f = rows.withColumn("f", cdf(at)).withColumn("below", cdf(at - 1) if family == "poisson" else F.col("f"))
    out = f.agg(F.max("n").alias("n"), F.max(F.try_divide("cc", "n") - F.col("f")).alias("positive"), F.min(F.try_divide(F.col("cc") - F.col("c"), F.col("n")) - F.col("below")).alias("negative"))
    out = out.withColumn("d", F.greatest("positive", -F.col("negative"))).withColumn("z", F.sqrt("n") * F.col("d"))
    return out.withColumn("p", S.distribution("sig.smirnov", F.col("z")))


def ks_normal(frame: Frame, x: str) -> DataFrame:
    return ks_one_sample(frame, x, "normal")


def runs(frame: Frame, x: str, cut: float) -> DataFrame:
    """Runs at or above the cut in case order; z with a correction below 50 cases."""
    v = frame.valid(x)
    c = frame.cases().where(v.isNotNull()).select(*frame.order, (v >= cut).alias("up"))
    c = ordering.lagged(ordering.numbered(ordering.placed(c, frame._by_order())), {"old": F.col("up")})
    c = c.withColumn("new", F.coalesce(F.col("up") != F.col("old"), F.lit(True)).cast("double"))
    out = c.agg(F.sum("new").alias("runs"), F.sum(F.col("up").cast("double")).alias("np"), F.sum((~F.col("up")).cast("double")).alias("nn"))
    n, a, b = F.col("np") + F.col("nn"), F.col("np"), F.col("nn")
    mu, sd = F.try_divide(2 * a * b, n) + 1, F.sqrt(F.try_divide(2 * a * b * (2 * a * b - n), n * n * (n - 1)))
    gap = F.col("runs") - mu
    z = F.try_divide(F.when(n >= 50, gap).when(gap < -0.5, gap + 0.5).when(gap > 0.5, gap - 0.5).otherwise(0.0), sd)
    return out.withColumn("z", z).withColumn("p", _normal_two_sided(F.col("z")))


def median_test(frame: Frame, x: str, by: str, median: float) -> DataFrame:
    from quillstat.operators.crosstabs import chi_square

    f = Frame(frame.df.withColumn("__above", F.when(frame.valid(x).isNotNull(), (frame.valid(x) > median).cast("int"))), frame.meta, frame.order, frame.weight_by, frame.filter_by)
    return chi_square(f, "__above", by).select("n", "df", F.col("pearson").alias("chi_square"), F.col("pearson_p").alias("p"))


def jonckheere(frame: Frame, x: str, by: str) -> DataFrame:
    """Sum of the Mann-Whitney counts of all ordered pairs of groups, its z with the variance corrected for ties, and p. Cells of value and group are cumulated, cases never paired."""
    c = frame.cases().where(frame.valid(x).isNotNull() & frame.valid(by).isNotNull()).groupBy(frame.valid(x).alias("x"), F.col(by).alias("g")).agg(F.sum("__w").alias("c"))
    groups = c.groupBy("g").agg(F.sum("c").alias("ng"))
    lower = c.toDF("lx", "lg", "lc").groupBy("lg", "lx").agg(F.sum("lc").alias("lc"))
    # For each value of a higher group: weight of the lower groups' values below it, and half of the equal ones.
    every = c.select("x", "g").distinct().join(F.broadcast(groups.select(F.col("g").alias("lg"))), F.col("lg") < F.col("g")).join(c, ["x", "g"])
    marks = every.select("lg", "x", F.col("g"), "c", F.lit(0.0).alias("add")).unionByName(lower.select("lg", F.col("lx").alias("x"), F.lit(None).cast(c.schema["g"].dataType).alias("g"), F.lit(0.0).alias("c"), F.col("lc").alias("add")))
    w = Window.partitionBy("lg").orderBy("x")
    marks = marks.withColumn("le", F.sum("add").over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("eq", F.sum("add").over(Window.partitionBy("lg", "x")))
    j = marks.where("g is not null").agg(F.sum(F.col("c") * (F.col("le") - F.col("eq") / 2)).alias("j"))
    sums = lambda df, c: df.agg(F.sum(c).alias("n"), F.sum(c * c).alias("q"), *[F.sum(e).alias(k) for k, e in (("a", c * (c - 1) * (2 * c + 5)), ("b", c * (c - 1) * (c - 2)), ("d", c * (c - 1)))])
    g = sums(groups, F.col("ng"))
    t = sums(c.groupBy("x").agg(F.sum("c").alias("tx")), F.col("tx")).select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("d").alias("td"))
    out = j.crossJoin(F.broadcast(g)).crossJoin(F.broadcast(t))  # one row each
    n = F.col("n")
    variance = (n * (n - 1) * (2 * n + 5) - F.col("a") - F.col("ta")) / 72 + F.try_divide(F.col("b") * F.col("tb"), 36 * n * (n - 1) * (n - 2)) + F.try_divide(F.col("d") * F.col("td"), 8 * n * (n - 1))
    out = out.withColumn("mean", (n**2 - F.col("q")) / 4).withColumn("z", F.try_divide(F.col("j") - F.col("mean"), F.sqrt(variance)))
    return out.withColumn("p", _normal_two_sided(F.col("z"))).select("n", "j", "mean", "z", "p")
