"""AGGREGATE: weighted break-group functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.frame import Frame
from quillstat.operators.quantiles import quantile

#: (into, function, variable, arguments...) with a '.' after the function to take user-missing values as valid.
Spec = tuple


def moments(frame: Frame, x: Column) -> dict[str, Column]:
    """n, sum, mean, variance, skewness, kurtosis and their standard errors of x as aggregate expressions over ``frame.cases()``; one pass.

    Without weights they come from Spark's own updates of deviations. With weights they come from power sums of
    x less its mean over all cases, which is aggregated first, so that large means don't swallow the deviations.
    """
    if frame.weight_by is None:
        n, mean, total = F.count(x).cast("double"), F.avg(x), F.sum(x)
        var, s, k = F.var_samp(x), F.skewness(x), F.kurtosis(x)
        steady = F.abs(var) >= 1e-20
        skew = F.when((n > 2) & steady, s * F.try_divide(F.sqrt(n * (n - 1)), n - 2))
        kurt = F.when((n > 3) & steady, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * k + 6))
    else:
        w = F.when(x.isNotNull(), F.col("__w")).otherwise(0.0)
        about = frame.cases().agg(F.try_divide(F.sum(w * x), F.sum(w))).first()[0] or 0.0
        d = F.coalesce(x - F.lit(float(about)), F.lit(0.0))
        n, s1, s2, s3, s4 = F.sum(w), F.sum(w * d), F.sum(w * d * d), F.sum(w * d * d * d), F.sum(w * d * d * d * d)
        off = F.try_divide(s1, n)
        mean, total = off + float(about), F.when(n > 0, F.sum(w * F.coalesce(x, F.lit(0.0))))
        d2 = F.greatest(s2 - n * off**2, F.lit(0.0))
        d3 = s3 - 3 * off * s2 + 2 * n * off**3
        d4 = s4 - 4 * off * s3 + 6 * off**2 * s2 - 3 * n * off**4
        var = F.when(n > 1, F.try_divide(d2, n - 1))
        steady = F.abs(var) >= 1e-20
        skew = F.when((n > 2) & steady, F.try_divide(n * d3, (n - 1) * (n - 2) * var * F.sqrt(var)))
        kurt = F.when((n > 3) & steady, F.try_divide(n * (n + 1) * d4, (n - 1) * (n - 2) * (n - 3) * var**2) - F.try_divide(3 * d2**2, (n - 2) * (n - 3) * var**2))
    se_skew = F.when(n > 2, F.sqrt(F.try_divide(6 * n * (n - 1), (n - 2) * (n + 1) * (n + 3))))
    se_kurt = F.when(n > 3, F.sqrt(F.try_divide(4 * (n * n - 1) * se_skew**2, (n - 3) * (n + 5))))
    return {"n": n, "sum": total, "mean": mean, "variance": var, "sd": F.sqrt(var), "se_mean": F.sqrt(F.try_divide(var, n)), "skewness": skew, "kurtosis": kurt, "se_skewness": se_skew, "se_kurtosis": se_kurt}


def _one(frame: Frame, spec: Spec) -> Column:
    into, name, *rest = spec
    include = name.endswith(".")
    name = name.rstrip(".").upper()
    w = F.col("__w")
    if not rest:
        if name == "N":
            return F.sum(w).alias(into)
        if name == "NU":
            return F.count(F.lit(1)).cast("double").alias(into)
        raise ValueError(f"{name} needs a variable")
    var, args = rest[0], rest[1:]
    x = frame.valid(var, user=not include)
    weight = F.sum(F.when(x.isNotNull(), w))
    share = lambda test: F.try_divide(F.sum(F.when(x.isNotNull() & test, w).otherwise(0.0)), weight)
    inside = x.between(min(args), max(args)) if len(args) == 2 else None
    out = {
        "N": lambda: F.coalesce(weight, F.lit(0.0)), "NU": lambda: F.count(x).cast("double"),
        "NMISS": lambda: F.sum(F.when(x.isNull(), w).otherwise(0.0)), "NUMISS": lambda: F.sum(F.when(x.isNull(), 1.0).otherwise(0.0)),
        "SUM": lambda: F.sum(w * x), "MEAN": lambda: F.try_divide(F.sum(w * x), weight), "SD": lambda: moments(frame, x.cast("double"))["sd"],
        "MAX": lambda: F.max(x), "MIN": lambda: F.min(x),
        "FIRST": lambda: F.min_by(x, F.when(x.isNotNull(), F.struct(*frame._by_order()))), "LAST": lambda: F.max_by(x, F.when(x.isNotNull(), F.struct(*frame._by_order()))),
        "FGT": lambda: share(x > args[0]), "FLT": lambda: share(x < args[0]), "FIN": lambda: share(inside), "FOUT": lambda: share(~inside),
        "PGT": lambda: 100 * share(x > args[0]), "PLT": lambda: 100 * share(x < args[0]), "PIN": lambda: 100 * share(inside), "POUT": lambda: 100 * share(~inside),
    }[name]()
    return out.alias(into)


def aggregate(frame: Frame, by: list[str], specs: list[Spec], columnwise: bool = False, add_variables: bool = False) -> DataFrame:
    """One row a break group (missing keys are groups too), or all cases with the group's values added.

    ``columnwise``: a group with any missing value of the variable gives a missing result, except for N, NU, NMISS, NUMISS.
    """
    cases = frame.cases()
    medians = [s for s in specs if s[1].rstrip(".").upper() == "MEDIAN"]
    plain = [s for s in specs if s not in medians]
    exprs = []
    for s in plain:
        c = _one(frame, s)
        if columnwise and s[1].rstrip(".").upper() not in ("N", "NU", "NMISS", "NUMISS"):
            x = frame.valid(s[2], user=not s[1].endswith("."))
            c = F.when(F.sum(x.isNull().cast("int")) == 0, c).alias(s[0])
        exprs.append(c)
    out = cases.groupBy(*by).agg(*exprs or [F.count("*").alias("__any")])
    for into, name, var, *_ in medians:
        x = frame.valid(var, user=not name.endswith("."))
        q = quantile(cases.select(*by, x.alias("__x"), "__w"), by, "__x", "__w", [0.5]).withColumnRenamed("p50", into)
        keys = [out[k].eqNullSafe(q[k]) for k in by]
        test = keys[0] if keys else F.lit(True)
        for k in keys[1:]:
            test = test & k
        out = out.join(q, test, "left").select(*[out[c] for c in out.columns], into)
    out = out.drop("__any").select(*by, *[s[0] for s in specs])
    if not add_variables:
        return out
    right = out.toDF(*[f"__k_{c}" if c in by else c for c in out.columns])
    test = F.lit(True)
    for k in by:
        test = test & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return frame.df.join(right, test, "left").drop(*[f"__k_{k}" for k in by])


def first_last_flags(df: DataFrame, by: list[str], order: list[str], first: str, last: str) -> DataFrame:
    """Key-boundary flags in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(first, (F.row_number().over(w) == 1).cast("double")).withColumn(last, F.lead(F.lit(1)).over(w).isNull().cast("double"))
