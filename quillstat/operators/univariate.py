"""DESCRIPTIVES, FREQUENCIES, MEANS, EXAMINE and histogram data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat import ordering
from quillstat.frame import Frame
from quillstat.operators.aggregate import moments
from quillstat.operators.quantiles import quantile

_STATS = ("n", "mean", "se_mean", "sd", "variance", "skewness", "se_skewness", "kurtosis", "se_kurtosis", "min", "max", "range", "sum")


def _stats(frame: Frame, x) -> dict:
    w = F.col("__w")
    lo, hi = F.min(F.when(w > 0, x)), F.max(F.when(w > 0, x))
    return moments(frame, x) | {"min": lo, "max": hi, "range": hi - lo}


def _melted(one: DataFrame, keys: list[str], names: list[str], stats: list[str], label: str = "variable") -> DataFrame:
    pieces = ", ".join([f"'{n}', " + ", ".join(f"`{n}__{s}`" for s in stats) for n in names])
    return one.select(*keys, F.expr(f"stack({len(names)}, {pieces}) as ({label}, {', '.join(stats)})"))


def descriptives(frame: Frame, names: list[str], stats: list[str] = _STATS, listwise: bool = False) -> DataFrame:
    """One row a variable (and split group); one pass over the cases."""
    cases = frame.cases()
    if listwise:
        cases = cases.where(reduce(lambda a, b: a & b, [frame.valid(n).isNotNull() for n in names]))
    every = {n: _stats(frame, frame.valid(n).cast("double")) for n in names}
    aggs = [every[n][s].cast("double").alias(f"{n}__{s}") for n in names for s in stats]
    by = list(frame.split_by)
    return _melted(cases.groupBy(*by).agg(*aggs), by, names, list(stats))


def z_scores(frame: Frame, names: list[str], prefix: str = "Z") -> DataFrame:
    """All cases with z-scores; the statistics are one row (or one a split group), joined back."""
    by = list(frame.split_by)
    out = frame.df
    aggs = []
    for n in names:
        m = moments(frame, frame.valid(n).cast("double"))
        aggs += [m["mean"].alias(f"__m_{n}"), m["sd"].alias(f"__s_{n}")]
    stats = frame.cases().groupBy(*by).agg(*aggs).toDF(*[f"__k_{k}" for k in by], *[f"__{s}_{n}" for n in names for s in "ms"])
    test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by], F.lit(True))
    out = out.join(stats, test, "left") if by else out.crossJoin(F.broadcast(stats))  # without split groups, stats is one row
    return out.withColumns({f"{prefix}{n}": F.try_divide(frame.valid(n) - F.col(f"__m_{n}"), F.col(f"__s_{n}")) for n in names}).drop(*stats.columns)


def frequencies(frame: Frame, name: str, descending: bool = False) -> DataFrame:
    """value, missing, frequency, percent, valid_percent, cum_percent; missing values have no valid percent. Cumulates over distinct values only."""
    c = frame.cases().groupBy(F.col(name).alias("value"), frame.is_missing(name).alias("missing")).agg(F.sum("__w").alias("frequency"))
    c = c.withColumn("good", F.when(~F.col("missing"), F.col("frequency")))
    c = ordering.ranked(c.withColumn("place", F.struct("missing", "value") if not descending else F.struct(~F.col("missing"), "value")), [], "place", "frequency", descending)
    # Valid values come before missing ones, so what is cumulated up to a valid value is valid.
    valid = c.agg(F.sum("good").alias("__valid"))
    c = c.crossJoin(F.broadcast(valid))  # one row
    share = lambda x, whole: F.try_divide(100 * F.col(x), F.col(whole))
    return c.select("value", "missing", "frequency", share("frequency", "__W").alias("percent"), share("good", "__valid").alias("valid_percent"), F.when(~F.col("missing"), share("__cc", "__valid")).alias("cum_percent"))


def mode(frame: Frame, name: str) -> DataFrame:
    """The most frequent valid value; missing when several tie."""
    c = frame.cases().groupBy(frame.valid(name).alias("v")).agg(F.sum("__w").alias("f")).where("v is not null")
    top = c.groupBy("f").agg(F.min("v").alias("v"), F.count("*").alias("n"))
    return top.agg(F.max_by(F.when(F.col("n") == 1, F.col("v")), "f").alias("mode"))


def percentiles(frame: Frame, name: str, probs: list[float], method: str = "enhanced") -> DataFrame:
    by = list(frame.split_by)
    return quantile(frame.cases().select(*by, frame.valid(name).alias("__x"), "__w"), by, "__x", "__w", probs, method)


def means(frame: Frame, dependent: str, layers: list[str], stats: list[str] = ("mean", "n", "sd")) -> DataFrame:
    """A row for each cell of the layer variables, and a total with null keys."""
    x, w = frame.valid(dependent).cast("double"), F.col("__w")
    every = _stats(frame, x) | {
        "harmonic": F.try_divide(F.sum(F.when(x.isNotNull(), w)), F.sum(F.try_divide(w, x))),
        "geometric": F.exp(F.try_divide(F.sum(w * F.when(x > 0, F.log(x))), F.sum(F.when(x.isNotNull(), w)))),
    }
    cases = frame.cases().where(x.isNotNull() & reduce(lambda a, b: a & b, [frame.valid(v).isNotNull() for v in layers]))
    aggs = [every[s].alias(s) for s in stats]
    cells = cases.groupBy(*layers).agg(*aggs)
    return cells.unionByName(cases.agg(*aggs), allowMissingColumns=True)


def examine(frame: Frame, name: str, factor: list[str] = (), confidence: float = 0.95) -> DataFrame:
    """Moments, confidence interval, 5% trimmed mean, median and quartiles by factor level."""
    from quillstat.functions.special import distribution

    by = list(factor)
    x = frame.valid(name).cast("double")
    cases = frame.cases().withColumn("__x", x).where("__x is not null")
    s = _stats(frame, x)
    out = cases.groupBy(*by).agg(*[s[k].alias(k) for k in _STATS])
    t = distribution("idf.t", F.lit(0.5 + confidence / 2), F.col("n") - 1)
    out = out.withColumn("ci_low", F.col("mean") - t * F.col("se_mean")).withColumn("ci_high", F.col("mean") + t * F.col("se_mean"))
    cells = cases.groupBy(*by, "__x").agg(F.sum("__w").alias("c"))
    cells = ordering.ranked(cells, by, "__x", "c").withColumnsRenamed({"__W": "W", "__cc": "hi"})
    inside = F.greatest(F.lit(0.0), F.least(F.col("hi"), 0.95 * F.col("W")) - F.greatest(F.col("hi") - F.col("c"), 0.05 * F.col("W")))
    trimmed = cells.groupBy(*by).agg(F.try_divide(F.sum(inside * F.col("__x")), 0.9 * F.max("W")).alias("trimmed_mean"))
    q = quantile(cases, by, "__x", "__w", [0.25, 0.5, 0.75])
    for extra in (trimmed, q):
        extra = extra.toDF(*[f"__k_{c}" if c in by else c for c in extra.columns])
        test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by], F.lit(True))
        out = (out.join(extra, test) if by else out.crossJoin(F.broadcast(extra))).drop(*[f"__k_{k}" for k in by])  # one row each without factors
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def extremes(frame: Frame, name: str, ident: str, k: int = 5) -> DataFrame:
    """The k highest and lowest cases (a top-k report)."""
    c = frame.cases().select(F.lit(1).alias("one"), F.col(ident).alias("id"), frame.valid(name).alias("value")).where("value is not null")
    high = c.orderBy(F.desc("value"), "id").limit(k).select(F.lit("highest").alias("end"), "id", "value")
    return high.unionByName(c.orderBy("value", "id").limit(k).select(F.lit("lowest").alias("end"), "id", "value"))


def histogram(frame: Frame, name: str, bins: int, low: float, high: float) -> DataFrame:
    width = (high - low) / bins
    at = F.least(F.floor((frame.valid(name) - low) / width), F.lit(bins - 1))
    return frame.cases().where(frame.valid(name).between(low, high)).groupBy(at.alias("bin")).agg(F.sum("__w").alias("weight")).withColumn("low", low + F.col("bin") * width)
