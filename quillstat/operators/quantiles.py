"""Weighted order statistics: five percentile definitions, and the type-7 rule of frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat import ordering

METHODS = ("haverage", "waverage", "round", "empirical", "aempirical", "enhanced")


def quantile(df: DataFrame, by: list[str], x: str, w: str, probs: list[float], method: str = "haverage") -> DataFrame:
    """by and p<100p> columns, over non-missing x with positive weight.

    Values are aggregated to distinct ones before cumulating, by ``ordering.ranked``. Below the first value the interpolating definitions
    start from 0, except ``enhanced`` (the (W-1)p rule).
    """
    cells = df.where(F.col(x).isNotNull() & (F.col(w) > 0)).groupBy(*by, F.col(x).cast("double").alias("__y")).agg(F.sum(w).alias("__c"))
    cells = ordering.ranked(cells, by, "__y", "__c")
    cells = cells.withColumn("__below", F.col("__cc") - F.col("__c"))
    W, cc, below, y, before, c = (F.col(k) for k in ("__W", "__cc", "__below", "__y", "__before", "__c"))
    from_zero = F.coalesce(before, F.lit(0.0))
    outs = []
    for p in probs:
        name = f"p{100 * p:g}".replace(".", "_")
        if method in ("empirical", "aempirical", "round"):
            t = W * p if method != "round" else W * p + 0.5
            at = F.min(F.when(cc >= t - 1e-9, y)) if method != "round" else F.max(F.when(below + 1 <= t + 1e-9, y))
            value = F.coalesce(at, F.lit(0.0) if method == "round" else F.max(y))
            if method == "aempirical":
                nxt = F.min(F.when(cc > t + 1e-9, y))
                value = F.when(F.max((F.abs(cc - t) < 1e-9).cast("int")) == 1, (at + F.coalesce(nxt, at)) / 2).otherwise(at)
        else:
            t = {"haverage": (W + 1) * p, "waverage": W * p, "enhanced": (W - 1) * p + 1}[method]
            # The value whose first unit lies at or above the target: between it and the one before interpolate, inside it take it.
            gap = t - below
            start = F.when(gap < 1, from_zero + gap * (y - from_zero) if method != "enhanced" else F.coalesce(before, y) + gap * (y - F.coalesce(before, y))).otherwise(y)
            value = F.coalesce(F.min_by(start, F.when(cc >= t - 1e-12, cc)), F.max(y))
        outs.append(value.alias(name))
    return cells.groupBy(*by).agg(*outs) if by else cells.agg(*outs)
