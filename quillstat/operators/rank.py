"""RANK, AUTORECODE and FLIP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat import ordering
from quillstat.functions.special import probit


def _keys(by: list[str], left: str, right: str) -> Column:
    test = F.lit(True)
    for k in by:
        test = test & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return test


def rank(df: DataFrame, x: str, functions: dict[str, str], by: list[str] = (), w: str | None = None, ties: str = "mean", fraction: str = "blom", ntiles: int = 4, descending: bool = False) -> DataFrame:
    """df with rank variables: functions maps a new name to rank, normal, percent, rfraction, proportion, n, ntiles or savage.

    Missing x and weights not above 0 give missing ranks. Ranks are made once for each
    distinct value, by ``ordering.ranked``, and joined back.
    """
    by = list(by)
    weight = F.lit(1.0) if w is None else F.col(w).cast("double")
    cells = df.where(F.col(x).isNotNull() & (weight > 0)).groupBy(*by, F.col(x).alias("__x")).agg(F.sum(weight).alias("__tw"))
    cells = ordering.ranked(cells, by, "__x", "__tw", descending)
    W, cc, tw, i = F.col("__W"), F.col("__cc"), F.col("__tw"), F.col("__i").cast("double")
    before = cc - tw
    r = {
        "mean": F.when(tw >= 1, before + (tw + 1) / 2).otherwise(before + tw / 2),
        "low": F.when(tw >= 1, before + 1).otherwise(before),
        "high": cc,
        "condense": i,
    }[ties]
    part = {"blom": (r - 0.375) / (W + 0.25), "rankit": (r - 0.5) / W, "tukey": (r - 1 / 3) / (W + 1 / 3), "vw": r / (W + 1)}[fraction]
    part = F.when(part > 0, part)
    exprs = {}
    for name, kind in functions.items():
        if kind == "savage":
            # The mean over the tied places j of H(W) - H(W - j), whole weights, in closed form.
            exprs[name] = harmonic(W) - (harmonic_sum(W - before - 1) - harmonic_sum(W - cc - 1)) / tw - 1
        else:
            exprs[name] = {"rank": r, "rfraction": r / W, "percent": 100 * r / W, "proportion": part, "normal": probit(part), "n": W, "ntiles": F.floor(r * ntiles / (W + 1)) + 1}[kind].cast("double")
    ranks = cells.select(*by, "__x", *[e.alias(n) for n, e in exprs.items()]).alias("r")
    joined = df.alias("d").join(ranks, _keys(by, "d", "r") & (F.col(f"d.{x}") == F.col("r.__x")), "left")
    alive = weight > 0
    return joined.select("d.*", *[F.when(alive, F.col(f"r.{n}")).alias(n) for n in exprs])


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n for whole n, by its asymptotic series from 24 on."""
    table = [0.0]
    for k in range(1, 24):
        table.append(table[-1] + 1 / k)
    series = F.log(n) + 0.57721566490153286 + 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4) - 1 / (252 * n**6)
    return F.when(n < 24, F.try_element_at(F.array(*[F.lit(v) for v in table]), F.greatest(n, F.lit(0.0)).cast("int") + 1)).otherwise(series)


def harmonic_sum(n: Column) -> Column:
    """H(0) + ... + H(n); 0 below 0."""
    return F.when(n < 0, 0.0).otherwise((n + 1) * harmonic(n) - n)


def autorecode(df: DataFrame, x: str, into: str, descending: bool = False, blank_valid: bool = True) -> DataFrame:
    """1..k by value; distinct values are ranked and joined back."""
    values = df.select(F.col(x).alias("__x")).distinct()
    if not blank_valid:
        values = values.where(F.trim(F.col("__x").cast("string")) != "")
    codes = ordering.ranked(values.withColumn("__n", F.lit(1)), [], "__x", "__n", descending).select("__x", F.col("__i").cast("double").alias(into))
    return df.join(codes, F.col(x).eqNullSafe(F.col("__x")), "left").drop("__x")


def flip(df: DataFrame, variables: list[str], names: str, new_names: list[str]) -> DataFrame:
    """Transpose: one row a variable (CASE_LBL), one column a case; ``names`` holds the case names, which must be ``new_names``."""
    long = df.select(names, F.expr(f"stack({len(variables)}, " + ", ".join(f"'{v}', cast(`{v}` as double)" for v in variables) + ") as (CASE_LBL, __v)"))
    return long.groupBy("CASE_LBL").pivot(names, new_names).agg(F.first("__v"))
