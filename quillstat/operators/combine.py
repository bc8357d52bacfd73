"""MATCH FILES, UPDATE and ADD FILES."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat import ordering


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)], F.lit(True))


def match_files(files: list[tuple[DataFrame, list[str]]], by: list[str] = (), tables: list[DataFrame | tuple[DataFrame, list[str]]] = (), flags: list[str | None] = (), first: str | None = None, last: str | None = None, rename: dict[int, dict[str, str]] | None = None) -> DataFrame:
    """Positional full outer match within each key: the n-th case of a key of one file meets the n-th of the others.

    files: (data, order columns). Without ``by``, the n-th cases of the files meet.
    A column that several files have comes from the earliest file present in a row.
    tables: looked up by key, or (data, order columns); their first row of a key in that
    order (without one, in the order of all their columns) serves all cases. flags: names of
    columns that tell whether a file contributed. first and last: names of columns that
    tell the first and the last row of a key. rename: new names by the number of the file.
    """
    by = list(by)
    files = [(df.withColumnsRenamed((rename or {}).get(i, {})), [(rename or {}).get(i, {}).get(c, c) for c in order]) for i, (df, order) in enumerate(files)]
    numbered = []
    for i, (df, order) in enumerate(files):
        if by:
            counted = df.withColumn("__case", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        else:
            counted = ordering.numbered(ordering.placed(df, [F.col(c) for c in order]))
        one = counted.select(*[F.col(c).alias(f"__{i}_{c}") for c in df.columns], F.col("__case").alias(f"__{i}_rn"), F.lit(True).alias(f"__{i}_in"))
        numbered.append((df.columns, one))
    out = numbered[0][1].select("*", *[F.col(f"__0_{k}").alias(f"__k_{k}") for k in by], F.col("__0_rn").alias("__rn"))
    for i, (_, one) in enumerate(numbered[1:], 1):
        test = _same([F.col(f"__k_{k}") for k in by], [F.col(f"__{i}_{k}") for k in by]) & (F.col("__rn") == F.col(f"__{i}_rn"))
        out = out.join(one, test, "full")
        came = F.col(f"__{i}_in").isNotNull()
        out = out.withColumns({f"__k_{k}": F.when(came, F.col(f"__{i}_{k}")).otherwise(F.col(f"__k_{k}")) for k in by} | {"__rn": F.coalesce("__rn", f"__{i}_rn")})
    names = dict.fromkeys(c for cols, _ in numbered for c in cols if c not in by)
    picked = []
    for c in names:
        value = None
        for i, (cols, _) in enumerate(numbered):
            if c in cols:
                here = F.col(f"__{i}_in").isNotNull()
                value = F.when(here, F.col(f"__{i}_{c}")) if value is None else value.when(here, F.col(f"__{i}_{c}"))
        picked.append(value.alias(c))
    marks = [F.coalesce(F.col(f"__{i}_in"), F.lit(False)).cast("double").alias(f) for i, f in enumerate(flags) if f]
    keys = [F.col(f"__k_{k}") for k in by]
    ends = []
    if first or last:
        w = Window.partitionBy(*keys).orderBy("__rn")
        ends = [c.cast("double").alias(n) for n, c in ((first, F.row_number().over(w) == 1), (last, F.lead(F.lit(1)).over(w).isNull())) if n]
    out = out.select(*[k.alias(n) for k, n in zip(keys, by, strict=True)], *picked, *marks, *ends)
    for t in tables:
        t, order = t if isinstance(t, tuple) else (t, t.columns)
        new = [c for c in t.columns if c not in out.columns]
        lead = t.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1")
        lead = lead.select(*[F.col(k).alias(f"__t_{k}") for k in by], *new)
        out = out.join(lead, _same([F.col(k) for k in by], [F.col(f"__t_{k}") for k in by]), "left").drop(*[f"__t_{k}" for k in by])
    return out


def _checked(files: list[DataFrame]) -> None:
    """A variable must be a string in all files that have it, or in none."""
    kinds: dict[str, bool] = {}
    for f in files:
        for field in f.schema.fields:
            text = field.dataType.typeName() == "string"
            if kinds.setdefault(field.name, text) != text:
                raise ValueError(f"{field.name} is a string in one file and a number in another")


def add_files(files: list[DataFrame], by: list[str] = (), order: list[str] = (), flags: list[str | None] = (), first: str | None = None, last: str | None = None, rename: dict[int, dict[str, str]] | None = None, number: str | None = None) -> DataFrame:
    """All cases of all files, columns by name; with ``by``, interleaved by key, file and order within the file.

    flags, first, last and rename as in :func:`match_files`. A DataFrame that is
    written and read again need not keep its rows' order, so ``number`` names a
    column for each case's place among the interleaved ones.
    """
    files = [f.withColumnsRenamed((rename or {}).get(i, {})) for i, f in enumerate(files)]
    _checked(files)
    marked = [f.withColumn("__file", F.lit(i)) for i, f in enumerate(files)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    out = out.withColumns({n: (F.col("__file") == i).cast("double") for i, n in enumerate(flags) if n})
    places = [*[F.col(k).asc_nulls_first() for k in by], F.col("__file"), *[F.col(c) for c in order]]
    if first or last:
        w = Window.partitionBy(*by).orderBy(*places[len(by) :])
        out = out.withColumns({n: c.cast("double") for n, c in ((first, F.row_number().over(w) == 1), (last, F.lead(F.lit(1)).over(w).isNull())) if n})
    if number:
        out = ordering.numbered(ordering.placed(out, places), number).drop("__id")
    elif by:
        out = out.orderBy(*places)
    return out.drop("__file")


def update(master: DataFrame, transactions: list[DataFrame], by: list[str], order: list[str]) -> DataFrame:
    """The first master row of a key takes the last valid (neither missing nor blank) value of its transactions; other master rows pass; keys without master are built from transactions."""
    if not by:
        raise ValueError("UPDATE needs BY")
    w = Window.partitionBy(*by).orderBy(*order)
    first = master.withColumn("__rn", F.row_number().over(w))
    rest = first.where("__rn > 1").drop("__rn")
    every = first.where("__rn = 1").drop("__rn").withColumn("__file", F.lit(0))
    for i, t in enumerate(transactions, 1):
        every = every.unionByName(t.withColumn("__file", F.lit(i)), allowMissingColumns=True)
    place = F.struct("__file", *order)
    merged = every.groupBy(*by).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), place)).alias(c) for c in master.columns if c not in by
    ])
    return merged.select(*master.columns).unionByName(rest.select(*master.columns))
