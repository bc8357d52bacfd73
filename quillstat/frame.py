"""Frame: a DataFrame with a dictionary (missing values, labels, weight, filter, split) and an order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat import ordering


@dataclass(frozen=True)
class Missing:
    """User-missing values of a variable: up to three discrete values, or a range and up to one value."""

    values: tuple = ()
    low: float | None = None
    high: float | None = None

    def __post_init__(self):
        ranged = self.low is not None or self.high is not None
        if len(self.values) > (1 if ranged else 3):
            raise ValueError("a variable has at most three missing values, or a range and one value")

    def holds(self, c: Column) -> Column:
        test = c.isin(*self.values) if self.values else F.lit(False)
        if self.low is not None or self.high is not None:
            test = test | c.between(F.lit(float("-inf") if self.low is None else self.low), F.lit(float("inf") if self.high is None else self.high))
        return F.coalesce(test, F.lit(False))


#: A value of RECODE that stands for the value recoded.
COPY = object()


@dataclass(frozen=True)
class ResponseSet:
    """A multiple response set: categories of several variables, or variables that count when they have one value."""

    members: tuple[str, ...]
    label: str = ""
    counted: float | str | None = None  # None: a category set
    labels_from: str = "categories"


@dataclass(frozen=True)
class Meta:
    """Dictionary entries that live beside the data."""

    missing: Mapping[str, Missing] = field(default_factory=dict)
    labels: Mapping[str, str] = field(default_factory=dict)
    value_labels: Mapping[str, Mapping] = field(default_factory=dict)
    formats: Mapping[str, str] = field(default_factory=dict)
    attributes: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    level: Mapping[str, str] = field(default_factory=dict)
    role: Mapping[str, str] = field(default_factory=dict)
    vectors: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    sets: Mapping[str, ResponseSet] = field(default_factory=dict)
    write_formats: Mapping[str, str] = field(default_factory=dict)
    documents: tuple[str, ...] = ()
    title: str = ""


@dataclass(frozen=True)
class Frame:
    """An immutable active dataset. Transformations return new frames and stay lazy.

    ``order`` names the columns that define case order; operations that depend on
    order refuse to run without it. ``filter_by`` applies to procedures only.
    """

    df: DataFrame
    meta: Meta = field(default_factory=Meta)
    order: tuple[str, ...] = ()
    weight_by: str | None = None
    filter_by: str | None = None
    split_by: tuple[str, ...] = ()
    limit: int | None = None
    kept: DataFrame | None = None  # the permanent data while a temporary chain is open

    # -- dictionary ---------------------------------------------------------

    def _meta(self, **changes) -> Frame:
        return replace(self, meta=replace(self.meta, **changes))

    def missing_values(self, **by_name: Missing) -> Frame:
        return self._meta(missing={**self.meta.missing, **by_name})

    def variable_labels(self, **by_name: str) -> Frame:
        return self._meta(labels={**self.meta.labels, **by_name})

    def value_labels(self, name: str, labels: Mapping, add: bool = False) -> Frame:
        old = self.meta.value_labels.get(name, {}) if add else {}
        return self._meta(value_labels={**self.meta.value_labels, name: {**old, **labels}})

    def formats(self, **by_name: str) -> Frame:
        """FORMATS: the print and write formats."""
        return self.print_formats(**by_name).write_formats(**by_name)

    def print_formats(self, **by_name: str) -> Frame:
        return self._meta(formats={**self.meta.formats, **by_name})

    def write_formats(self, **by_name: str) -> Frame:
        return self._meta(write_formats={**self.meta.write_formats, **by_name})

    def variable_attribute(self, name: str, **entries: str) -> Frame:
        return self._meta(attributes={**self.meta.attributes, name: {**self.meta.attributes.get(name, {}), **entries}})

    def variable_level(self, **by_name: str) -> Frame:
        return self._meta(level={**self.meta.level, **by_name})

    def variable_role(self, **by_name: str) -> Frame:
        return self._meta(role={**self.meta.role, **by_name})

    def mrset(self, name: str, members: Iterable[str], label: str = "", counted: float | str | None = None, labels_from: str = "categories") -> Frame:
        """MRSETS: a set of categories, or with ``counted`` one of variables that have the value."""
        members = tuple(members)
        if len(members) < 2 or not set(members) <= set(self.df.columns):
            raise ValueError("a response set has two variables of the data at least")
        return self._meta(sets={**self.meta.sets, name: ResponseSet(members, label, counted, labels_from)})

    def delete_mrset(self, *names: str) -> Frame:
        return self._meta(sets={n: v for n, v in self.meta.sets.items() if n not in names})

    def display_mrsets(self) -> DataFrame:
        rows = [(n, v.label, "categories" if v.counted is None else "counted", ", ".join(v.members)) for n, v in sorted(self.meta.sets.items())]
        return self.df.sparkSession.createDataFrame(rows, "name string, label string, kind string, variables string")

    def document(self, *lines: str) -> Frame:
        """DOCUMENT: replaces what was there."""
        return self._meta(documents=tuple(lines))

    def add_document(self, *lines: str) -> Frame:
        return self._meta(documents=(*self.meta.documents, *lines))

    def drop_documents(self) -> Frame:
        return self._meta(documents=())

    def apply_dictionary(self, other: Frame) -> Frame:
        """Take labels, missing values and formats of same-named variables from another frame."""
        own = set(self.df.columns)
        pick = lambda a, b: {**a, **{k: v for k, v in b.items() if k in own}}
        m, o = self.meta, other.meta
        return self._meta(missing=pick(m.missing, o.missing), labels=pick(m.labels, o.labels), value_labels=pick(m.value_labels, o.value_labels), formats=pick(m.formats, o.formats), level=pick(m.level, o.level), role=pick(m.role, o.role))

    def display_dictionary(self) -> DataFrame:
        spark = self.df.sparkSession
        rows = [(i + 1, f.name, "string" if f.dataType.typeName() == "string" else "numeric", self.meta.labels.get(f.name, ""), self.meta.formats.get(f.name, ""), self.meta.level.get(f.name, "scale"), str(self.meta.missing.get(f.name, ""))) for i, f in enumerate(self.df.schema.fields)]
        return spark.createDataFrame(rows, "position int, name string, type string, label string, format string, level string, missing string")

    def weight(self, name: str | None) -> Frame:
        return replace(self, weight_by=name)

    def filter(self, name: str | None) -> Frame:
        return replace(self, filter_by=name)

    def split_file(self, *names: str) -> Frame:
        return replace(self, split_by=names)

    # -- reading columns ------------------------------------------------------

    def valid(self, name: str, user: bool = True) -> Column:
        """The column with missing values as null; ``user=False`` leaves user-missing values in."""
        c = F.col(name)
        spec = self.meta.missing.get(name) if user else None
        return F.when(~spec.holds(c), c) if spec else c

    def is_missing(self, name: str) -> Column:
        return self.valid(name).isNull()

    # -- transformations ------------------------------------------------------

    def _with(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def compute(self, name: str, value: Column) -> Frame:
        """Always assigns, missing results included."""
        return self._with(self.df.withColumn(name, value))

    def if_(self, condition: Column, name: str, value: Column) -> Frame:
        old = F.col(name) if name in self.df.columns else F.lit(None)
        return self.compute(name, F.when(F.coalesce(self._test(condition), F.lit(False)), value).otherwise(old))

    def do_if(self, branches: list[tuple[Column | None, Mapping[str, Column]]]) -> Frame:
        """The first true branch assigns; a missing condition skips all that follows. A None condition is ELSE."""
        names = dict.fromkeys(n for _, assign in branches for n in assign)
        out = self
        for name in names:
            old = F.col(name) if name in self.df.columns else F.lit(None)
            value = None
            for condition, assign in reversed(branches):
                here = assign.get(name, old)
                rest = old if value is None else value
                value = here if condition is None else F.when(condition.isNull(), old).when(condition, here).otherwise(rest)
            out = replace(out, df=out.df.withColumn(f"__new_{name}", value))
        df = out.df
        for name in names:
            df = df.withColumn(name, F.col(f"__new_{name}")).drop(f"__new_{name}")
        return replace(out, df=df)

    def do_repeat(self, step: Callable[..., Frame], **lists: list) -> Frame:
        """Apply ``step(frame, dummy=value, ...)`` for each row of equally long lists."""
        if len({len(v) for v in lists.values()}) > 1:
            raise ValueError("lists differ in length")
        out = self
        for row in zip(*lists.values(), strict=True):
            out = step(out, **dict(zip(lists, row, strict=True)))
        return out

    def loop(self, name: str, start: Column, stop: Column, step: Callable[[Column, Column], Column], initial: Column, by: int = 1, until: Callable[[Column, Column], Column] | None = None) -> Frame:
        """name = fold of ``step(accumulator, index)`` over start..stop; after an index for which ``until`` is not false, the rest is skipped."""
        if until is None:
            return self.compute(name, F.when(start <= stop if by > 0 else start >= stop, F.aggregate(F.sequence(start.cast("long"), stop.cast("long"), F.lit(by).cast("long")), initial, step)).otherwise(initial))
        state = F.struct(initial.alias("v"), F.lit(False).alias("done"))

        def turn(s, i):
            v = step(s["v"], i)
            return F.when(s["done"], s).otherwise(F.struct(v.alias("v"), F.coalesce(until(v, i), F.lit(True)).alias("done")))

        folded = F.aggregate(F.sequence(start.cast("long"), stop.cast("long"), F.lit(by).cast("long")), state, turn)["v"]
        return self.compute(name, F.when(start <= stop if by > 0 else start >= stop, folded).otherwise(initial))

    def loop_many(self, initial: Mapping[str, Column], step: Callable[[Column, Column], Mapping[str, Column]], start: int | Column = 1, stop: int | Column | None = None, by: int | Column = 1, while_: Callable[[Column, Column], Column] | None = None, until: Callable[[Column, Column], Column] | None = None, most: int = 40) -> Frame:
        """Several variables folded over an index: ``step(state, index)`` gives the new values of those it changes.

        ``while_`` (LOOP IF) is tested before each turn and ends the loop unless it is true, ``until``
        (END LOOP IF) after each turn and ends it if it is not false. Without ``stop`` there are at most ``most`` turns (MXLOOPS).
        """
        as_long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
        first, by = as_long(start), as_long(by)
        last = as_long(stop) if stop is not None else first + (most - 1) * by
        names = list(initial)
        kinds = {n: self.df.select(c.alias(n)).schema[0].dataType for n, c in initial.items()}
        state = F.struct(*[initial[n].alias(n) for n in names], F.lit(False).alias("__done"))

        def turn(s, i):
            ends = s["__done"] if while_ is None else s["__done"] | ~F.coalesce(while_(s, i), F.lit(False))
            new = step(s, i)
            moved = [new[n].cast(kinds[n]).alias(n) if n in new else s[n].alias(n) for n in names]
            after = F.struct(*moved, F.lit(False).alias("__done"))
            if until is not None:
                done = F.coalesce(until(after, i), F.lit(True))
                after = F.struct(*moved, done.alias("__done"))
            return F.when(ends, F.struct(*[s[n].alias(n) for n in names], F.lit(True).alias("__done"))).otherwise(after)

        runs = F.when(by > 0, first <= last).when(by < 0, first >= last).otherwise(False)
        turns = F.when(runs, F.sequence(first, last, by)).otherwise(F.array().cast("array<bigint>"))
        folded = self.df.withColumn("__loop", F.aggregate(turns, state, turn))
        return self._with(folded.withColumns({n: F.col("__loop")[n] for n in names}).drop("__loop"))

    def vector(self, name: str, *members: str) -> Frame:
        return self._meta(vectors={**self.meta.vectors, name: members})

    def element(self, vector: str, index: Column) -> Column:
        """Missing out of range."""
        return F.try_element_at(F.array(*[self.valid(m) for m in self.meta.vectors[vector]]), F.when(index >= 1, F.floor(index).cast("int")).otherwise(F.lit(len(self.meta.vectors[vector]) + 1)))

    def compute_element(self, vector: str, index: Column, value: Column) -> Frame:
        """Out of range writes nothing."""
        df = self.df
        at = F.floor(index)
        members = self.meta.vectors[vector]
        return self._with(df.select(*[F.when(at == members.index(c) + 1, value).otherwise(F.col(c)).alias(c) if c in members else F.col(c) for c in df.columns]))

    def recode(self, name: str, rules: list[tuple], into: str | None = None) -> Frame:
        """Rules (test, value): test is a value, (low, high), 'sysmis', 'missing', 'convert' (a string that holds a number) or 'else'; value may be COPY or None. The first match wins.

        Without a match the variable keeps its value; a new variable (``into``) is missing, or blank
        if it is a string. Strings match apart from trailing blanks. 'copy' means COPY unless the variable is a string.
        """
        text = self.df.schema[name].dataType.typeName() == "string"
        c = F.col(name)
        out: Column | None = None
        strings = False
        for test, value in rules:
            copied = value is COPY or not text and isinstance(value, str) and value == "copy"
            given = c if copied else F.lit(value)
            strings |= text if copied else isinstance(value, str)
            if test == "else":
                hit = F.lit(True)
            elif test == "sysmis":
                hit = c.isNull()
            elif test == "missing":
                hit = self.is_missing(name)
            elif test == "convert":
                given, strings = F.trim(c).try_cast("double"), False
                hit = given.isNotNull()
            elif isinstance(test, tuple):
                low, high = test
                hit = (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)
            else:
                hit = F.rtrim(c) == test.rstrip() if text else c == test
            hit = F.coalesce(hit, F.lit(False))
            out = F.when(hit, given) if out is None else out.when(hit, given)
        if into is None:
            return self.compute(name, out.otherwise(c))
        return self.compute(into, out.otherwise("") if strings else out)

    def count(self, into: str, names: Iterable[str], values: Iterable = (), ranges: Iterable[tuple] = (), missing: bool = False, sysmis: bool = False) -> Frame:
        """Number of variables that match; a user-missing value counts by ``missing`` only, never by its value."""
        total = F.lit(0.0)
        for n in names:
            c = self.valid(n)
            hit = F.lit(False)
            for v in values:
                hit = hit | F.coalesce(c == v, F.lit(False))
            for low, high in ranges:
                hit = hit | F.coalesce(c.between(low, high), F.lit(False))
            if missing:
                hit = hit | c.isNull()
            if sysmis:
                hit = hit | F.col(n).isNull()
            total = total + hit.cast("double")
        return self.compute(into, total)

    def _test(self, condition: Column) -> Column:
        """A condition as a boolean: numbers hold when they equal 1; missing stays missing."""
        boolean = self.df.select(condition).schema[0].dataType.typeName() == "boolean"
        return condition if boolean else condition.cast("double") == 1.0

    def select_if(self, condition: Column) -> Frame:
        """Keeps cases for which the condition holds; false and missing drop. A plain filter, so it reaches the scan."""
        return self._with(self.df.where(self._test(condition)))

    def n_of_cases(self, n: int) -> Frame:
        return replace(self, limit=n)

    def sample(self, fraction: float | None = None, exactly: int | None = None, seed: int = 1) -> Frame:
        """A Bernoulli sample, or exactly n cases."""
        if exactly is None:
            return self._with(self.df.sample(False, fraction, seed))
        return self._with(self.df.orderBy(F.rand(seed)).limit(exactly))

    def numeric(self, *names: str) -> Frame:
        return self._with(self.df.withColumns({n: F.lit(None).cast("double") for n in names}))

    def string(self, *names: str) -> Frame:
        return self._with(self.df.withColumns({n: F.lit("") for n in names}))

    def rename_variables(self, **old_to_new: str) -> Frame:
        """Renames all at once, so names may be swapped."""
        return self._with(self.df.toDF(*[old_to_new.get(c, c) for c in self.df.columns]))

    def delete_variables(self, *names: str) -> Frame:
        return self._with(self.df.drop(*names))

    def modify_vars(self, keep: Iterable[str] | None = None, drop: Iterable[str] = (), reorder: Iterable[str] = ()) -> Frame:
        names = [c for c in (keep or self.df.columns) if c not in set(drop)]
        first = [c for c in reorder if c in names]
        return self._with(self.df.select(*first, *[c for c in names if c not in first]))

    def _by_order(self) -> list[Column]:
        if not self.order:
            raise ValueError("this operation needs a frame with an order")
        return [F.col(c) for c in self.order]

    def _within_groups(self):
        if not self.split_by:
            raise ValueError("without split groups use with_lag or with_running")
        return Window.partitionBy(*self.split_by).orderBy(*self._by_order())

    def lag(self, name: str, n: int = 1) -> Column:
        """The value n cases before within the split group, of the cases that survive the transformations so far."""
        return F.lag(self.valid(name), n).over(self._within_groups())

    def running(self, name: str) -> Column:
        """Running sum within the split group: what ``x = lag(x) + name`` computes."""
        return F.sum(self.valid(name)).over(self._within_groups().rowsBetween(Window.unboundedPreceding, 0))

    def with_lag(self, into: str, name: str, n: int = 1) -> Frame:
        """A variable with the value n cases before, over all cases; with split groups, within each."""
        if self.split_by:
            return self._with(self.df.withColumn(into, self.lag(name, n)))
        rows = ordering.numbered(ordering.placed(self.df, self._by_order()))
        return self._with(ordering.lagged(rows, {into: self.valid(name)}, n).drop("__case", "__id"))

    def with_running(self, into: str, name: str) -> Frame:
        """A variable with the running sum over all cases; with split groups, within each."""
        if self.split_by:
            return self._with(self.df.withColumn(into, self.running(name)))
        return self._with(ordering.cumulated(ordering.placed(self.df, self._by_order()), self.valid(name), into).drop("__id"))

    def casenum(self, into: str) -> Frame:
        """1, 2, ... in case order."""
        rows = ordering.numbered(ordering.placed(self.df, self._by_order()), into)
        return self._with(rows.withColumn(into, F.col(into).cast("double")).drop("__id"))

    def sort_cases(self, *keys: str) -> Frame:
        """Stable: ties keep the present order. A leading '-' sorts down; missing is lowest."""
        cols = [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_first() for k in keys]
        return self._with(self.df.orderBy(*cols, *[F.col(c) for c in self.order]))

    def list_cases(self, first: int = 1, last: int | None = None, by: int = 1) -> DataFrame:
        numbered = self.casenum("__case").df
        n = F.col("__case")
        test = (n >= first) & ((n - first) % by == 0)
        return numbered.where(test & (n <= last) if last is not None else test).drop("__case")

    def leave(self, name: str, value: Callable, initial=0.0, schema: str | None = None) -> Frame:
        """A variable that keeps its value from the case before: ``value(previous, row)`` folded in case order within each split group."""
        df, order, groups = self.df, list(self.order), list(self.split_by)
        self._by_order()

        def fold(pdf):
            pdf = pdf.sort_values(order, kind="stable")
            have, out = initial, []
            for row in pdf.itertuples(index=False):
                have = value(have, row)
                out.append(have)
            return pdf.assign(**{name: out})

        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name)
        return self._with(df.groupBy(*groups).applyInPandas(fold, f"{kept}, `{name}` {schema or 'double'}"))

    def temporary(self) -> Frame:
        """Transformations from here on last for one procedure; :meth:`restored` gives the data without them."""
        return replace(self, kept=self.kept if self.kept is not None else self.df)

    def restored(self) -> Frame:
        return replace(self, df=self.kept if self.kept is not None else self.df, kept=None)

    def split_runs(self, into: str = "split_group") -> Frame:
        """Number the contiguous runs of equal split values in case order."""
        rows = ordering.numbered(ordering.placed(self.df, self._by_order()))
        old = {f"__old_{k}": F.col(c) for k, c in enumerate(self.split_by)}
        rows = ordering.lagged(rows, old)
        changed = F.col("__case") == 1
        for name, c in old.items():
            changed = changed | ~c.eqNullSafe(F.col(name))
        return self._with(ordering.cumulated(rows, changed.cast("int"), into).drop("__case", "__id", *old))

    # -- what procedures see ----------------------------------------------------

    def cases(self) -> DataFrame:
        """The cases a procedure reads, with ``__w``: the limit first, then the filter; weights that are missing or negative are 0."""
        df = self.df
        if self.limit is not None:
            df = df.orderBy(*self._by_order()).limit(self.limit)
        if self.filter_by:
            df = df.where(F.coalesce(self.valid(self.filter_by) != 0, F.lit(False)))
        w = F.lit(1.0) if self.weight_by is None else F.greatest(F.coalesce(self.valid(self.weight_by).cast("double"), F.lit(0.0)), F.lit(0.0))
        return df.withColumn("__w", w)
