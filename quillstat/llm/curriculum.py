"""Mixing sources to target weights under a time-varying curriculum, in DataFrame operations only.

Training time runs from 0 to 1. Each source's weight schedule is a piecewise
linear rate over it; its integral, scaled to the source's target, is the
source's cumulative token demand. A document lies at some cumulative token count
of its source, and the inverse of the demand there is its training position.
Range-sorting by position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm._tables import store

WORD_SEPARATORS = "[ \\t\\n\\x0B\\f\\r]+"
NON_SEPARATOR = "[^ \\t\\n\\x0B\\f\\r]"
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Knots (time, rate) of the schedules of the sources in order, repeating: early, even, late.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Hex digits of a document's hash that choose its bin within its source.
BIN_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    text = F.coalesce(text, F.lit(""))
    edge = lambda at: F.substring(text, at, 1).rlike(WORD_SEPARATORS).cast("int")
    return F.when(text.rlike(NON_SEPARATOR), F.size(F.split(text, WORD_SEPARATORS)) - edge(1) - edge(-1)).otherwise(0).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, nth) from (source, source_size).

    The sources share ``share`` of all sizes by weight; a target stops at ``most``
    times its source's size and the excess is shared again until none is above.
    That is the level L for which sum(min(cap, weight * L)) meets the total: with
    sources ordered by cap / weight, the first k are capped for the least k whose
    level fits under the next one's cap. Empty sources get 0.

    The table has one row a source, so the ordered windows are over sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("nth", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.col("weight")), "nth")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(above), F.lit(0))).withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(above), F.lit(0)))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    fits = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("o"), "nth", "level"))).over(every)
    s = s.withColumn("fit", fits)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(F.col("fit.level"), F.lit(float("inf"))))
    return s.select("source", "source_size", target.alias("target"), "nth")


def invert(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Time at which the integral of the piecewise linear rate reaches ``share`` of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, r0), (t1, r1), area in zip(knots, knots[1:], areas, strict=False):
        need = share * whole - done  # area to cover within this piece
        slope = (r1 - r0) / (t1 - t0)
        pieces.append((done + area, t0 + 2 * need / (r0 + F.sqrt(F.greatest(F.lit(0.0), F.lit(r0 * r0) + 2 * slope * need)))))
        done += area
    for upto, time in reversed(pieces):
        out = F.when(share * whole <= upto, time).otherwise(out)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target, taken, position, repeat_position.

    Within a source, documents lie in the order of md5(id) and id; the mix takes the source
    round and round in that order until its target (rounded to whole words) is met, so
    all are taken floor(target / source_size) times and the first ones once more; the
    last document of a source may be taken in part. ``position`` is the training time of
    the first taking and ``repeat_position`` that of the second; null when not taken.

    Null texts have size 0 and take nothing; a null source is a source of its own,
    ordered last. Null ids count as empty text in the order; rows that tie in
    it (repeated rows) share words in an arbitrary but exhaustive way. Other columns are
    ignored. An empty table gives an empty table.

    A source's running sums are taken in bins of the hash, so a source that holds a
    third of the rows is spread over 16**BIN_DIGITS groups.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    base = base.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))).withColumn("bin", F.substring("h", 1, BIN_DIGITS))
    base = store(base, "mix-sizes")
    bins = store(base.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    plan = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), share, most, weights)
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    bins = bins.join(plan, bins.source.eqNullSafe(plan.source)).select(bins.source.alias("s"), bins.bin.alias("b"), "bin_start", "source_size", "target", "nth")
    at = Window.partitionBy("source", "bin").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("within", F.coalesce(F.sum("size").over(at), F.lit(0)))
    rows = rows.join(bins, rows.source.eqNullSafe(F.col("s")) & (rows.bin == F.col("b")))
    rows = rows.withColumn("start", F.col("bin_start") + F.col("within")).withColumn("words", F.round("target").cast("long"))
    in_round = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.lit(k) * F.col("source_size") - F.col("start")))

    def when_taken(k):
        place = (F.lit(k) * F.col("source_size") + F.col("start")) / F.col("target")
        time = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            time = F.when(F.col("nth") % len(schedules) == i, invert(place, knots)).otherwise(time)
        return F.when(in_round(k) > 0, time)

    times = [when_taken(k) for k in range(most)]
    # A taking counts if it has a training time.
    taken = sum((F.when(time.isNotNull(), in_round(k)).otherwise(0) for k, time in enumerate(times)), F.lit(0)).cast("long")
    position, repeat = [*times, F.lit(None).cast("double")][:2]
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), position.alias("position"), repeat.alias("repeat_position"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Taken documents, one row a taking, range-partitioned and sorted by position."""
    takings = mixed.withColumn("position", F.explode(F.array("position", "repeat_position"))).where("position is not null").drop("repeat_position")
    return takings.repartitionByRange("position").sortWithinPartitions("position")


def documents_in_training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All rows of the mix, range-partitioned and sorted by position; those not taken come first, dealt out by id."""
    return mixed.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)


MIX_SQL = r"""
with d as (select doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from {docs}),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) - 1 as nth from s0),
s2 as (select *, [3, 1, 2][(nth % 3 + 1)::int] as weight, source_size * 2 as cap from s1),
s3 as (select *, (sum(source_size) over ())::double * 1.5 as total, coalesce(sum(cap) over (order by cap::double / weight, nth rows between unbounded preceding and 1 preceding), 0)::double as capped, (sum(weight) over () - coalesce(sum(weight) over (order by cap::double / weight, nth rows between unbounded preceding and 1 preceding), 0))::double as rest from s2),
s4 as (select *, (total - capped) / rest as level from s3),
s5 as (select source, source_size, nth, least(cap::double, weight * (select arg_min(level, (cap::double / weight, nth)) from s4 where level <= cap::double / weight)) as target from s4),
r as (select d.*, s5.source_size, s5.target, s5.nth, coalesce(sum(size) over (partition by d.source order by h, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from d join s5 on d.source is not distinct from s5.source),
k as (select *, greatest(0, least(size, round(target)::bigint - start))::bigint as t0, greatest(0, least(size, round(target)::bigint - source_size - start))::bigint as t1, start::double / nullif(target, 0) as x0, (source_size + start)::double / nullif(target, 0) as x1 from r)
select doc_id, size, source_size, target, (t0 + t1)::bigint as taken, case when t0 > 0 then {p0} end as position, case when t1 > 0 then {p1} end as repeat_position from k
"""


def _inverse_sql(x: str) -> str:
    """The inverse of each schedule's integral, written out for SCHEDULES."""
    return (
        f"(case nth % 3 when 0 then case when {x} <= 0.625 then 2 * {x} / (1.5 + sqrt(greatest(0, 2.25 - 2 * {x}))) when {x} <= 1 then 0.5 + 2 * ({x} - 0.625) / (1 + sqrt(greatest(0, 1 - 2 * ({x} - 0.625)))) else 1 end "
        f"when 1 then least({x}, 1) else case when {x} <= 0.375 then 2 * {x} / (0.5 + sqrt(0.25 + 2 * {x})) when {x} <= 1 then 0.5 + 2 * ({x} - 0.375) / (1 + sqrt(1 + 2 * ({x} - 0.375))) else 1 end end)::double"
    )


MIX_SQL = MIX_SQL.replace("{p0}", _inverse_sql("x0")).replace("{p1}", _inverse_sql("x1"))
