"""Registered queries over the driver's tables, each with an independent SQL form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.frame import Frame, Missing
from quillstat.functions import expr as E
from quillstat.functions import special
from quillstat.operators import aggregate as A
from quillstat.operators import combine, crosstabs, inference, models, rank, univariate

QUERIES: dict = {}
SQL: dict[str, str] = {}

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def frame(spark: SparkSession, d: str, name: str, **kw) -> Frame:
    return Frame(spark.read.parquet(f"{d}/{name}.parquet"), **kw)


def r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison across engines."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


@query("""select l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_quantity), 6) as mean_qty, round(stddev_samp(l_quantity), 6) as sd_qty,
  count(*)::double as n, round(100.0 * count(*) filter (l_quantity between 10 and 20) / count(*), 6) as pin_qty, min(l_tax) as min_tax, max(l_tax) as max_tax
  from lineitem where l_quantity > 2 group by all""")
def aggregate_core(spark, d):
    f = frame(spark, d, "lineitem").compute("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))).select_if(F.col("l_quantity") > 2)
    out = A.aggregate(f, ["l_returnflag", "l_linestatus"], [("revenue", "SUM", "net"), ("mean_qty", "MEAN", "l_quantity"), ("sd_qty", "SD", "l_quantity"), ("n", "N"), ("pin_qty", "PIN", "l_quantity", 10, 20), ("min_tax", "MIN", "l_tax"), ("max_tax", "MAX", "l_tax")])
    return r(out).withColumn("revenue", F.round("revenue", 2))


@query("""with c as (select l_returnflag, l_quantity as w, nullif(l_discount, 0) as x, l_discount as raw, l_tax as t from lineitem)
select l_returnflag, round(sum(w * x), 4) as s, round(sum(w * x) / sum(w) filter (x is not null), 8) as m, sum(w) filter (x is null) as nmiss, count(*) filter (x is null)::double as numiss,
  count(x)::double as nu, round(sum(w) filter (x > 0.05) / sum(w) filter (x is not null), 8) as fgt, round(sum(w) filter (x < 0.05) / sum(w) filter (x is not null), 8) as flt,
  round(sum(w) filter (x not between 0.02 and 0.06) / sum(w) filter (x is not null), 8) as fout, min(raw) as min_all, null::double as col_mean from c group by all""")
def aggregate_weighted_missing(spark, d):
    f = frame(spark, d, "lineitem").missing_values(l_discount=Missing((0.0,))).weight("l_quantity")
    x = "l_discount"
    out = A.aggregate(f, ["l_returnflag"], [("s", "SUM", x), ("m", "MEAN", x), ("nmiss", "NMISS", x), ("numiss", "NUMISS", x), ("nu", "NU", x), ("fgt", "FGT", x, 0.05), ("flt", "FLT", x, 0.05), ("fout", "FOUT", x, 0.02, 0.06), ("min_all", "MIN.", x)])
    strict = A.aggregate(f, ["l_returnflag"], [("col_mean", "MEAN", x)], columnwise=True)
    out = out.join(strict, "l_returnflag")
    return r(out, 8).withColumn("s", F.round("s", 4))


@query("""select o_orderkey, o_orderpriority, round(avg(o_totalprice) over (partition by o_orderpriority), 4) as mean_price, count(*) over (partition by o_orderpriority)::double as n from orders""")
def aggregate_addvariables(spark, d):
    f = frame(spark, d, "orders")
    out = A.aggregate(f, ["o_orderpriority"], [("mean_price", "MEAN", "o_totalprice"), ("n", "N")], add_variables=True)
    return r(out.select("o_orderkey", "o_orderpriority", "mean_price", "n"), 4)


@query("""select user_id, arg_min(value, event_id) as first_value, arg_max(value, event_id) as last_value, round(median(value), 6) as med from events group by user_id""")
def aggregate_first_last_median(spark, d):
    f = frame(spark, d, "events", order=("event_id",))
    return r(A.aggregate(f, ["user_id"], [("first_value", "FIRST", "value"), ("last_value", "LAST", "value"), ("med", "MEDIAN", "value")]))


@query("""select p_partkey, case when p_size <= 10 then 1.0 when p_size <= 30 then 2.0 else 9.0 end as size_class, case p_brand when 'Brand#11' then 'first' else p_brand end as brand,
  ((p_size between 1 and 5)::int + (p_size = 7)::int)::double as hits from part""")
def recode_count(spark, d):
    f = frame(spark, d, "part").recode("p_size", [((None, 10), 1.0), ((None, 30), 2.0), ("else", 9.0)], into="size_class").recode("p_brand", [("Brand#11", "first")])
    return f.count("hits", ["p_size"], values=[7], ranges=[(1, 5)]).df.select("p_partkey", "size_class", F.col("p_brand").alias("brand"), "hits")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_discount = 0 then -1.0 when l_discount > 0.05 then 1.0 when l_tax > 0.04 then 2.0 else 3.0 end as grade from lineitem""")
def do_if_null_skip(spark, d):
    f = frame(spark, d, "lineitem").missing_values(l_discount=Missing((0.0,))).compute("grade", F.lit(-1.0))
    f = f.do_if([(f.valid("l_discount") > 0.05, {"grade": F.lit(1.0)}), (F.col("l_tax") > 0.04, {"grade": F.lit(2.0)}), (None, {"grade": F.lit(3.0)})])
    return f.df.select(*LINE_ORDER, "grade")


@query("""select p_partkey, (case when p_size % 2 = 0 then p_size else p_retailprice end)::double as pick, (p_size * (p_size + 1) / 2)::double as tri, round(p_retailprice / p_size, 6) as d1 from part""")
def vector_loop_repeat(spark, d):
    f = frame(spark, d, "part").compute("a", F.col("p_size").cast("double")).compute("b", F.col("p_retailprice")).vector("v", "a", "b")
    f = f.compute("pick", f.element("v", F.when(F.col("p_size") % 2 == 0, 1).otherwise(2)))
    f = f.loop("tri", F.lit(1), F.col("p_size"), lambda acc, i: acc + i, F.lit(0.0))
    f = f.do_repeat(lambda g, new, divisor: g.compute(new, E.div(F.col("p_retailprice"), F.col(divisor))), new=["d1"], divisor=["p_size"])
    return r(f.df.select("p_partkey", "pick", "tri", "d1"))


@query("""select o_orderkey, year(o_orderdate)::double as y, month(o_orderdate)::double as m, quarter(o_orderdate)::double as q, dayofyear(o_orderdate)::double as jd, ((dayofyear(o_orderdate) - 1) // 7 + 1)::double as wk,
  (dayofweek(o_orderdate) + 1)::double as wd, (epoch(o_orderdate) + 12219379200)::double as secs, (epoch(o_orderdate::date + interval 3 month) + 12219379200)::double as plus3,
  date_diff('day', date '1995-01-01', o_orderdate::date)::double as days from orders""")
def date_functions(spark, d):
    x = E.from_timestamp(F.col("o_orderdate"))
    start = E.date_dmy(F.lit(1), F.lit(1), F.lit(1995))
    return frame(spark, d, "orders").df.select("o_orderkey", E.xdate("year", x).alias("y"), E.xdate("month", x).alias("m"), E.xdate("quarter", x).alias("q"), E.xdate("jday", x).alias("jd"), E.xdate("week", x).alias("wk"), E.xdate("wkday", x).alias("wd"), x.alias("secs"), E.datesum(E.xdate("date", x), F.lit(3.0), "months").alias("plus3"), E.datediff(E.xdate("date", x), start, "days").alias("days"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity + l_discount + l_tax) / 3, 8) as mean3, round(greatest(l_quantity, l_discount, l_tax), 8) as max3,
  round(sqrt(((l_quantity - (l_quantity + l_discount + l_tax) / 3) ** 2 + (l_discount - (l_quantity + l_discount + l_tax) / 3) ** 2 + (l_tax - (l_quantity + l_discount + l_tax) / 3) ** 2) / 2), 6) as sd3,
  (case when l_discount = 0 then 1 else 0 end)::double as nm, round(ln(l_quantity), 8) as ln_q, floor(l_extendedprice + .5) as rnd_p, (l_quantity % 10)::double as m10, case when l_discount = 0 then 0.0 else round(l_discount / l_tax, 6) end as dt from lineitem where l_tax > 0""")
def scalar_functions(spark, d):
    f = frame(spark, d, "lineitem").select_if(F.col("l_tax") > 0).missing_values(l_discount=Missing((0.0,)))
    three = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax")]
    return f.df.select(*LINE_ORDER, F.round(E.mean(*three), 8).alias("mean3"), F.round(E.max_(*three), 8).alias("max3"), F.round(E.sd(*three), 6).alias("sd3"), E.nmiss(f.valid("l_discount")).alias("nm"), F.round(E.ln(F.col("l_quantity")), 8).alias("ln_q"), E.rnd(F.col("l_extendedprice")).alias("rnd_p"), E.mod10(F.col("l_quantity")).alias("m10"), F.round(E.div(F.col("l_discount"), F.col("l_tax")), 6).alias("dt"))


@query("""select c_custkey, upper(c_mktsegment) as up, lower(c_mktsegment) as lo, instr(c_mktsegment, 'U')::double as ix, (length(c_mktsegment) - instr(reverse(c_mktsegment), 'E') + 1)::double * (instr(c_mktsegment, 'E') > 0)::int as rix,
  substr(c_name, 1, 4) as sub, c_mktsegment || '/' || c_name as cat, lpad(c_mktsegment, greatest(12, length(c_mktsegment)::int), '*') as lp from customer""")
def string_functions(spark, d):
    s = F.col("c_mktsegment")
    return frame(spark, d, "customer").df.select("c_custkey", F.upper(s).alias("up"), F.lower(s).alias("lo"), E.index(s, "U").alias("ix"), E.rindex(s, "E").alias("rix"), E.substr(F.col("c_name"), F.lit(1), F.lit(4)).alias("sub"), F.concat(s, F.lit("/"), F.col("c_name")).alias("cat"), E.lpad(s, 12, "*").alias("lp"))


@query("""with o as (select o_custkey as k, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders), e as (select user_id as k, event_id, row_number() over (partition by user_id order by event_id) as rn from events)
select coalesce(o.k, e.k) as k, o_orderkey, event_id, (o.k is not null)::int::double as in_o, (e.k is not null)::int::double as in_e from o full join e on o.k = e.k and o.rn = e.rn""")
def match_files_positional(spark, d):
    o = frame(spark, d, "orders").df.select(F.col("o_custkey").alias("k"), "o_orderkey")
    e = frame(spark, d, "events").df.select(F.col("user_id").alias("k"), "event_id")
    return combine.match_files([(o, ["o_orderkey"]), (e, ["event_id"])], ["k"], flags=["in_o", "in_e"])


@query("""select o_orderkey, o_custkey, c_mktsegment from orders left join customer on o_custkey = c_custkey""")
def match_files_table(spark, d):
    o = frame(spark, d, "orders").df.select("o_custkey", "o_orderkey")
    c = frame(spark, d, "customer").df.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return combine.match_files([(o, ["o_orderkey"])], ["o_custkey"], tables=[c])


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'MOVED' else c_mktsegment end as seg, case when c_custkey % 2 = 0 then c_acctbal + 1 else c_acctbal end as bal from customer""")
def update_files(spark, d):
    c = frame(spark, d, "customer").df.select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    t = c.where("c_custkey % 6 in (0, 2, 3, 4)").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "MOVED").otherwise("").alias("seg"), F.when(F.col("c_custkey") % 2 == 0, F.col("bal") + 1).alias("bal"))
    return combine.update(c, [t], ["c_custkey"], ["bal"])


@query("""select s_nationkey as k, s_suppkey, null::bigint as c_custkey from supplier union all by name select c_nationkey as k, null::bigint as s_suppkey, c_custkey from customer""")
def add_files_by(spark, d):
    s = frame(spark, d, "supplier").df.select(F.col("s_nationkey").alias("k"), "s_suppkey")
    c = frame(spark, d, "customer").df.select(F.col("c_nationkey").alias("k"), "c_custkey")
    return combine.add_files([s, c], by=["k"], order=["s_suppkey", "c_custkey"])


@query("""select event_id, lag(value) over (partition by user_id order by event_id) as prev, round(sum(value) over (partition by user_id order by event_id rows unbounded preceding), 4) as run from events where event_type <> 'error'""")
def lag_running(spark, d):
    f = frame(spark, d, "events", order=("event_id",)).select_if(F.col("event_type") != "error").split_file("user_id")
    return f.df.select("event_id", f.lag("value").alias("prev"), F.round(f.running("value"), 4).alias("run"))


@query("""select event_id, row_number() over (order by event_id)::double as n from events where event_type = 'click'""")
def casenum(spark, d):
    return frame(spark, d, "events", order=("event_id",)).select_if(F.col("event_type") == "click").casenum("n").df.select("event_id", "n")


@query("""with e as (select event_id, event_type, (event_type is distinct from lag(event_type) over (order by event_id))::int as c from events) select event_id, sum(c) over (order by event_id rows unbounded preceding)::bigint as split_group from e""")
def split_file_runs(spark, d):
    f = frame(spark, d, "events", order=("event_id",)).split_file("event_type").split_runs()
    return f.df.select("event_id", F.col("split_group").cast("long").alias("split_group"))


@query("""with e as (select event_id, (row_number() over (order by event_id))::int as n from events) select event_id from e where n between 5 and 500 and (n - 5) % 3 = 0""")
def list_cases(spark, d):
    return frame(spark, d, "events", order=("event_id",)).list_cases(5, 500, 3).select("event_id")


@query("""with c as (select c_custkey, c_nationkey as g, round(c_acctbal, -2) as x from customer), k as (select *, count(*) over (partition by g) as w, count(*) over (partition by g order by x range unbounded preceding) as cc, count(*) over (partition by g, x) as tw, dense_rank() over (partition by g order by x) as i from c),
r as (select *, cc - tw + (tw + 1) / 2.0 as r from k)
select c_custkey, r::double as rmean, round(r / w, 8) as rfr, round(100 * r / w, 6) as pct, round((r - 0.375) / (w + 0.25), 8) as blom, w::double as n, floor(r * 4 / (w + 1)) + 1 as nt from r""")
def rank_all(spark, d):
    c = frame(spark, d, "customer").df.withColumn("x", F.round("c_acctbal", -2))
    out = rank.rank(c, "x", {"rmean": "rank", "rfr": "rfraction", "pct": "percent", "blom": "proportion", "n": "n", "nt": "ntiles"}, by=["c_nationkey"])
    return out.select("c_custkey", "rmean", F.round("rfr", 8).alias("rfr"), F.round("pct", 6).alias("pct"), F.round("blom", 8).alias("blom"), "n", "nt")


@query("""with c as (select s_suppkey, floor(s_acctbal / 500) as x from supplier), o as (select s_suppkey, x, row_number() over (order by x) as j, count(*) over () as w from c), s as (select x, avg((select sum(1.0 / (w - k + 1)) from range(1, (j + 1)::bigint) t(k))) - 1 as sv, min(j)::double as low, max(j)::double as high from o group by x)
select s_suppkey, round(sv, 6) as sv, low, high, dense_rank() over (order by c.x)::double as con from c join s using (x)""")
def rank_savage_ties(spark, d):
    s = frame(spark, d, "supplier").df.select("s_suppkey", F.floor(F.col("s_acctbal") / 500).cast("double").alias("x"))
    out = rank.rank(s, "x", {"sv": "savage"})
    for name, ties in (("low", "low"), ("high", "high"), ("con", "condense")):
        out = rank.rank(out, "x", {name: "rank"}, ties=ties)
    return out.select("s_suppkey", F.round("sv", 6).alias("sv"), "low", "high", "con")


@query("""select n_nationkey, dense_rank() over (order by n_regionkey)::double as code, dense_rank() over (order by n_name desc)::double as down from nation""")
def autorecode(spark, d):
    n = frame(spark, d, "nation").df
    return rank.autorecode(rank.autorecode(n, "n_regionkey", "code"), "n_name", "down", descending=True).select("n_nationkey", "code", "down")


@query("""select 'r_regionkey' as CASE_LBL, 0.0::double as "0", 1.0::double as "1", 2.0::double as "2", 3.0::double as "3", 4.0::double as "4"
union all select 'twice', 0.0, 2.0, 4.0, 6.0, 8.0""")
def flip(spark, d):
    reg = frame(spark, d, "region").df.withColumn("name", F.col("r_regionkey").cast("string")).withColumn("twice", F.col("r_regionkey") * 2)
    return rank.flip(reg, ["r_regionkey", "twice"], "name", ["0", "1", "2", "3", "4"])


@query("""with c as (select p_size as value, count(*)::double as frequency, p_size = 1 as missing from part group by all)
select value, missing, frequency, round(100 * frequency / sum(frequency) over (), 6) as percent, case when not missing then round(100 * frequency / sum(frequency) filter (not missing) over (), 6) end as valid_percent,
  case when not missing then round(100 * sum(frequency) filter (not missing) over (order by value) / sum(frequency) filter (not missing) over (), 6) end as cum_percent from c""")
def frequencies(spark, d):
    return r(univariate.frequencies(frame(spark, d, "part").missing_values(p_size=Missing((1,))), "p_size"))


@query("""select round(quantile_cont(l_extendedprice, 0.1), 4) as p10, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.9), 4) as p90 from lineitem""")
def freq_percentiles(spark, d):
    return r(univariate.percentiles(frame(spark, d, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.9]), 4)


@query("""with o as (select o_orderpriority as g, list_sort(list(o_totalprice)) as v, count(*) as n from orders group by 1), t as (select *, unnest([0.25, 0.5, 0.75]) as p from o), u as (select g, p, (n + 1) * p as tt, v, n from t),
q as (select g, p, case when floor(tt)::int < 1 then tt * v[1] when floor(tt)::int >= n then v[n] else v[floor(tt)::int] + (tt - floor(tt)) * (v[floor(tt)::int + 1] - v[floor(tt)::int]) end as q from u)
select g as o_orderpriority, round(max(q) filter (p = 0.25), 4) as p25, round(max(q) filter (p = 0.5), 4) as p50, round(max(q) filter (p = 0.75), 4) as p75 from q group by g""")
def examine_haverage(spark, d):
    f = frame(spark, d, "orders").split_file("o_orderpriority")
    return r(univariate.percentiles(f, "o_totalprice", [0.25, 0.5, 0.75], "haverage"), 4)


@query("""select 'l_extendedprice' as variable, count(*)::double as n, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as sd, round(stddev_samp(l_extendedprice) / sqrt(count(*)), 6) as se_mean, round(skewness(l_extendedprice), 6) as skewness, round(kurtosis(l_extendedprice), 6) as kurtosis, min(l_extendedprice) as min, max(l_extendedprice) as max from lineitem
union all select 'l_quantity', count(*)::double, round(avg(l_quantity), 4), round(stddev_samp(l_quantity), 4), round(stddev_samp(l_quantity) / sqrt(count(*)), 6), round(skewness(l_quantity), 6), round(kurtosis(l_quantity), 6), min(l_quantity), max(l_quantity) from lineitem""")
def descriptives(spark, d):
    out = univariate.descriptives(frame(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], ["n", "mean", "sd", "se_mean", "skewness", "kurtosis", "min", "max"])
    return r(out).withColumn("mean", F.round("mean", 4)).withColumn("sd", F.round("sd", 4))


@query("""select s_suppkey, round((s_acctbal - avg(s_acctbal) over ()) / stddev_samp(s_acctbal) over (), 6) as z from supplier""")
def z_scores(spark, d):
    return r(univariate.z_scores(frame(spark, d, "supplier"), ["s_acctbal"]).select("s_suppkey", F.col("Zs_acctbal").alias("z")))


@query("""select p_brand, round(avg(p_retailprice), 6) as mean, count(*)::double as n, round(count(*) / sum(1 / p_retailprice), 6) as harmonic, round(exp(avg(ln(p_retailprice))), 6) as geometric from part group by p_brand
union all select null, round(avg(p_retailprice), 6), count(*)::double, round(count(*) / sum(1 / p_retailprice), 6), round(exp(avg(ln(p_retailprice))), 6) from part""")
def means_harmonic_geometric(spark, d):
    return r(univariate.means(frame(spark, d, "part"), "p_retailprice", ["p_brand"], ["mean", "n", "harmonic", "geometric"]))


@query("""with t as (select l_returnflag as r, l_linenumber as c, count(*)::double as o from lineitem group by all), rr as (select r, sum(o) as rt from t group by r), cc as (select c, sum(o) as ct from t group by c), n as (select sum(o) as n from t),
f as (select rr.r, cc.c, coalesce(o, 0) as o, rt * ct / n as e, n from rr cross join cc cross join n left join t on t.r = rr.r and t.c = cc.c)
select round(sum((o - e) ** 2 / e), 6) as pearson, round(2 * sum(case when o > 0 then o * ln(o / e) else 0 end), 6) as likelihood_ratio, ((count(distinct r) - 1) * (count(distinct c) - 1))::double as df, max(n) as n, round(sqrt(sum((o - e) ** 2 / e) / max(n)), 8) as phi from f""")
def crosstab_chisq(spark, d):
    out = crosstabs.chi_square(frame(spark, d, "lineitem"), "l_returnflag", "l_linenumber").select("pearson", "likelihood_ratio", "df", "n", "phi")
    return out.select(F.round("pearson", 6).alias("pearson"), F.round("likelihood_ratio", 6).alias("likelihood_ratio"), "df", "n", F.round("phi", 8).alias("phi"))


@query("""select l_returnflag, l_linestatus, count(*)::double as count, round(100.0 * count(*) / sum(count(*)) over (partition by l_returnflag), 6) as row_percent, round(100.0 * count(*) / sum(count(*)) over (), 6) as total_percent from lineitem group by l_returnflag, l_linestatus""")
def crosstab_cells(spark, d):
    return r(crosstabs.cells(frame(spark, d, "lineitem"), "l_returnflag", "l_linestatus").where("count > 0").select("l_returnflag", "l_linestatus", "count", "row_percent", "total_percent"))


@query("""select 'l_quantity' as a, 'l_extendedprice' as b, count(*)::double as n, round(corr(l_quantity, l_extendedprice), 8) as r from lineitem union all select 'l_quantity', 'l_tax', count(*)::double, round(corr(l_quantity, l_tax), 8) from lineitem union all select 'l_extendedprice', 'l_tax', count(*)::double, round(corr(l_extendedprice, l_tax), 8) from lineitem""")
def correlations(spark, d):
    return inference.correlations(frame(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).select("a", "b", "n", F.round("r", 8).alias("r"))


@query("""with g as (select avg(o_totalprice) filter (o_orderstatus = 'F') as m1, avg(o_totalprice) filter (o_orderstatus = 'O') as m2, var_samp(o_totalprice) filter (o_orderstatus = 'F') as v1, var_samp(o_totalprice) filter (o_orderstatus = 'O') as v2, count(*) filter (o_orderstatus = 'F') as n1, count(*) filter (o_orderstatus = 'O') as n2 from orders)
select round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) as t_pooled, (n1 + n2 - 2)::double as df_pooled, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as t_unequal, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) as df_unequal from g""")
def t_test(spark, d):
    out = inference.t_independent(frame(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O")
    return r(out.select("t_pooled", "df_pooled", "t_unequal", "df_unequal")).withColumn("df_unequal", F.round("df_unequal", 4))


@query("""select round(avg(value - 250) / (stddev_samp(value) / sqrt(count(*))), 6) as t, (count(*) - 1)::double as df from events""")
def t_test_one(spark, d):
    return r(inference.t_one_sample(frame(spark, d, "events"), "value", 250.0).select("t", "df"))


@query("""with g as (select o_orderpriority as g, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders group by 1), a as (select sum(n * m) / sum(n) as gm, count(*) as k, sum(n) as n from g)
select round((select sum(g.n * (m - gm) ** 2) from g) / 1e6, 4) as ssb, round((select sum((g.n - 1) * v) from g) / 1e9, 6) as ssw, round((select sum(g.n * (m - gm) ** 2) from g) / (k - 1) / ((select sum((g.n - 1) * v) from g) / (n - k)), 6) as f from a""")
def oneway(spark, d):
    return inference.anova(frame(spark, d, "orders"), "o_totalprice", "o_orderpriority").select(F.round(F.col("ss_between") / 1e6, 4).alias("ssb"), F.round(F.col("ss_within") / 1e9, 6).alias("ssw"), F.round("f", 6).alias("f"))


@query("""with c as (select value as x, event_type as g from events where event_type in ('click', 'view')), k as (select *, count(*) over (order by x range unbounded preceding) - (count(*) over (partition by x) - 1) / 2.0 as rk, count(*) over (partition by x) as tw from c),
s as (select count(*) filter (g = 'click')::double as n1, count(*) filter (g = 'view')::double as n2, sum(rk) filter (g = 'click') as w1, sum(tw * tw - 1)::double as ties from k)
select n1, n2, least(n1 * n2 + n1 * (n1 + 1) / 2 - w1, w1 - n1 * (n1 + 1) / 2)::double as u, round((least(n1 * n2 + n1 * (n1 + 1) / 2 - w1, w1 - n1 * (n1 + 1) / 2) - n1 * n2 / 2) / sqrt(n1 * n2 / ((n1 + n2) * (n1 + n2 - 1)) * (((n1 + n2) ** 3 - (n1 + n2) - ties) / 12)), 6) as z from s""")
def mann_whitney(spark, d):
    return r(inference.mann_whitney(frame(spark, d, "events"), "value", "event_type", "click", "view").select("n1", "n2", "u", "z"))


@query("""with k as (select event_type as g, count(*) over (order by value range unbounded preceding) - (count(*) over (partition by value) - 1) / 2.0 as rk, count(*) over (partition by value) as tw, count(*) over () as n from events), s as (select g, count(*) as ng, sum(rk) as rs from k group by g), t as (select sum(tw * tw - 1) as ties, max(n) as n from k)
select n::double as n, (select count(*) - 1 from s)::double as df, round((12.0 / (n * (n + 1.0)) * (select sum(rs * rs / ng) from s) - 3 * (n + 1)) / (1 - ties / (n::double ** 3 - n)), 6) as h from t""")
def kruskal_wallis(spark, d):
    return r(inference.kruskal_wallis(frame(spark, d, "events"), "value", "event_type").select("n", "df", "h"))


@query("""with c as (select l_quantity / 50 as a, l_discount * 10 as b, l_tax * 12 as c from lineitem), k as (select 1 + (b < a)::int + (c < a)::int + ((b = a)::int + (c = a)::int) / 2.0 as ra, 1 + (a < b)::int + (c < b)::int + ((a = b)::int + (c = b)::int) / 2.0 as rb, 1 + (a < c)::int + (b < c)::int + ((a = c)::int + (b = c)::int) / 2.0 as rc, ((1 + (a = b)::int + (a = c)::int) ** 2 + (1 + (a = b)::int + (b = c)::int) ** 2 + (1 + (a = c)::int + (b = c)::int) ** 2 - 3) as t from c),
s as (select count(*)::double as n, sum(ra)::double as a, sum(rb)::double as b, sum(rc)::double as c, sum(t)::double as t from k)
select n, round((12 / (n * 12) * (a * a + b * b + c * c) - 12 * n) / (1 - t / (n * 24)), 4) as chi_square, 2.0::double as df, round((12 / (n * 12) * (a * a + b * b + c * c) - 12 * n) / (1 - t / (n * 24)) / (2 * n), 8) as kendall_w from s""")
def friedman(spark, d):
    f = frame(spark, d, "lineitem").compute("a", F.col("l_quantity") / 50).compute("b", F.col("l_discount") * 10).compute("c", F.col("l_tax") * 12)
    out = inference.friedman(f, ["a", "b", "c"])
    return out.select("n", F.round("chi_square", 4).alias("chi_square"), "df", F.round("kendall_w", 8).alias("kendall_w"))


@query("""with c as (select value - 250 as d from events where value <> 250), k as (select d, count(*) over (order by abs(d) range unbounded preceding) - (count(*) over (partition by abs(d)) - 1) / 2.0 as rk from c) select count(*)::double as n, sum(rk) filter (d > 0)::double as positive, sum(rk) filter (d < 0)::double as negative from k""")
def wilcoxon(spark, d):
    f = frame(spark, d, "events").compute("mid", F.lit(250.0))
    return inference.wilcoxon(f, "value", "mid").select("n", "positive", "negative")


@query("""with c as (select event_type, count(*)::double as o from events group by 1) select round(sum((o - t / k) ** 2 / (t / k)), 6) as chi_square, (max(k) - 1)::double as df, max(t) as n from c, (select sum(o) as t, count(*) as k from c)""")
def chi_square_one(spark, d):
    return r(inference.chi_square_one(frame(spark, d, "events"), "event_type").select("chi_square", "df", "n"))


@query("""with c as (select l_quantity as a, l_discount * 100 as b, l_tax * 100 as c from lineitem) select count(*)::double as n, round(1.5 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)), 8) as alpha from c""")
def reliability_alpha(spark, d):
    f = frame(spark, d, "lineitem").compute("a", F.col("l_quantity")).compute("b", F.col("l_discount") * 100).compute("c", F.col("l_tax") * 100)
    return models.reliability(f, ["a", "b", "c"]).select("n", F.round("alpha", 8).alias("alpha"))


@query("""select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 8) as r2 from lineitem""")
def regression_simple(spark, d):
    fit = models.regression(frame(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(fit["b"][1]), 4), round(float(fit["b"][0]), 4), round(float(fit["r2"]), 8))], "slope double, intercept double, r2 double")


@query("""with c as (select n_chars as x, quality from documents join labels using (doc_id)), p as (select x, count(*)::double as n from c where quality = 1 group by x), q as (select x, count(*)::double as n from c where quality = 0 group by x)
select (select sum(n) from p) as n_positive, (select sum(n) from q) as n_negative, round(sum(p.n * q.n * case when p.x > q.x then 1.0 when p.x = q.x then 0.5 else 0.0 end) / ((select sum(n) from p) * (select sum(n) from q)), 8) as auc from p, q""")
def roc_auc(spark, d):
    c = frame(spark, d, "documents").df.select("doc_id", "n_chars").join(frame(spark, d, "labels").df, "doc_id")
    return models.roc(Frame(c), "n_chars", "quality", 1).select("n_positive", "n_negative", F.round("auc", 8).alias("auc"))


@query("""select c_nationkey, c_mktsegment, count(*)::double as n from (select * from customer where c_acctbal > 0) group by all""")
def filter_temporary(spark, d):
    f = frame(spark, d, "customer").compute("good", (F.col("c_acctbal") > 0).cast("double")).filter("good")
    return A.aggregate(f.temporary(), ["c_nationkey", "c_mktsegment"], [("n", "N")])


@query("""select s_nationkey, s_acctbal, s_suppkey from (select * from supplier order by s_suppkey limit 50)""")
def n_of_cases_sort(spark, d):
    f = frame(spark, d, "supplier", order=("s_suppkey",)).n_of_cases(50)
    return f.cases().select("s_nationkey", "s_acctbal", "s_suppkey")


@query()
def logistic_regression(spark, d):
    c = frame(spark, d, "documents").df.select("doc_id", (F.col("n_chars") / 1000).alias("k")).join(frame(spark, d, "labels").df, "doc_id")
    fit = models.logistic(Frame(c), "quality", ["k"])
    return spark.createDataFrame([(t, float(b), float(s)) for t, b, s in zip(fit["terms"], fit["b"], fit["se"], strict=True)], "term string, b double, se double")


@query()
def factor_analysis(spark, d):
    fit = models.factor(frame(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    rows = [(i, float(v)) for i, v in enumerate(fit["eigenvalues"])]
    return spark.createDataFrame(rows, "component int, eigenvalue double")


@query()
def quick_cluster(spark, d):
    centres, _ = models.quick_cluster(frame(spark, d, "lineitem"), ["l_quantity", "l_discount"], 2)
    return spark.createDataFrame([(i + 1, *map(float, c)) for i, c in enumerate(np.asarray(centres))], "cluster int, l_quantity double, l_discount double")


@query()
def glm_two_way(spark, d):
    out = models.glm(frame(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"], [("l_returnflag", "l_linestatus")])
    return spark.createDataFrame([(k, float(v[0]), float(v[1]), float(v[2])) for k, v in out.items()], "term string, ss double, df double, f double")


@query()
def crosstab_association(spark, d):
    t = crosstabs.association(crosstabs.table(frame(spark, d, "lineitem"), "l_linenumber", "l_returnflag"))
    return spark.createDataFrame([(k, float(v)) for k, v in t.items()], "measure string, value double")


@query()
def distributions(spark, d):
    p = spark.range(1, 100).select((F.col("id") / 100).alias("p"))
    return p.select("p", *[special.distribution(n, F.col("p"), *[F.lit(v) for v in a]).alias(n.replace(".", "_")) for n, a in (("probit", ()), ("idf.t", (5.0,)), ("idf.chisq", (3.0,)), ("cdf.beta", (2.0, 3.0)))])
