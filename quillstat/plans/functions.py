"""Registered queries of scalar functions and distributions, each with an independent SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstat.functions import expr as E
from quillstat.functions.special import distribution
from quillstat.plans.queries import LINE_ORDER, frame, query, r


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(l_discount - .05), 8) as a, round(asin(l_discount), 8) as arsin, round(acos(l_discount), 8) as arcos, round(atan(l_quantity), 8) as artan, round(sin(l_quantity), 8) as s, round(cos(l_quantity), 8) as c, round(tan(l_tax), 8) as t,
  round(exp(l_tax), 8) as e, round(log10(l_quantity), 8) as lg, round(sqrt(l_quantity), 8) as root, floor(l_extendedprice) as cut, round(l_extendedprice - 7 * floor(l_extendedprice / 7), 6) as m, round(power(l_quantity, 1.5), 6) as p, round(l_quantity * l_discount, 8) as x, case when l_discount = 0 then 0.0 end as z from lineitem""")
def math_functions(spark, d):
    q, x, t, e = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))
    zero = E.mul(F.lit(0.0), F.when(x == 0, F.lit(None).cast("double")))
    out = frame(spark, d, "lineitem").df.select(
        *LINE_ORDER, F.round(F.abs(x - 0.05), 8).alias("a"), F.round(E.arsin(x), 8).alias("arsin"), F.round(E.arcos(x), 8).alias("arcos"), F.round(F.atan(q), 8).alias("artan"), F.round(F.sin(q), 8).alias("s"), F.round(F.cos(q), 8).alias("c"), F.round(F.tan(t), 8).alias("t"),
        F.round(E.exp(t), 8).alias("e"), F.round(E.lg10(q), 8).alias("lg"), F.round(E.sqrt(q), 8).alias("root"), E.trunc(e).alias("cut"), F.round(E.mod(e, F.lit(7.0)), 6).alias("m"), F.round(E.power(q, F.lit(1.5)), 6).alias("p"), F.round(E.mul(q, x), 8).alias("x"), F.when(x == 0, zero).alias("z"),
    )
    return out


@query("""with c as (select *, nullif(l_discount, 0) as y from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(y, 0) + l_tax, 8) as s, round(least(l_quantity, l_tax), 8) as lo, (2 + (y is not null)::int)::double as nv,
  round(((l_quantity - (l_quantity + l_tax) / 2) ** 2 + (l_tax - (l_quantity + l_tax) / 2) ** 2), 6) as var2, round(sqrt((l_quantity - (l_quantity + l_tax) / 2) ** 2 + (l_tax - (l_quantity + l_tax) / 2) ** 2) / ((l_quantity + l_tax) / 2), 6) as cf, l_quantity in (1, 5, 9) as one_of, l_quantity between 3 and 7 or l_quantity between 20 and 22 as inside, case when y is not null then l_tax + y end as strict from c""")
def argument_functions(spark, d):
    q, t, y = F.col("l_quantity"), F.col("l_tax"), F.nullif(F.col("l_discount"), F.lit(0.0))
    return frame(spark, d, "lineitem").df.select(
        *LINE_ORDER, F.round(E.sum_(y, t), 8).alias("s"), F.round(E.min_(q, t), 8).alias("lo"), E.nvalid(q, t, y).alias("nv"), F.round(E.variance(q, t), 6).alias("var2"), F.round(E.cfvar(q, t), 6).alias("cf"),
        E.any_(q, 1, 5, 9).alias("one_of"), E.range_(q, 3, 7, 20, 22).alias("inside"), E.sum_(t, y, least=2).alias("strict"),
    )


@query("""select c_custkey, rpad(c_mktsegment, greatest(12, length(c_mktsegment)::int), '*') as rp, ltrim(c_mktsegment, 'AB') as lt, rtrim(c_mktsegment, 'EY') as rt, c_custkey::double / 100 as num, lpad(format('{:.2f}', c_acctbal), 12, ' ') as str, length(c_name)::double as len, rtrim(c_mktsegment) = 'BUILDING' as eq, case c_nationkey when 1 then 'one' when 2 then 'two' else '' end as lab from customer""")
def string_padding(spark, d):
    s = F.col("c_mktsegment")
    return frame(spark, d, "customer").df.select(
        "c_custkey", E.rpad(s, 12, "*").alias("rp"), E.ltrim(s, "AB").alias("lt"), E.rtrim(s, "EY").alias("rt"), E.number(F.col("c_custkey").cast("string"), 2).alias("num"), E.string(F.col("c_acctbal"), 12, 2).alias("str"), F.length("c_name").cast("double").alias("len"),
        E.same(F.concat(s, F.lit("  ")), F.lit("BUILDING")).alias("eq"), E.value_label(F.col("c_nationkey"), {1: "one", 2: "two"}).alias("lab"),
    )


@query("""with o as (select o_orderkey, o_orderdate::date as d, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as dd, dayofyear(o_orderdate) as jd, quarter(o_orderdate) as q from orders), b as (select *, date_diff('day', date '1970-01-01', d) + 141428 as n from o)
select o_orderkey, n * 86400.0::double as mdy, (date_diff('day', date '1970-01-01', make_date(y, m, 1)) + 141428) * 86400.0::double as moyr, n::double as yrmoda, n * 86400.0::double as yrday, (date_diff('day', date '1970-01-01', make_date(y, 1, 1)) + 141428 + 7 * 9) * 86400.0::double as wkyr, (date_diff('day', date '1970-01-01', make_date(y, q * 3 - 2, 1)) + 141428) * 86400.0::double as qyr,
  (m * 3600 + dd * 60 + 5)::double as hms, m * 86400.0::double as tdays, (m * 3600 + dd * 60)::double / 3600 as chours, dd::double as mday, n::double as tday, m::double as hh, dd::double as mm, 5.0::double as ss, n * 86400.0::double as dt, (m * 3600 + dd * 60 + 5)::double as tm, ((y - 1990) * 12 + m - 1)::double as months from b""")
def date_builders(spark, d):
    o = F.col("o_orderdate")
    y, m, dd = (c.cast("double") for c in (F.year(o), F.month(o), F.dayofmonth(o)))
    at = E.date_mdy(m, dd, y) + E.time_hms(m, dd, F.lit(5.0))
    return frame(spark, d, "orders").df.select(
        "o_orderkey", E.date_mdy(m, dd, y).alias("mdy"), E.date_moyr(m, y).alias("moyr"), E.yrmoda(y, m, dd).alias("yrmoda"), E.date_yrday(y, F.dayofyear(o)).alias("yrday"), E.date_wkyr(F.lit(10), y).alias("wkyr"), E.date_qyr(F.quarter(o), y).alias("qyr"),
        E.time_hms(m, dd, F.lit(5.0)).alias("hms"), E.time_days(m).alias("tdays"), E.ctime("hours", m * 3600 + dd * 60).alias("chours"), E.xdate("mday", at).alias("mday"), E.xdate("tday", at).alias("tday"), E.xdate("hour", at).alias("hh"), E.xdate("minute", at).alias("mm"), E.xdate("second", at).alias("ss"),
        E.xdate("date", at).alias("dt"), E.xdate("time", at).alias("tm"), E.datediff(at, E.date_mdy(F.lit(1.0), F.lit(1.0), F.lit(1990.0)), "months").alias("months"),
    ).select(*[F.col(c) if c == "o_orderkey" else F.col(c).cast("double").alias(c) for c in ("o_orderkey", "mdy", "moyr", "yrmoda", "yrday", "wkyr", "qyr", "hms", "tdays", "chours", "mday", "tday", "hh", "mm", "ss", "dt", "tm", "months")])


#: name, parameters, its SQL over x (cdf and pdf) or p (idf).
CLOSED = [
    ("cdf.exp", (0.3,), "1 - exp(-0.3 * x)"), ("pdf.exp", (0.3,), "0.3 * exp(-0.3 * x)"), ("idf.exp", (0.3,), "-ln(1 - p) / 0.3"),
    ("cdf.cauchy", (2.0, 3.0), "0.5 + atan((x - 2) / 3) / pi()"), ("pdf.cauchy", (2.0, 3.0), "1 / (pi() * 3 * (1 + ((x - 2) / 3) ** 2))"), ("idf.cauchy", (2.0, 3.0), "2 + 3 * tan(pi() * (p - 0.5))"),
    ("cdf.laplace", (9.0, 4.0), "case when x < 9 then exp((x - 9) / 4) / 2 else 1 - exp(-(x - 9) / 4) / 2 end"), ("pdf.laplace", (9.0, 4.0), "exp(-abs(x - 9) / 4) / 8"), ("idf.laplace", (9.0, 4.0), "9 + 4 * case when p < 0.5 then ln(2 * p) else -ln(2 * (1 - p)) end"),
    ("cdf.logistic", (9.0, 4.0), "1 / (1 + exp(-(x - 9) / 4))"), ("pdf.logistic", (9.0, 4.0), "exp(-(x - 9) / 4) / (4 * (1 + exp(-(x - 9) / 4)) ** 2)"), ("idf.logistic", (9.0, 4.0), "9 + 4 * ln(p / (1 - p))"),
    ("cdf.pareto", (1.0, 2.5), "1 - (1 / x) ** 2.5"), ("pdf.pareto", (1.0, 2.5), "2.5 * (1 / x) ** 3.5"), ("idf.pareto", (1.0, 2.5), "(1 - p) ** (-0.4)"),
    ("cdf.rayleigh", (12.0,), "1 - exp(-x * x / 288)"), ("pdf.rayleigh", (12.0,), "x / 144 * exp(-x * x / 288)"), ("idf.rayleigh", (12.0,), "12 * sqrt(-2 * ln(1 - p))"),
    ("cdf.uniform", (0.0, 60.0), "x / 60"), ("pdf.uniform", (0.0, 60.0), "1 / 60.0"), ("idf.uniform", (0.0, 60.0), "60 * p"),
    ("cdf.weibull", (20.0, 1.5), "1 - exp(-((x / 20) ** 1.5))"), ("pdf.weibull", (20.0, 1.5), "1.5 / 20 * (x / 20) ** 0.5 * exp(-((x / 20) ** 1.5))"), ("idf.weibull", (20.0, 1.5), "20 * (-ln(1 - p)) ** (1 / 1.5)"),
    ("cdf.t1g", (0.1, 4.0), "exp(-4 * exp(-0.1 * x))"), ("pdf.t1g", (0.1, 4.0), "0.4 * exp(-(4 * exp(-0.1 * x) + 0.1 * x))"), ("idf.t1g", (0.1, 4.0), "-ln(-ln(p) / 4) / 0.1"),
    ("cdf.t2g", (1.5, 4.0), "exp(-4 * x ** (-1.5))"), ("pdf.t2g", (1.5, 4.0), "6 * x ** (-2.5) * exp(-4 * x ** (-1.5))"), ("idf.t2g", (1.5, 4.0), "(-ln(p) / 4) ** (-1 / 1.5)"),
    ("cdf.geom", (0.1,), "1 - 0.9 ** x"), ("pdf.geom", (0.1,), "0.1 * 0.9 ** (x - 1)"), ("cdf.bernoulli", (0.3,), "case x when 1 then 1.0 end"), ("pdf.bernoulli", (0.3,), "case x when 1 then 0.3 end"),
]


@query("with c as (select p_partkey, p_size::double as x, p_size / 51.0::double as p from part) select p_partkey, " + ", ".join(f"round(({sql})::double, 8) as {name.replace('.', '_')}" for name, _, sql in CLOSED) + " from c")
def closed_distributions(spark, d):
    x, p = F.col("p_size").cast("double"), F.col("p_size") / 51.0
    return frame(spark, d, "part").df.select("p_partkey", *[F.round(E.closed(name, p if name.startswith("idf") else x, *a), 8).alias(name.replace(".", "_")) for name, a, _ in CLOSED])


def _sum(term: str, upto: str, start: int = 0) -> str:
    return f"list_sum(list_transform(range({start}, ({upto})::int + 1), lambda i: {term}))"


_CHOOSE = "exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))".format
#: name, parameters, its SQL over x, k (whole) and u (between 0 and 1).
SPECIAL = [
    ("pdf.normal", "x", (9.0, 4.0), "exp(-(((x - 9) / 4) ** 2) / 2) / (4 * sqrt(2 * pi()))"), ("pdf.lnormal", "x", (5.0, 0.7), "exp(-((ln(x / 5) / 0.7) ** 2) / 2) / (x * 0.7 * sqrt(2 * pi()))"),
    ("pdf.t", "x", (5.0,), "exp(lgamma(3.0) - lgamma(2.5)) / sqrt(5 * pi()) * (1 + x * x / 5) ** (-3)"), ("cdf.t", "x", (1.0,), "0.5 + atan(x) / pi()"), ("idf.t", "u", (1.0,), "tan(pi() * (u - 0.5))"),
    ("pdf.chisq", "x", (5.0,), "exp(1.5 * ln(x) - x / 2 - 2.5 * ln(2) - lgamma(2.5))"), ("cdf.chisq", "x", (4.0,), "1 - exp(-x / 2) * (1 + x / 2)"), ("sig.chisq", "x", (2.0,), "exp(-x / 2)"), ("idf.chisq", "u", (2.0,), "-2 * ln(1 - u)"),
    ("pdf.gamma", "x", (3.0, 0.5), "exp(3 * ln(0.5) + 2 * ln(x) - 0.5 * x - lgamma(3.0))"), ("cdf.gamma", "x", (2.0, 0.5), "1 - exp(-x / 2) * (1 + x / 2)"), ("idf.gamma", "u", (1.0, 0.5), "-2 * ln(1 - u)"),
    ("pdf.beta", "u", (2.0, 3.0), "12 * u * (1 - u) ** 2"), ("cdf.beta", "u", (2.0, 3.0), "6 * u ** 2 - 8 * u ** 3 + 3 * u ** 4"), ("idf.beta", "u", (1.0, 3.0), "1 - (1 - u) ** (1 / 3.0::double)"),
    ("pdf.f", "x", (2.0, 6.0), "(1 + x / 3) ** (-4)"), ("cdf.f", "x", (2.0, 6.0), "1 - (1 + x / 3) ** (-3)"), ("sig.f", "x", (2.0, 6.0), "(1 + x / 3) ** (-3)"), ("idf.f", "u", (2.0, 6.0), "3 * ((1 - u) ** (-1 / 3.0::double) - 1)"),
    ("pdf.binom", "k", (60.0, 0.3), _CHOOSE(n=60, k="k") + " * 0.3 ** k * 0.7 ** (60 - k)"), ("cdf.binom", "k", (60.0, 0.3), _sum(_CHOOSE(n=60, k="i") + " * 0.3 ** i * 0.7 ** (60 - i)", "k")),
    ("pdf.poisson", "k", (20.0,), "exp(k * ln(20) - 20 - lgamma(k + 1))"), ("cdf.poisson", "k", (20.0,), _sum("exp(i * ln(20) - 20 - lgamma(i + 1))", "k")),
    ("pdf.negbin", "k", (3.0, 0.2), "exp(lgamma(3 + k) - lgamma(3.0) - lgamma(k + 1)) * 0.2 ** 3 * 0.8 ** k"), ("cdf.negbin", "k", (3.0, 0.2), _sum("exp(lgamma(3 + i) - lgamma(3.0) - lgamma(i + 1)) * 0.2 ** 3 * 0.8 ** i", "k")),
    ("pdf.hyper", "k", (100.0, 60.0, 55.0), f"case when k < 15 then 0 else {_CHOOSE(n=60, k='k')} * {_CHOOSE(n=40, k='(55 - k)')} / {_CHOOSE(n=100, k=55)} end"), ("cdf.hyper", "k", (100.0, 60.0, 55.0), f"case when k < 15 then 0 else {_sum(f'{_CHOOSE(n=60, k="i")} * {_CHOOSE(n=40, k="(55 - i)")} / {_CHOOSE(n=100, k=55)}', 'k', 15)} end"),
    ("pdf.log", "k", (0.6,), "-(0.6 ** k) / (k * ln(0.4))"), ("pdf.xpower", "x", (9.0, 2.0), "exp(-((x / 9) ** 2)) / (18 * exp(lgamma(1.5)))"), ("pdf.rtail", "x", (4.0, 9.0), "case when x < 4 then 0 else x / 81 * exp((16 - x * x) / 162) end"), ("pdf.bvnor", "u", (0.4, 0.3), "exp(-(u * u - 0.24 * u + 0.16) / 1.82) / (2 * pi() * sqrt(0.91))"),
    ("lngamma", "x", (), "lgamma(x)"),
]


@query("with c as (select p_partkey, p_size::double as x, p_size::double as k, p_size / 51.0::double as u from part) select p_partkey, " + ", ".join(f"round(({sql})::double, 6) as {name.replace('.', '_')}" for name, _, _, sql in SPECIAL) + " from c")
def special_distributions(spark, d):
    of = {"x": F.col("p_size").cast("double"), "k": F.col("p_size").cast("double"), "u": F.col("p_size") / 51.0}
    part = frame(spark, d, "part").df.select("p_partkey", "p_size").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")  # a table of few file splits would keep few cores busy
    return part.select("p_partkey", *[F.round(distribution(name, of[arg], *map(F.lit, a)), 6).alias(name.replace(".", "_")) for name, arg, a, _ in SPECIAL])


@query("""select s_suppkey, case when s_acctbal > 5000 then 2.0 when s_acctbal > 0 then 1.0 else 0.0 end as band, (s_acctbal is null)::int::double as gone, s_nationkey as nation, case when s_acctbal between -500 and 0 then null else s_acctbal end as seen, case when s_nationkey = 3 then 'three' else '' end as lab from supplier""")
def conditional_assignment(spark, d):
    from quillstat.frame import Missing

    f = frame(spark, d, "supplier").missing_values(s_acctbal=Missing((), -500.0, 0.0)).compute("band", F.lit(0.0)).if_(F.col("s_acctbal") > 0, "band", F.lit(1.0)).if_(F.col("s_acctbal") > 5000, "band", F.lit(2.0))
    f = f.compute("gone", F.col("s_acctbal").isNull().cast("double")).rename_variables(s_nationkey="nation").compute("seen", f.valid("s_acctbal")).value_labels("nation", {3: "three"})
    f = f.compute("lab", E.value_label(F.col("nation"), f.meta.value_labels["nation"])).modify_vars(drop=["s_name", "s_acctbal"], reorder=["s_suppkey"])
    return r(f.df.select("s_suppkey", "band", "gone", "nation", "seen", "lab"))
