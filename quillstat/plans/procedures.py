"""Registered queries of procedures, each with an independent SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstat.frame import Frame
from quillstat.functions import expr as E
from quillstat.operators import crosstabs, inference, models, quantiles, rank, univariate
from quillstat.plans.queries import frame, query, r

_DATES = "epoch(o_orderdate) + 12219379200"


def _dated(spark, d):
    return frame(spark, d, "orders").compute("secs", E.from_timestamp(F.col("o_orderdate")))


@query(f"""with c as (select ({_DATES})::double as x from orders), m as (select avg(x) as a, count(*)::double as n from c), s as (select n, a, sum((x - a) ** 2) as d2, sum((x - a) ** 3) as d3, sum((x - a) ** 4) as d4 from c, m group by n, a), v as (select *, d2 / (n - 1) as v from s)
select n, round(a, 0) as mean, round(sqrt(v), 2) as sd, round(n * d3 / ((n - 1) * (n - 2) * v * sqrt(v)), 5) as skewness, round(n * (n + 1) * d4 / ((n - 1) * (n - 2) * (n - 3) * v ** 2) - 3 * d2 ** 2 / ((n - 2) * (n - 3) * v ** 2), 5) as kurtosis from v""")
def descriptives_of_dates(spark, d):
    out = univariate.descriptives(_dated(spark, d), ["secs"], ["n", "mean", "sd", "skewness", "kurtosis"])
    return out.select("n", F.round("mean", 0).alias("mean"), F.round("sd", 2).alias("sd"), F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"))


@query("""with c as (select l_extendedprice as x, l_quantity as w from lineitem), m as (select sum(w * x) / sum(w) as a, sum(w) as n from c), s as (select n, a, sum(w * (x - a) ** 2) as d2, sum(w * (x - a) ** 3) as d3, sum(w * (x - a) ** 4) as d4 from c, m group by n, a), v as (select *, d2 / (n - 1) as v from s)
select n, round(a, 4) as mean, round(sqrt(v), 4) as sd, round(sqrt(v / n), 6) as se_mean, round(n * d3 / ((n - 1) * (n - 2) * v * sqrt(v)), 6) as skewness, round(n * (n + 1) * d4 / ((n - 1) * (n - 2) * (n - 3) * v ** 2) - 3 * d2 ** 2 / ((n - 2) * (n - 3) * v ** 2), 6) as kurtosis, round(sqrt(6 * n * (n - 1) / ((n - 2) * (n + 1) * (n + 3))), 8) as se_skewness from v""")
def descriptives_weighted(spark, d):
    out = univariate.descriptives(frame(spark, d, "lineitem").weight("l_quantity"), ["l_extendedprice"], ["n", "mean", "sd", "se_mean", "skewness", "kurtosis", "se_skewness"])
    return out.select("n", *[F.round(c, k).alias(c) for c, k in (("mean", 4), ("sd", 4), ("se_mean", 6), ("skewness", 6), ("kurtosis", 6), ("se_skewness", 8))])


@query(f"""with c as (select ({_DATES})::double as x, o_totalprice as y from orders) select count(*)::double as n, round(corr(x, y), 8) as r, round(corr(x, y) * sqrt((count(*) - 2) / (1 - corr(x, y) ** 2)), 6) as t, round(covar_samp(x, y) / 1e9, 3) as cov from c""")
def correlations_of_dates(spark, d):
    return inference.correlations(_dated(spark, d), ["secs", "o_totalprice"]).select("n", F.round("r", 8).alias("r"), F.round("t", 6).alias("t"), F.round(F.col("covariance") / 1e9, 3).alias("cov"))


@query("""with c as (select l_quantity as w, l_extendedprice as x, l_tax as y from lineitem), m as (select sum(w) as n, sum(w * x) / sum(w) as a, sum(w * y) / sum(w) as b from c) select max(n) as n, round(sum(w * (x - a) * (y - b)) / sqrt(sum(w * (x - a) ** 2) * sum(w * (y - b) ** 2)), 8) as r from c, m""")
def correlations_weighted(spark, d):
    return inference.correlations(frame(spark, d, "lineitem").weight("l_quantity"), ["l_extendedprice", "l_tax"]).select("n", F.round("r", 8).alias("r"))


@query("""with c as (select l_discount - l_tax as d from lineitem) select round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) as t, (count(*) - 1)::double as df, round(avg(d), 8) as difference from c""")
def t_test_paired(spark, d):
    return inference.t_paired(frame(spark, d, "lineitem"), "l_discount", "l_tax").select(F.round("t", 6).alias("t"), "df", F.round("difference", 8).alias("difference"))


@query("""with g as (select o_orderpriority as g, avg(o_totalprice) as m from orders group by 1), z as (select o_orderpriority as g, abs(o_totalprice - m) as z from orders join g on g.g = o_orderpriority), k as (select g, count(*) as n, avg(z) as m, var_samp(z) as v from z group by g), a as (select sum(n * m) / sum(n) as gm, count(*) as k, sum(n) as n from k)
select (max(a.k) - 1)::double as df_between, (max(a.n) - max(a.k))::double as df_within, round(sum(k.n * (m - gm) ** 2) / (max(a.k) - 1) / (sum((k.n - 1) * v) / (max(a.n) - max(a.k))), 6) as f from k, a""")
def levene(spark, d):
    return inference.levene(frame(spark, d, "orders"), "o_totalprice", "o_orderpriority").select("df_between", "df_within", F.round("f", 6).alias("f"))


@query("""with g as (select o_orderpriority as g, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders group by 1), w as (select sum((n - 1) * v) / (sum(n) - count(*)) as ms from g)
select a.g as g1, b.g as g2, round(a.m - b.m, 4) as difference, round(sqrt(ms * (1.0 / a.n + 1.0 / b.n)), 4) as se, round((a.m - b.m) / sqrt(ms * (1.0 / a.n + 1.0 / b.n)), 6) as t from g a join g b on a.g < b.g, w""")
def post_hoc(spark, d):
    return inference.post_hoc(frame(spark, d, "orders"), "o_totalprice", "o_orderpriority").select("g1", "g2", F.round("difference", 4).alias("difference"), F.round("se", 4).alias("se"), F.round("t", 6).alias("t"))


@query("""with g as (select o_orderpriority as g, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW') group by 1), k as (select *, case g when '1-URGENT' then 1 when '2-HIGH' then 1 else -2 end as c from g),
w as (select sum((n - 1) * v) / (sum(n) - count(*)) as ms from (select count(*) as n, var_samp(o_totalprice) as v from orders group by o_orderpriority))
select round(sum(c * m), 4) as value, round(sum(c * m) / sqrt(max(ms) * sum(c * c / n::double)), 6) as t, round(sum(c * m) / sqrt(sum(c * c * v / n)), 6) as t_unequal, round(sum(c * c * v / n) ** 2 / sum((c * c * v / n) ** 2 / (n - 1)), 3) as df_unequal from k, w""")
def contrast(spark, d):
    c = inference.contrast(frame(spark, d, "orders"), "o_totalprice", "o_orderpriority", {"1-URGENT": 1, "2-HIGH": 1, "5-LOW": -2})
    return spark.createDataFrame([(round(c["value"], 4), round(c["t"], 6), round(c["t_unequal"], 6), round(c["df_unequal"], 3))], "value double, t double, t_unequal double, df_unequal double")


@query("""select count(*) filter (l_discount > l_tax)::double as positive, count(*) filter (l_discount < l_tax)::double as negative, count(*) filter (l_discount = l_tax)::double as ties from lineitem""")
def sign_test(spark, d):
    return inference.sign_test(frame(spark, d, "lineitem"), "l_discount", "l_tax").select("positive", "negative", "ties")


_FLAGS = "select (l_quantity > 25)::int::double as a, (l_discount > .04)::int::double as b, (l_tax > .05)::int::double as c from lineitem"


def _flags(spark, d):
    return frame(spark, d, "lineitem").compute("a", (F.col("l_quantity") > 25).cast("double")).compute("b", (F.col("l_discount") > 0.04).cast("double")).compute("c", (F.col("l_tax") > 0.05).cast("double"))


@query(f"select count(*) filter (a = 0 and b = 1)::double as n01, count(*) filter (a = 1 and b = 0)::double as n10 from ({_FLAGS})")
def mcnemar(spark, d):
    return inference.mcnemar(_flags(spark, d), "a", "b", 0.0, 1.0).select("n01", "n10")


@query(f"with f as ({_FLAGS}), s as (select count(*)::double as n, sum(a) as a, sum(b) as b, sum(c) as c, sum(a + b + c) as t, sum((a + b + c) ** 2) as q from f) select n, round(2 * (3 * (a * a + b * b + c * c) - t * t) / (3 * t - q), 6) as q, 2.0::double as df from s")
def cochran(spark, d):
    return r(inference.cochran(_flags(spark, d), ["a", "b", "c"], 1.0).select("n", "q", "df"))


@query("select count(*) filter (l_quantity <= 10)::double as n1, count(*) filter (l_quantity > 10)::double as n2 from lineitem")
def binomial(spark, d):
    return inference.binomial(frame(spark, d, "lineitem"), "l_quantity", 10.0).select("n1", "n2")


@query("""with c as (select event_id, value >= 250 as up from events where value is not null), e as (select up, (up is distinct from lag(up) over (order by event_id))::int as new from c), s as (select sum(new)::double as r, count(*) filter (up)::double as a, count(*) filter (not up)::double as b from e), m as (select *, a + b as n, 2 * a * b / (a + b) + 1 as mu from s)
select r as runs, a as np, b as nn, round((r - mu) / sqrt(2 * a * b * (2 * a * b - n) / (n * n * (n - 1))), 6) as z from m""")
def runs(spark, d):
    return r(inference.runs(frame(spark, d, "events", order=("event_id",)), "value", 250.0).select("runs", "np", "nn", "z"))


@query("""with t as (select event_type as c, value > 200 as r, count(*)::double as o from events where value is not null group by all), x as (select c, sum(o) as ct from t group by c), y as (select r, sum(o) as rt from t group by r), n as (select sum(o) as n from t)
select max(n) as n, ((count(distinct x.c) - 1) * (count(distinct y.r) - 1))::double as df, round(sum((coalesce(o, 0) - rt * ct / n) ** 2 / (rt * ct / n)), 6) as chi_square from x cross join y cross join n left join t on t.c = x.c and t.r = y.r""")
def median_test(spark, d):
    return r(inference.median_test(frame(spark, d, "events"), "value", "event_type", 200.0).select("n", "df", "chi_square"))


@query("""with c as (select o_orderpriority as g, round(o_totalprice, -4) as x from orders), t as (select g, x, count(*)::double as n from c group by all), j as (select sum(a.n * b.n * case when a.x < b.x then 1 when a.x = b.x then 0.5 else 0 end) as j from t a join t b on a.g < b.g), s as (select sum(n) as n, sum(n * n) as q, sum(n * (n - 1) * (2 * n + 5)) as a, sum(n * (n - 1) * (n - 2)) as b, sum(n * (n - 1)) as d from (select g, sum(n) as n from t group by g)),
u as (select sum(n * (n - 1) * (2 * n + 5)) as a, sum(n * (n - 1) * (n - 2)) as b, sum(n * (n - 1)) as d from (select x, sum(n) as n from t group by x))
select s.n, j, (s.n * s.n - q) / 4 as mean, round((j - (s.n * s.n - q) / 4) / sqrt((s.n * (s.n - 1) * (2 * s.n + 5) - s.a - u.a) / 72 + s.b * u.b / (36 * s.n * (s.n - 1) * (s.n - 2)) + s.d * u.d / (8 * s.n * (s.n - 1))), 6) as z from j, s, u""")
def jonckheere(spark, d):
    f = frame(spark, d, "orders").compute("x", F.round("o_totalprice", -4))
    return inference.jonckheere(f, "x", "o_orderpriority").select("n", "j", "mean", F.round("z", 6).alias("z"))


@query("""with c as (select value - 250 as d from events where value <> 250), k as (select d, count(*) over (order by abs(d) range unbounded preceding) - (count(*) over (partition by abs(d)) - 1) / 2.0 as rk, count(*) over (partition by abs(d)) as tw from c), s as (select count(*)::double as n, sum(rk) filter (d > 0)::double as p, sum(rk) filter (d < 0)::double as m, sum(tw * tw - 1)::double as ties from k)
select n, round((least(p, m) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) as z from s""")
def wilcoxon_z(spark, d):
    return inference.wilcoxon(frame(spark, d, "events").compute("mid", F.lit(250.0)), "value", "mid").select("n", F.round("z", 6).alias("z"))


@query("""with v as (select l_quantity as x, count(*)::double as c from lineitem group by 1), k as (select x, c, sum(c) over (order by x) as cc, sum(c) over () as w, lag(x) over (order by x) as b from v), p as (select unnest([0.1, 0.25, 0.5, 0.9]) as p),
e as (select p, min(x) filter (cc >= w * p - 1e-9) as emp, min(x) filter (cc > w * p + 1e-9) as nxt, max((abs(cc - w * p) < 1e-9)::int) as tie, max(x) filter (cc - c + 1 <= w * p + 0.5 + 1e-9) as rnd from k, p group by p),
g as (select p, min(cc) filter (cc >= w * p - 1e-12) as at from k, p group by p), i as (select g.p, case when w * g.p - (cc - c) < 1 then coalesce(b, 0) + (w * g.p - (cc - c)) * (x - coalesce(b, 0)) else x end as wav from g join k on k.cc = g.at)
select e.p as p, emp as empirical, case when tie = 1 then (emp + coalesce(nxt, emp)) / 2 else emp end as aempirical, rnd as round, round(wav, 6) as waverage from e join i on e.p = i.p""")
def percentile_rules(spark, d):
    cases = frame(spark, d, "lineitem").df.select(F.col("l_quantity").alias("x"), F.lit(1.0).alias("w"))
    probs, rules = [0.1, 0.25, 0.5, 0.9], ["empirical", "aempirical", "round", "waverage"]
    out = None
    for rule in rules:
        one = quantiles.quantile(cases, [], "x", "w", probs, rule)
        one = one.select(F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.round(F.col(f"p{100 * p:g}"), 6).alias(rule)) for p in probs])))
        out = one if out is None else out.join(one, "p")
    return out


@query("""with c as (select c_custkey, c_nationkey as g, round(c_acctbal, -2) as x from customer), k as (select *, count(*) over (partition by g) as w, count(*) over (partition by g order by x range unbounded preceding) as cc, count(*) over (partition by g, x) as tw from c), q as (select *, cc - tw + (tw + 1) / 2.0 as r from k)
select c_custkey, round(((r - 0.5) / w)::double, 8) as rankit, round(((r - 1 / 3.0) / (w + 1 / 3.0))::double, 8) as tukey, round((r / (w + 1))::double, 8) as vw from q""")
def rank_proportions(spark, d):
    c = frame(spark, d, "customer").df.withColumn("x", F.round("c_acctbal", -2))
    for name in ("rankit", "tukey", "vw"):
        c = rank.rank(c, "x", {name: "proportion"}, by=["c_nationkey"], fraction=name)
    return c.select("c_custkey", *[F.round(n, 8).alias(n) for n in ("rankit", "tukey", "vw")])


@query("""with c as (select n_chars as x, quality from documents join labels using (doc_id)), v as (select x, count(*) filter (quality = 1)::double as p, count(*) filter (quality = 0)::double as q from c group by x) select x as cutoff, round(sum(p) over (order by x desc) / sum(p) over (), 8) as sensitivity, round(sum(q) over (order by x desc) / sum(q) over (), 8) as one_minus_specificity from v""")
def roc_coordinates(spark, d):
    c = frame(spark, d, "documents").df.select("doc_id", "n_chars").join(frame(spark, d, "labels").df, "doc_id")
    out = models.roc_coordinates(Frame(c), "n_chars", "quality", 1)
    return out.select("cutoff", F.round("sensitivity", 8).alias("sensitivity"), F.round("one_minus_specificity", 8).alias("one_minus_specificity"))


@query("""with c as (select l_quantity + l_tax * 100 as a, l_discount * 100 as b from lineitem), v as (select var_samp(a) as va, var_samp(b) as vb, var_samp(a + b) as vt from c) select round((vt - va - vb) / (2 * sqrt(va * vb)), 8) as r, round(2 * (vt - va - vb) / vt, 8) as guttman from v""")
def split_half(spark, d):
    f = frame(spark, d, "lineitem").compute("a", F.col("l_quantity")).compute("b", F.col("l_tax") * 100).compute("c", F.col("l_discount") * 100)
    return models.split_half(f, ["a", "b"], ["c"]).select(F.round("r", 8).alias("r"), F.round("guttman", 8).alias("guttman"))


@query("""with t as (select l_returnflag as r, l_linestatus as c, count(*)::double as o from lineitem group by all), rr as (select r, sum(o) as rt from t group by r), cc as (select c, sum(o) as ct from t group by c), n as (select sum(o) as n from t)
select rr.r as l_returnflag, cc.c as l_linestatus, round(100 * coalesce(o, 0) / ct, 6) as column_percent, round(rt * ct / n, 6) as expected, round(coalesce(o, 0) - rt * ct / n, 6) as residual, round((coalesce(o, 0) - rt * ct / n) / sqrt(rt * ct / n), 6) as std_residual, round((coalesce(o, 0) - rt * ct / n) / sqrt(rt * ct / n * (1 - rt / n) * (1 - ct / n)), 6) as adj_residual from rr cross join cc cross join n left join t on t.r = rr.r and t.c = cc.c""")
def crosstab_residuals(spark, d):
    return r(crosstabs.cells(frame(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select("l_returnflag", "l_linestatus", "column_percent", "expected", "residual", "std_residual", "adj_residual"))


@query("""with t as (select l_linenumber as r, l_returnflag as c, count(*)::double as o from lineitem group by all), n as (select sum(o) as n from t), rr as (select r, sum(o) as s, max(o) as m, row_number() over (order by r) - 1.0 as i from t group by r), cc as (select c, sum(o) as s, max(o) as m, row_number() over (order by c) - 1.0 as i from t group by c),
q as (select 2 * coalesce(sum(a.o * b.o) filter (a.c < b.c), 0) as conc, 2 * coalesce(sum(a.o * b.o) filter (a.c > b.c), 0) as disc from t a join t b on a.r < b.r), w as (select n, n * n - (select sum(s * s) from rr) as wr, n * n - (select sum(s * s) from cc) as wc, least((select count(*) from rr), (select count(*) from cc)) as q from n),
h as (select -sum(o / n * ln(o / n)) as hxy, (select -sum(s / n * ln(s / n)) from rr, n) as hx, (select -sum(s / n * ln(s / n)) from cc, n) as hy from t, n),
l as (select (select sum(m) from rr) as rm, (select sum(m) from cc) as cm, (select max(s) from rr) as rx, (select max(s) from cc) as cx, n from n),
z as (select sum(o * rr.i) / max(n) as mx, sum(o * cc.i) / max(n) as my from t join rr on rr.r = t.r join cc on cc.c = t.c, n), p as (select sum(o * (rr.i - mx) * (cc.i - my)) / sqrt(sum(o * (rr.i - mx) ** 2) * sum(o * (cc.i - my) ** 2)) as pr from t join rr on rr.r = t.r join cc on cc.c = t.c, z),
g as (select (n.n * sum(t.o * t.o / cc.s) - (select sum(s * s) from rr)) / (n.n * n.n - (select sum(s * s) from rr)) as gr from t join cc on cc.c = t.c, n group by n.n)
select round((conc - disc) / sqrt(wr * wc), 8) as tau_b, round(q.conc * 0 + w.q * (conc - disc) / (w.n * w.n * (w.q - 1)), 8) as tau_c, round((conc - disc) / (conc + disc), 8) as gamma, round((conc - disc) / wc, 8) as somers_d_row, round((conc - disc) / wr, 8) as somers_d_column, round(2 * (conc - disc) / (wr + wc), 8) as somers_d,
  round(2 * (hx + hy - hxy) / (hx + hy), 8) as uncertainty, round((hx + hy - hxy) / hx, 8) as uncertainty_row, round((rm + cm - cx - rx) / (2 * l.n - rx - cx), 8) as "lambda", round((cm - rx) / (l.n - rx), 8) as lambda_row, round(pr, 8) as pearson_r, round((l.n - 1) * pr * pr, 6) as linear_by_linear, round(gr, 8) as gk_tau_row from q, w, h, l, p, g""")
def crosstab_measures(spark, d):
    t = crosstabs.association(crosstabs.table(frame(spark, d, "lineitem"), "l_linenumber", "l_returnflag"))
    names = ["tau_b", "tau_c", "gamma", "somers_d_row", "somers_d_column", "somers_d", "uncertainty", "uncertainty_row", "lambda", "lambda_row", "pearson_r", "linear_by_linear", "gk_tau_row"]
    return spark.createDataFrame([tuple(round(float(t[n]), 6 if n == "linear_by_linear" else 8) for n in names)], ", ".join(f"`{n}` double" for n in names))


@query("""select event_id, lag(value, 3) over (order by event_id) as before, round(sum(value) over (order by event_id rows unbounded preceding), 3) as run from events""")
def order_over_all_cases(spark, d):
    f = frame(spark, d, "events", order=("event_id",)).with_lag("before", "value", 3).with_running("run", "value")
    return f.df.select("event_id", "before", F.round("run", 3).alias("run"))


@query("""with c as (select s_suppkey as id, s_acctbal as value from supplier) select 'highest' as end, id, value from (select * from c order by value desc, id limit 5) union all select 'lowest', id, value from (select * from c order by value, id limit 5)""")
def extremes(spark, d):
    return univariate.extremes(frame(spark, d, "supplier"), "s_acctbal", "s_suppkey").select("end", "id", "value")


@query("""select least(floor((l_quantity - 1) / 4.9), 9)::bigint as bin, count(*)::double as weight, round(1 + least(floor((l_quantity - 1) / 4.9), 9) * 4.9, 6) as low from lineitem where l_quantity between 1 and 50 group by 1, 3""")
def histogram(spark, d):
    return univariate.histogram(frame(spark, d, "lineitem"), "l_quantity", 10, 1.0, 50.0).select(F.col("bin").cast("long").alias("bin"), "weight", F.round("low", 6).alias("low"))


@query("""with c as (select l_returnflag as g, l_extendedprice as x, l_quantity as w from lineitem) select g as l_returnflag, round(avg(x), 4) as mean, count(*)::double as n, round(stddev_samp(x), 4) as sd, round(sqrt(var_samp(x) / count(*)), 6) as se_mean, max(x) - min(x) as range, round(sum(x), 2) as sum from c group by g union all select null, round(avg(x), 4), count(*)::double, round(stddev_samp(x), 4), round(sqrt(var_samp(x) / count(*)), 6), max(x) - min(x), round(sum(x), 2) from c""")
def means_statistics(spark, d):
    out = univariate.means(frame(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], ["mean", "n", "sd", "se_mean", "range", "sum"])
    return out.select("l_returnflag", F.round("mean", 4).alias("mean"), "n", F.round("sd", 4).alias("sd"), F.round("se_mean", 6).alias("se_mean"), "range", F.round("sum", 2).alias("sum"))


@query("""with k as (select l_returnflag as a, l_linestatus as b, count(*)::double as n, sum(l_extendedprice) as s from lineitem group by all), t as (select sum(n) as n, sum(s) as s from k), x as (select sum(l_extendedprice ** 2) as q from lineitem) select round((sum(k.s * k.s / k.n) - max(t.s) ** 2 / max(t.n)) / 1e6, 3) as ss, (count(*) - 1)::double as df, round(((sum(k.s * k.s / k.n) - max(t.s) ** 2 / max(t.n)) / (count(*) - 1)) / ((max(q) - sum(k.s * k.s / k.n)) / (max(t.n) - count(*))), 6) as f from (select a, sum(n) as n, sum(s) as s from k group by a) k, t, x""")
def glm_one_way(spark, d):
    ss, df, f = models.glm(frame(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])["l_returnflag"]
    return spark.createDataFrame([(round(float(ss) / 1e6, 3), float(df), round(float(f), 6))], "ss double, df double, f double")


@query("""with c as (select l_quantity as x, l_tax as z, l_extendedprice as y from lineitem), m as (select avg(x) as mx, avg(z) as mz, avg(y) as my, count(*) as n from c), s as (select sum((x - mx) ** 2) as xx, sum((z - mz) ** 2) as zz, sum((x - mx) * (z - mz)) as xz, sum((x - mx) * (y - my)) as xy, sum((z - mz) * (y - my)) as zy, sum((y - my) ** 2) as yy, max(n) as n, max(mx) as mx, max(mz) as mz, max(my) as my from c, m),
b as (select *, (xy * zz - zy * xz) / (xx * zz - xz * xz) as b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) as b2 from s), e as (select *, (yy - b1 * xy - b2 * zy) / (n - 3) as mse from b)
select round(b1, 4) as b1, round(b2, 3) as b2, round(my - b1 * mx - b2 * mz, 3) as b0, round(sqrt(mse * zz / (xx * zz - xz * xz)), 6) as se1, round(b1 / sqrt(mse * zz / (xx * zz - xz * xz)), 4) as t1, round((b1 * xy + b2 * zy) / yy, 8) as r2, round((b1 * xy + b2 * zy) / 2 / mse, 3) as f from e""")
def regression_two_terms(spark, d):
    fit = models.regression(frame(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"])
    row = (round(float(fit["b"][1]), 4), round(float(fit["b"][2]), 3), round(float(fit["b"][0]), 3), round(float(fit["se"][1]), 6), round(float(fit["t"][1]), 4), round(float(fit["r2"]), 8), round(float(fit["f"]), 3))
    return spark.createDataFrame([row], "b1 double, b2 double, b0 double, se1 double, t1 double, r2 double, f double")


@query("""select 'temporary' as data, count(*)::double as n, round(sum(s_acctbal * 2), 2) as s from supplier where s_acctbal > 1000 union all select 'restored', count(*)::double, round(sum(s_acctbal), 2) from supplier""")
def temporary_chain(spark, d):
    f = frame(spark, d, "supplier").temporary().select_if(F.col("s_acctbal") > 1000).compute("s_acctbal", F.col("s_acctbal") * 2)
    one = lambda name, g: g.df.agg(F.count("*").cast("double").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("s")).select(F.lit(name).alias("data"), "n", "s")
    return one("temporary", f).unionByName(one("restored", f.restored()))


@query("""with recursive k as (select p_partkey, p_size, 1::bigint as i, 0::double as total, p_size::double as rest from part union all select p_partkey, p_size, i + 1, total + rest, floor(rest / 2) from k where rest > 0 and i <= 40)
select p_partkey, arg_max(total, i) as total, arg_max(rest, i) as rest from k group by p_partkey""")
def loop_with_condition(spark, d):
    f = frame(spark, d, "part").loop_many({"total": F.lit(0.0), "rest": F.col("p_size").cast("double")}, lambda s, i: {"total": s["total"] + s["rest"], "rest": F.floor(s["rest"] / 2)}, while_=lambda s, i: s["rest"] > 0)
    return f.df.select("p_partkey", "total", "rest")


@query("""select c_custkey, case c_mktsegment when 'BUILDING' then 'b' when 'MACHINERY' then c_mktsegment else '' end as seg, case when c_nationkey between 0 and 4 then 0.0 when c_nationkey = 7 then 7.0 end as nat, try_cast(substr(c_name, 11) as double) as num from customer""")
def recode_into(spark, d):
    from quillstat.frame import COPY

    f = frame(spark, d, "customer").recode("c_mktsegment", [("BUILDING", "b"), ("MACHINERY", COPY)], into="seg").compute("n", F.col("c_nationkey").cast("double")).recode("n", [((0, 4), 0.0), (7, COPY)], into="nat")
    return f.compute("tail", F.substring("c_name", 11, 100)).recode("tail", [("convert", None)], into="num").df.select("c_custkey", "seg", "nat", "num")


@query("""with v as (select l_extendedprice as x, count(*)::double as c from lineitem group by 1), s as (select min(x) as lo, max(x) as hi, sum(c) as n, sum(x * c) / sum(c) as m from v), k as (select x, c, sum(c) over (order by x) as cc, lo, hi, n, m from v, s), f as (select *, (x - lo) / (hi - lo) as u, 1 - exp(-x / m) as e from k)
select 'uniform' as family, max(n) as n, round(max(cc / n - u), 8) as positive, round(min((cc - c) / n - u), 8) as negative from f union all select 'exponential', max(n), round(max(cc / n - e), 8), round(min((cc - c) / n - e), 8) from f""")
def ks_families(spark, d):
    f = frame(spark, d, "lineitem")
    one = lambda k: inference.ks_one_sample(f, "l_extendedprice", k).select(F.lit(k).alias("family"), "n", F.round("positive", 8).alias("positive"), F.round("negative", 8).alias("negative"))
    return one("uniform").unionByName(one("exponential"))


@query("""with c as (select l_quantity as a, l_discount * 100 as b, l_tax * 100 as c from lineitem), v as (select var_samp(a) as va, var_samp(b) as vb, var_samp(c) as vc, var_samp(b + c) as ra, var_samp(a + c) as rb, var_samp(a + b) as rc, avg(b + c) as ma, avg(a + c) as mb, avg(a + b) as mc, corr(a, b + c) as ka, corr(b, a + c) as kb, corr(c, a + b) as kc from c)
select 'a' as item, round(ma, 6) as mean_if_deleted, round(ra, 6) as variance_if_deleted, round(ka, 8) as item_total_r, round(2 * (1 - (vb + vc) / ra), 8) as alpha_if_deleted from v union all select 'b', round(mb, 6), round(rb, 6), round(kb, 8), round(2 * (1 - (va + vc) / rb), 8) from v union all select 'c', round(mc, 6), round(rc, 6), round(kc, 8), round(2 * (1 - (va + vb) / rc), 8) from v""")
def reliability_items(spark, d):
    f = frame(spark, d, "lineitem").compute("a", F.col("l_quantity")).compute("b", F.col("l_discount") * 100).compute("c", F.col("l_tax") * 100)
    out = models.reliability_items(f, ["a", "b", "c"])
    return out.select("item", F.round("mean_if_deleted", 6).alias("mean_if_deleted"), F.round("variance_if_deleted", 6).alias("variance_if_deleted"), F.round("item_total_r", 8).alias("item_total_r"), F.round("alpha_if_deleted", 8).alias("alpha_if_deleted"))


@query("""with c as (select (l_discount > .05)::int as y, l_returnflag as g from lineitem), r as (select avg(y) filter (g = 'R') as p from c), n as (select g, avg(y) as p from c group by g) select 'Constant' as term, round(ln(p / (1 - p)), 6) as b from r union all select 'l_returnflag(' || g || ')', round(ln(n.p / (1 - n.p)) - ln(r.p / (1 - r.p)), 6) from n, r where g <> 'R'""")
def logistic_categorical(spark, d):
    f = frame(spark, d, "lineitem").compute("y", (F.col("l_discount") > 0.05).cast("double"))
    fit = models.logistic(f, "y", ["l_returnflag"], categorical=["l_returnflag"])
    return spark.createDataFrame([(t, round(float(b), 6)) for t, b in zip(fit["terms"], fit["b"], strict=True)], "term string, b double")
