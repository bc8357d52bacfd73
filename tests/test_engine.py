"""Small cases with results worked out by hand or by an independent formula."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat import Frame, Missing
from quillstat.functions import expr as E
from quillstat.functions import special as S
from quillstat.operators import aggregate as A
from quillstat.operators import combine, crosstabs, inference, models, quantiles, rank, univariate


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def test_missing_values_are_masked_where_read(spark):
    f = Frame(spark.createDataFrame([(1.0,), (9.0,), (None,)], "x double")).missing_values(x=Missing((9.0,)))
    assert rows(A.aggregate(f, [], [("s", "SUM", "x"), ("all", "SUM.", "x"), ("m", "NUMISS", "x")])) == [(1.0, 10.0, 2.0)]


def test_missing_spec_is_bounded():
    with pytest.raises(ValueError):
        Missing((1, 2, 3, 4))


def test_arithmetic_with_missing(spark):
    df = spark.createDataFrame([(0.0, None), (None, 0.0), (2.0, 0.0)], "a double, b double")
    got = df.select(E.mul(F.col("a"), F.col("b")), E.div(F.col("a"), F.col("b")), E.power(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 0.0), (0.0, None, 1.0), (0.0, None, 1.0)]


def test_percentile_definitions(spark):
    df = spark.createDataFrame([(2.0, 1.0), (5.0, 1.0), (8.0, 1.0)], "x double, w double")
    one = lambda m, p: quantiles.quantile(df, [], "x", "w", [p], m).first()[0]
    assert [round(one("haverage", p), 6) for p in (0.05, 0.1, 0.25, 0.5, 0.75)] == [0.4, 0.8, 2, 5, 8]
    assert round(one("waverage", 0.05), 6) == 0.3
    assert one("enhanced", 0.25) == 3.5


def test_percentiles_of_weights_equal_replication(spark):
    weighted = spark.createDataFrame([(1.0, 2.0), (4.0, 3.0), (9.0, 1.0)], "x double, w double")
    plain = spark.createDataFrame([(v, 1.0) for v in (1.0, 1.0, 4.0, 4.0, 4.0, 9.0)], "x double, w double")
    for m in ("haverage", "waverage", "empirical", "aempirical"):
        a, b = (quantiles.quantile(d, [], "x", "w", [0.25, 0.5, 0.9], m).first() for d in (weighted, plain))
        assert a == b, m


def test_match_is_positional_within_keys(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "N"), (3, "O")], "k int, y string")
    got = combine.match_files([(a, ["x"]), (b, ["y"])], ["k"], flags=["in_a", "in_b"])
    assert rows(got) == [(1, "a", "N", 1.0, 1.0), (1, "b", None, 1.0, 0.0), (2, "c", None, 1.0, 0.0), (3, None, "O", 0.0, 1.0)]


def test_update_ignores_blanks(spark):
    master = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k int, x string, o int")
    changes = spark.createDataFrame([(1, " ", 9), (2, "z", 9), (4, "n", 9)], "k int, x string, o int")
    got = combine.update(master, [changes], ["k"], ["o"]).select("k", "x")
    assert rows(got) == [(1, "a"), (1, "b"), (2, "z"), (4, "n")]


def test_do_if_skips_on_missing_condition(spark):
    f = Frame(spark.createDataFrame([(1.0,), (-1.0,), (None,)], "x double")).numeric("y")
    got = f.do_if([(F.col("x") > 0, {"y": F.lit(1.0)}), (None, {"y": F.lit(2.0)})]).df
    assert rows(got, "x") == [(None, None), (-1.0, 2.0), (1.0, 1.0)]


def test_rank_ties_and_savage(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 2.0, 4.0, 5.0, None)], "x double")
    got = rank.rank(df, "x", {"r": "rank", "s": "savage"})
    assert [r["r"] for r in got.orderBy("x").collect()] == [None, 1.0, 2.0, 3.5, 3.5, 5.0, 6.0]
    places = [sum(1 / (6 - k + 1) for k in range(1, j + 1)) - 1 for j in range(1, 7)]
    want = [places[0], places[1], (places[2] + places[3]) / 2, (places[2] + places[3]) / 2, places[4], places[5]]
    assert np.allclose([r["s"] for r in got.where("x is not null").orderBy("x").collect()], want)


def test_leave_folds_in_order(spark):
    f = Frame(spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 4.0)], "o int, x double"), order=("o",))
    assert [r["p"] for r in f.leave("p", lambda have, row: have * row.x, 1.0).df.orderBy("o").collect()] == [2.0, 6.0, 24.0]


def test_temporary_is_undone(spark):
    f = Frame(spark.range(10)).temporary().select_if(F.col("id") > 6)
    assert f.cases().count() == 3 and f.restored().cases().count() == 10


def test_loop_stops_after_until(spark):
    f = Frame(spark.range(1)).loop("s", F.lit(1), F.lit(10), lambda a, i: a + i, F.lit(0.0), until=lambda a, i: a >= 6)
    assert f.df.first()["s"] == 6.0


def test_oneway_and_contrast(spark):
    data = [(7, 3), (4, 3), (3, 1), (2, 1), (1, 1), (4, 2), (2, 2), (3, 2), (5, 3), (1, 1), (4, 1), (5, 2), (2, 2), (3, 3), (6, 3)]
    f = Frame(spark.createDataFrame([(float(a), b) for a, b in data], "x double, g int"))
    a = inference.anova(f, "x", "g").first()
    groups = [[x for x, g in data if g == k] for k in (1, 2, 3)]
    mean = sum(x for x, _ in data) / 15
    assert math.isclose(a["ss_between"], sum(len(g) * (np.mean(g) - mean) ** 2 for g in groups))
    assert math.isclose(a["ss_within"], sum(sum((np.array(g) - np.mean(g)) ** 2) for g in groups))
    assert inference.contrast(f, "x", "g", {1: 1, 2: -0.5, 3: -0.5})["df"] == 12


def test_chi_square(spark):
    f = Frame(spark.createDataFrame([(2, 2), (3, 1), (4, 2), (4, 1)], "x int, y int"))
    c = crosstabs.chi_square(f, "x", "y").first()
    assert math.isclose(c["pearson"], 2.0) and c["df"] == 2
    assert math.isclose(crosstabs.association(np.array([[3.0, 1], [1, 3]]))["fisher_two_sided"], 34 / 70)


def test_regression_against_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=40)
    f = Frame(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double"))
    want = np.linalg.lstsq(np.c_[np.ones(40), x], y, rcond=None)[0]
    assert np.allclose(models.regression(f, "y", ["a", "b"])["b"], want)


def test_roc_area(spark):
    f = Frame(spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1)], "x double, s int"))
    assert models.roc(f, "x", "s", 1).first()["auc"] == (0.5 + 1 + 1 + 1) / 4


def test_special_functions():
    assert math.isclose(S.normal_inverse(0.975), 1.959963984540054, rel_tol=1e-12)
    assert math.isclose(S.t_cdf(2.0, 5), 0.9490302605850709, rel_tol=1e-10)
    assert math.isclose(S.chisq_cdf(3.0, 2), 1 - math.exp(-1.5), rel_tol=1e-12)
    assert math.isclose(S.f_cdf(1.0, 1, 1), 0.5, rel_tol=1e-10)
    assert math.isclose(S.binomial_cdf(1, 3, 0.5), 0.5, rel_tol=1e-10)


def test_empty_tables(spark):
    f = Frame(spark.createDataFrame([], "x double, g int"))
    assert rows(A.aggregate(f, ["g"], [("s", "SUM", "x")])) == []
    assert rows(univariate.frequencies(f, "g")) == []
    assert rows(rank.rank(f.df, "x", {"r": "rank"})) == []


def test_case_numbers_of_shuffled_rows(spark):
    """Every case is numbered once whatever the ranges of the order are."""
    for parts in ("4", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = spark.range(0, 2_000_000, 1, 16).select(F.xxhash64("id").alias("k"))
        got = Frame(rows, order=("k",)).casenum("n").df
        assert got.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n")).first()[:] == (2_000_000, 2_000_000, 1.0, 2_000_000.0)
        assert got.orderBy("k").limit(3).select("n").collect() == got.orderBy("n").limit(3).select("n").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_order_over_all_cases(spark):
    """LAG, running sums and split runs without split groups agree with a loop over the sorted cases."""
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choice([None, 1.0, 2.5])) for i in range(500)]
    frame = Frame(spark.createDataFrame(rows, "i int, g string, x double").repartition(7), order=("i",))
    got = {r["i"]: r for r in frame.with_lag("p", "x", 2).with_running("s", "x").split_file("g").split_runs().df.collect()}
    run, total = 0, None
    for k, (i, g, x) in enumerate(rows):
        run += k == 0 or rows[k - 1][1] != g
        total = total if x is None else (total or 0) + x
        assert (got[i]["p"], got[i]["s"], got[i]["split_group"]) == (rows[k - 2][2] if k > 1 else None, total, run)
    with pytest.raises(ValueError):
        frame.lag("x")
    assert frame.with_lag("p", "x").select_if(F.lit(0.0)).df.count() == 0 and Frame(frame.df.limit(0), order=("i",)).casenum("n").df.count() == 0


def test_select_if_takes_numbers(spark):
    frame = Frame(spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double"))
    assert [r[0] for r in frame.select_if(F.col("x")).df.collect()] == [1.0]
    assert [r[0] for r in frame.select_if(F.col("x") > 1).df.collect()] == [2.0]


def test_moments_of_large_means(spark):
    """Deviations survive a mean that is a billion times larger, with and without weights."""
    rows = [(1e9 + i, 2.0, i % 2) for i in range(3)]
    df = spark.createDataFrame(rows, "x double, w double, g int")
    plain = univariate.descriptives(Frame(df), ["x"]).first()
    assert plain["sd"] == pytest.approx(1.0) and plain["skewness"] == pytest.approx(0.0, abs=1e-9)
    heavy = univariate.descriptives(Frame(df, weight_by="w"), ["x"]).first()
    assert heavy["variance"] == pytest.approx(4 / 5) and heavy["n"] == 6
    minutes = spark.range(100_000).select((F.col("id") * 60 + 1.38e10).alias("x"), F.lit(1.0).alias("w"))
    for frame in (Frame(minutes), Frame(minutes, weight_by="w")):
        assert univariate.descriptives(frame, ["x"], ["kurtosis"]).first()["kurtosis"] == pytest.approx(-1.2, abs=1e-3)
    r = inference.correlations(Frame(minutes.withColumn("y", -F.col("x")), weight_by="w"), ["x", "y"]).first()
    assert r["r"] == pytest.approx(-1.0)


def test_constant_columns_give_missing_statistics(spark):
    rows = [(5.0, float(i), i % 2, i % 3, 2.0 * i, 5.0) for i in range(12)]
    frame = Frame(spark.createDataFrame(rows, "c double, x double, g int, h int, x2 double, c2 double"), order=("x",))
    assert inference.t_one_sample(frame, "c", 4.0).first()["t"] is None
    d = univariate.descriptives(frame, ["c"]).first()
    assert (d["sd"], d["skewness"], d["kurtosis"]) == (0.0, None, None)
    assert inference.t_paired(frame, "c", "c").first()["t"] is None
    assert inference.t_independent(frame, "c", "g", 0, 1).first()["t_pooled"] is None
    assert inference.correlations(frame, ["c", "x"]).first()["r"] is None
    assert inference.anova(frame, "c", "h").first()["f"] is None
    assert inference.kruskal_wallis(frame, "c", "h").first()["h"] is None
    assert inference.mann_whitney(frame, "c", "g", 0, 1).first()["z"] is None
    assert inference.friedman(frame, ["c", "c2"]).first()["chi_square"] is None
    assert inference.runs(frame, "c", 9.0).first()["z"] is None
    assert models.reliability(frame, ["c", "c2"]).first()["alpha"] is None
    assert crosstabs.chi_square(frame, "c", "g").first()["cramers_v"] is None
    fit = models.regression(frame, "x", ["x2", "c", "x2"])
    assert fit["b"].tolist() == pytest.approx([0.0, 0.5, 0.0, 0.0]) and math.isnan(fit["t"][2]) and fit["r2"] == pytest.approx(1.0)


def test_significance_and_intervals(spark):
    """Tails against the closed forms of small degrees of freedom."""
    frame = Frame(spark.createDataFrame([(1.0, 0), (2.0, 0), (4.0, 1), (7.0, 1)], "x double, g int"))
    t = inference.t_independent(frame, "x", "g", 0, 1).first()
    # With two degrees of freedom P(|T| > t) is 1 - t / sqrt(t * t + 2).
    assert t["p_pooled"] == pytest.approx(1 - abs(t["t_pooled"]) / math.sqrt(t["t_pooled"] ** 2 + 2))
    assert inference.anova(frame, "x", "g").first()["p"] == pytest.approx(t["p_pooled"])
    half = 4.302652729749464 * t["se_pooled"]
    assert (t["ci_low_pooled"], t["ci_high_pooled"]) == pytest.approx((t["difference"] - half, t["difference"] + half))
    r = inference.correlations(frame, ["x", "g"]).first()
    assert r["p"] == pytest.approx(t["p_pooled"])
    k = inference.kruskal_wallis(frame, "x", "g").first()
    assert k["p"] == pytest.approx(math.erfc(math.sqrt(k["h"] / 2)))


def test_date_and_time_parts(spark):
    n = lambda v: F.lit(float(v))
    got = spark.range(1).select(
        E.time_days(n(2)), E.ctime("hours", n(7200)), E.ctime("days", n(43200)), E.ctime("minutes", n(90)), E.ctime("seconds", n(5)),
        E.date_mdy(n(10), n(15), n(1582)), E.date_moyr(n(11), n(1582)), E.yrmoda(n(1582), n(10), n(15)), E.yrmoda(n(70), n(1), n(1)), E.index(F.lit("ab"), ""), E.index(F.lit("ab"), "b"),
    ).first()
    assert got[:] == (172800.0, 2.0, 0.5, 1.5, 5.0, 86400.0, 18 * 86400.0, 1.0, 141428.0, None, 2.0)


def test_more_distributions(spark):
    value = lambda name, *a: spark.range(1).select(S.distribution(name, *map(F.lit, map(float, a)))).first()[0]
    assert value("pdf.binom", 1000, 2000, 0.5) == pytest.approx(0.0178390, abs=1e-6) and value("pdf.binom", 2, 3, 0.5) == pytest.approx(0.375)
    assert value("pdf.hyper", 1, 10, 4, 3) == pytest.approx(0.5) and value("cdf.hyper", 1, 10, 4, 3) == pytest.approx(2 / 3)
    assert value("pdf.negbin", 2, 3, 0.5) == pytest.approx(0.1875) and value("pdf.log", 2, 0.5) == pytest.approx(0.125 / math.log(2))
    assert value("cdf.bvnor", 0, 0, 0.5) == pytest.approx(1 / 4 + math.asin(0.5) / (2 * math.pi), abs=1e-10) and value("cdf.bvnor", 1, 2, 0) == pytest.approx(S.normal_cdf(1) * S.normal_cdf(2), abs=1e-10)
    assert value("ncdf.beta", 0.4, 2, 3, 1e-12) == pytest.approx(S.beta_p(0.4, 2, 3)) and value("pdf.landau", 0) == pytest.approx(0.178854, abs=1e-5)
    assert value("idf.poisson", 0.5, 3) == 3 and value("idf.binom", 0.5, 10, 0.3) == 3 and value("idf.chisq", 0.5, 1e8) == pytest.approx(1e8, rel=1e-6)
    # Densities are the slopes of their distribution functions.
    for name, x, a in (("f", 1.3, (4, 7)), ("lnormal", 2.0, (1.5, 0.7)), ("gamma", 2.0, (3, 1.5))):
        assert value(f"pdf.{name}", x, *a) == pytest.approx((value(f"cdf.{name}", x + 1e-5, *a) - value(f"cdf.{name}", x - 1e-5, *a)) / 2e-5, rel=1e-5)


def test_kernels_run_once_for_each_distinct_row(spark, monkeypatch):
    """Rows that repeat cost no further evaluation, in one batch or the next, and keep their places among missing ones."""
    calls, kernel = [], S.KERNELS["cdf.hyper"]
    monkeypatch.setitem(S.KERNELS, "cdf.hyper", lambda *row: calls.append(row) or kernel(*row))
    S.value.cache_clear()
    k = np.array([3.0, np.nan, 1.0, 3.0, 2.0, 1.0, np.inf, -0.0] * 5000)
    drawn = np.array([4.0, 4.0, 4.0, 4.0, 4.0, 5.0, 4.0, 4.0] * 5000)
    args = (k, np.full(len(k), 10.0), np.full(len(k), 6.0), drawn)
    for _ in range(2):
        got = S.evaluate("cdf.hyper", *args)
        assert len(calls) == len(set(calls)) == 5
        want = [kernel(*row) if math.isfinite(row[0]) else math.nan for row in zip(*[a[:8].tolist() for a in args], strict=True)]
        assert np.array_equal(got, np.array(want * 5000), equal_nan=True)
    S.value.cache_clear()
    # Out of the domain, all missing, constant, and no rows.
    assert np.isnan(S.evaluate("pdf.log", np.array([0.0, -1.0]), np.array([0.5, 2.0]))).all() and np.isnan(S.evaluate("idf.t", np.array([np.nan]), np.array([1.0]))).all()
    assert S.evaluate("lngamma", np.array([3.0, 3.0])).tolist() == [math.lgamma(3.0)] * 2 and len(S.evaluate("lngamma", np.zeros(0))) == 0
    rows = spark.createDataFrame([(1, 2.0, 4.0), (2, None, 4.0), (3, 2.0, 4.0), (4, 2.0, None), (5, 3.0, 4.0), (6, 2.0, 0.0)], "i int, x double, d double")
    got = [r[0] for r in rows.coalesce(1).select(S.distribution("cdf.chisq", F.col("x"), F.col("d")).alias("p"), "i").orderBy("i").collect()]
    assert got == [S.chisq_cdf(2.0, 4.0), None, S.chisq_cdf(2.0, 4.0), None, S.chisq_cdf(3.0, 4.0), None]


def test_special_distributions_use_all_cores(spark, tmp_path):
    """A table of one file split is dealt over several tasks."""
    from quillstat.plans.functions import special_distributions

    spark.range(4000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = special_distributions(spark, str(tmp_path)).select("p_partkey", "lngamma", F.spark_partition_id().alias("task"))
    assert out.agg(F.count("*"), F.countDistinct("p_partkey"), F.countDistinct("task")).first()[:] == (4000, 4000, 2 * spark.sparkContext.defaultParallelism)


def test_random_variates_have_their_medians(spark):
    n = 4000
    cases = (("beta", (2, 3), 0.38573), ("chisq", (5,), 4.35146), ("f", (4, 7), 0.92619), ("gamma", (3, 2), 1.33703), ("t", (4,), 0.0), ("lnormal", (2, 0.5), 2.0), ("landau", (), 1.35578), ("levy", (1, 1.5), 0.0), ("lvskew", (1, 2, 0), 0.0), ("xpower", (1, 2), 0.0), ("ntail", (1, 1), 1.41), ("rtail", (1, 1), 1.5448))
    got = spark.range(n).select(*[E.random_variate(f, 11 + i, *a).alias(f) for i, (f, a, _) in enumerate(cases)]).agg(*[F.median(f) for f, _, _ in cases]).first()
    for (family, _, median), x in zip(cases, got, strict=True):
        assert x == pytest.approx(median, abs=0.12), family
    means = spark.range(n).select(*[E.random_variate(f, 31 + i, *a).alias(f) for i, (f, a) in enumerate((("binom", (10, 0.3)), ("geom", (0.25,)), ("hyper", (10, 4, 3)), ("log", (0.5,)), ("negbin", (3, 0.5)), ("poisson", (4,))))]).agg(*[F.avg(f) for f in ("binom", "geom", "hyper", "log", "negbin", "poisson")]).first()
    assert list(means) == pytest.approx([3.0, 4.0, 1.2, 1 / (2 * math.log(2)) * 2, 3.0, 4.0], abs=0.2)


def test_large_cells_are_cumulated_by_parts(spark, monkeypatch):
    """The same ranks, percentiles and curves whether distinct values fit one window or not."""
    from quillstat import ordering

    rng = random.Random(8)
    df = spark.createDataFrame([(i, rng.choice([None, *range(40)]), rng.random() + 0.1, i % 2) for i in range(400)], "i int, v int, w double, s int").withColumn("v", F.col("v").cast("double"))
    frame = Frame(df, weight_by="w", order=("i",))

    def results():
        return [
            sorted(map(tuple, rank.rank(df, "v", {"r": "rank", "p": "percent", "k": "ntiles"}, w="w").select("i", F.round("r", 8), F.round("p", 8), "k").collect())),
            sorted(map(tuple, rank.autorecode(df, "v", "c", descending=True).select("i", "c").collect())),
            [[round(x, 8) for x in univariate.percentiles(frame, "v", [0.1, 0.5, 0.9], m).first()] for m in ("haverage", "enhanced", "empirical", "waverage")],
            sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in univariate.frequencies(frame, "v").where("value is not null").collect()),
            sorted(tuple(round(x, 8) for x in r) for r in models.roc_coordinates(frame, "v", "s", 1).collect()),
            [round(x, 8) for x in inference.mann_whitney(frame, "v", "s", 0, 1).first()],
            [round(x, 8) for x in inference.ks_normal(frame, "v").first()],
        ]

    small = results()
    monkeypatch.setattr(ordering, "SMALL", -1)
    assert results() == small


def test_files_meet_by_position(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(5)], "i int, x string").repartition(3)
    b = spark.createDataFrame([(10 * i, f"b{i}") for i in range(7)], "j int, x string").repartition(2)
    got = rows(combine.match_files([(a, ["i"]), (b, ["j"])], flags=["in_a", "in_b"]).select("i", "j", "x", "in_a", "in_b"), "j")
    assert got == [(i if i < 5 else None, 10 * i, f"a{i}" if i < 5 else f"b{i}", float(i < 5), 1.0) for i in range(7)]
    look = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (2, 1, "only")], "k int, o int, t string")
    main = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k int, n int")
    out = combine.match_files([(main, ["n"])], ["k"], tables=[(look.select("k", "t", "o"), ["o"])], first="f", last="l", rename={0: {"n": "m"}})
    assert rows(out.select("m", "t", "f", "l"), "m") == [(1, "early", 1.0, 0.0), (2, "early", 0.0, 1.0), (3, "only", 1.0, 1.0)]
    added = combine.add_files([main, main.withColumn("n", F.col("n") + 10)], ["k"], ["n"], flags=[None, "second"], first="f", number="at")
    assert rows(added.select("at", "k", "n", "second", "f"), "at") == [(1, 1, 1, 0.0, 1.0), (2, 1, 2, 0.0, 0.0), (3, 1, 11, 1.0, 0.0), (4, 1, 12, 1.0, 0.0), (5, 2, 3, 0.0, 1.0), (6, 2, 13, 1.0, 0.0)]
    with pytest.raises(ValueError):
        combine.add_files([main, look.select(F.col("t").alias("n"))])


def test_dictionary_entries(spark):
    f = Frame(spark.createDataFrame([(1, 0, "a")], "x int, y int, s string"))
    f = f.formats(x="F8.2").print_formats(x="F4.0").mrset("$m", ["x", "y"], "both", counted=1).document("one").document("two").add_document("three")
    assert f.meta.formats == {"x": "F4.0"} and f.meta.write_formats == {"x": "F8.2"} and f.meta.documents == ("two", "three")
    assert rows(f.display_mrsets()) == [("$m", "both", "counted", "x, y")] and f.delete_mrset("$m").display_mrsets().count() == 0
    with pytest.raises(ValueError):
        f.mrset("$n", ["x"])


def test_loops_of_several_variables(spark):
    f = Frame(spark.createDataFrame([(1,), (5,), (None,)], "n int"))
    got = f.loop_many({"a": F.lit(0.0), "b": F.lit(1.0)}, lambda s, i: {"a": s["b"], "b": s["a"] + s["b"]}, stop=F.col("n"))
    assert rows(got.df.select("n", "a", "b"), F.col("n").asc_nulls_first()) == [(None, 0.0, 1.0), (1, 1.0, 1.0), (5, 5.0, 8.0)]
    down = f.loop_many({"a": F.lit(0.0)}, lambda s, i: {"a": s["a"] * 10 + i}, start=5, stop=1, by=-2, until=lambda s, i: i == 3)
    assert {r["a"] for r in down.df.collect()} == {53.0}
    assert {r["a"] for r in f.loop_many({"a": F.lit(0.0)}, lambda s, i: {"a": s["a"] + 1}, most=7).df.collect()} == {7.0}


def test_studentized_range(spark):
    """Against published 5 % points of the studentized range, and the t distribution for two means."""
    for q, k, df in ((3.577935, 3, 20), (3.877676, 3, 10), (3.977, 5, 60), (3.314493, 3, 1e9), (4.327, 4, 10)):
        assert 1 - S.studentized_range_cdf(q, k, df) == pytest.approx(0.05, abs=2e-4)
    assert 1 - S.studentized_range_cdf(2.5, 2, 7) == pytest.approx(S.t_two_sided(2.5 / math.sqrt(2), 7), abs=1e-7)
    rows_ = [(v, g) for g, vs in enumerate(([1, 2, 3, 4], [3, 5, 6, 9], [2, 2, 8, 9])) for v in vs]
    frame = Frame(spark.createDataFrame([(float(v), g) for v, g in rows_], "x double, g int"))
    for r in inference.post_hoc(frame, "x", "g").collect():
        assert r["lsd"] <= r["tukey"] <= r["scheffe"] + 1e-9 and r["tukey"] <= r["bonferroni"] and 0 < r["games_howell"] < 1


def test_kolmogorov_smirnov_families(spark):
    frame = Frame(spark.createDataFrame([(float(v),) for v in (0, 1, 1, 2, 3, 3, 4, 6)], "x double"))
    got = inference.ks_one_sample(frame, "x", "poisson", 2.5).first()
    cdf = lambda k: sum(math.exp(-2.5) * 2.5**j / math.factorial(j) for j in range(int(k) + 1)) if k >= 0 else 0.0
    seen = {0: 1, 1: 3, 2: 4, 3: 6, 4: 7, 6: 8}
    assert got["positive"] == pytest.approx(max(n / 8 - cdf(v) for v, n in seen.items()))
    assert got["negative"] == pytest.approx(min(b / 8 - cdf(v - 1) for v, b in zip(seen, [0, 1, 3, 4, 6, 7], strict=True)))
    assert inference.ks_one_sample(frame, "x", "uniform", 0.0, 6.0).first()["d"] == pytest.approx(5.0 / 24 + 0, abs=0.2) and S.smirnov_tail(1.3581) == pytest.approx(0.05, abs=1e-4)


def test_promax_and_classification(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(size=(400, 2)) @ np.array([[1, 0.4], [0, 0.9]])
    x = np.hstack([f[:, [0]] + 0.4 * rng.normal(size=(400, 3)), f[:, [1]] + 0.4 * rng.normal(size=(400, 3))])
    names = [f"v{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    fit = models.factor(Frame(df), names, rotation="promax")
    pattern, between = fit["rotated"], fit["factor_correlations"]
    assert pattern.shape == (6, 2) and np.allclose(np.diag(between), 1) and abs(between[0, 1]) > 0.15
    assert np.allclose(pattern @ between @ pattern.T, fit["loadings"] @ fit["loadings"].T, atol=1e-8)
    for name, gamma in (("varimax", 1.0), ("quartimax", 0.0)):
        turned = models.rotate(fit["loadings"], gamma)
        weight = np.sqrt((turned**2).sum(1, keepdims=True))
        value = lambda b: (b**4).sum() - gamma / len(b) * ((b**2).sum(0) ** 2).sum()
        best = max(value(turned / weight @ np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])) for t in np.linspace(0, math.pi, 721))
        assert value(turned / weight) >= best - 1e-9, name
    big = np.abs(pattern).argmax(1)
    assert len(set(big[:3])) == len(set(big[3:])) == 1 and big[0] != big[3] and np.abs(np.sort(np.abs(pattern), axis=1)[:, 0]).max() < 0.15
    rows_ = [(float(i), "a" if i % 3 else "b", int(i + (i % 4) * 3 > 20)) for i in range(40)]
    frame = Frame(spark.createDataFrame(rows_, "x double, g string, y int"))
    fit = models.logistic(frame, "y", ["x", "g"], categorical=["g"])
    assert fit["terms"] == ["Constant", "x", "g(a)"]
    eta = [fit["b"][0] + fit["b"][1] * x + fit["b"][2] * (g == "a") for x, g, _ in rows_]
    # At the maximum the fitted probabilities sum to the successes, in all and for each group.
    p = [1 / (1 + math.exp(-e)) for e in eta]
    assert sum(p) == pytest.approx(sum(y for _, _, y in rows_), abs=1e-5)
    want = {}
    for e, (_, _, y) in zip(eta, rows_, strict=True):
        want[y, int(e > 0)] = want.get((y, int(e > 0)), 0) + 1
    assert {(r["observed"], r["predicted"]): r["n"] for r in models.classification(frame, fit, "y", ["x", "g"]).collect()} == want


def test_small_tables():
    """The tea table: exact tails are binomial coefficients over 70; risks against their formulas."""
    t = crosstabs.association(np.array([[3.0, 1.0], [1.0, 3.0]]))
    assert t["fisher_two_sided"] == pytest.approx(34 / 70) and t["fisher_one_sided"] == pytest.approx(17 / 70) and t["odds_ratio"] == 9 and t["kappa"] == pytest.approx(0.5)
    assert t["risk_first"] == pytest.approx(3) and t["risk_first_low"] == pytest.approx(3 * math.exp(-1.959964 * math.sqrt(1 / 12 + 3 / 4)), rel=1e-5)
    assert t["odds_ratio_high"] == pytest.approx(9 * math.exp(1.959964 * math.sqrt(8 / 3)), rel=1e-5)
    assert crosstabs.association(np.array([[3.0, 4.0]])) == {} and "kappa" not in crosstabs.association(np.array([[3.0, 1.0], [1.0, 3.0]]), same=False)
