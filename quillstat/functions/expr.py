"""Missing-aware scalar functions as Column builders; a failed domain or a result that is not finite is missing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from 14 October 1582 to 1 January 1970 (fixed value of the date format).
EPOCH_DAYS = 141428
DAY = 86400.0


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


# -- arithmetic: 0 * missing, 0 / anything and missing ** 0 have values -----------


def mul(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), 0.0).otherwise(a * b)


def div(a: Column, b: Column) -> Column:
    return F.when(a == 0, 0.0).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def power(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & (b == 0), 1.0).when((a == 0) & b.isNull(), 0.0).when((a == 0) & (b <= 0), None).otherwise(finite(F.pow(a, b)))


def mod(a: Column, b: Column) -> Column:
    return F.when((a == 0) & b.isNull(), 0.0).otherwise(F.try_mod(a.cast("double"), b.cast("double")))


def mod10(a: Column) -> Column:
    return F.try_mod(a.cast("double"), F.lit(10.0))


def rnd(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(-F.floor(-x + 0.5)).cast("double")


def trunc(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(-F.floor(-x)).cast("double")


def exp(x: Column) -> Column:
    return finite(F.exp(x))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def lg10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def arsin(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.asin(x))


def arcos(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.acos(x))


def truth(x: Column) -> Column:
    """A number as a condition: 1 is true, other values false, missing missing."""
    return F.when(x == 1, True).when(x.isNotNull(), False)


# -- across arguments -------------------------------------------------------------


def nvalid(*a: Column) -> Column:
    return reduce(lambda x, y: x + y, [c.isNotNull().cast("double") for c in a])


def nmiss(*a: Column) -> Column:
    return F.lit(float(len(a))) - nvalid(*a)


def _enough(value: Column, least: int, a) -> Column:
    return F.when(nvalid(*a) >= least, value)


def sum_(*a: Column, least: int = 1) -> Column:
    return _enough(reduce(lambda x, y: x + y, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in a]), least, a)


def mean(*a: Column, least: int = 1) -> Column:
    return F.try_divide(sum_(*a, least=least), nvalid(*a))


def variance(*a: Column, least: int = 2) -> Column:
    m, n = mean(*a), nvalid(*a)
    ss = reduce(lambda x, y: x + y, [F.coalesce((c - m) * (c - m), F.lit(0.0)) for c in a])
    return _enough(F.try_divide(ss, n - 1), max(least, 2), a)


def sd(*a: Column, least: int = 2) -> Column:
    return F.sqrt(variance(*a, least=least))


def cfvar(*a: Column, least: int = 2) -> Column:
    return F.try_divide(sd(*a, least=least), mean(*a))


def max_(*a: Column, least: int = 1) -> Column:
    return _enough(F.greatest(*a) if len(a) > 1 else a[0], least, a)


def min_(*a: Column, least: int = 1) -> Column:
    return _enough(F.least(*a) if len(a) > 1 else a[0], least, a)


def any_(x: Column, *values) -> Column:
    return reduce(lambda a, b: a | b, [x == lit(v) for v in values])


def range_(x: Column, *bounds) -> Column:
    pairs = zip(bounds[::2], bounds[1::2], strict=True)
    return reduce(lambda a, b: a | b, [(x >= lit(lo)) & (x <= lit(hi)) for lo, hi in pairs])


# -- dates: seconds since 14 October 1582 ------------------------------------------


def from_timestamp(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6 + EPOCH_DAYS * DAY


def to_date(x: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(x / DAY) - EPOCH_DAYS).cast("int"))


def from_date(d: Column) -> Column:
    return (F.datediff(d, F.lit("1970-01-01").cast("date")) + EPOCH_DAYS) * DAY


def date_dmy(d: Column, m: Column, y: Column) -> Column:
    """Month 0 and 13 and days 0 to 31 carry over to the neighbouring month."""
    first = F.add_months(F.make_date(y.cast("int"), F.lit(1), F.lit(1)), m.cast("int") - 1)
    ok = m.between(0, 13) & d.between(0, 31)
    return F.when(ok, from_date(F.date_add(first, d.cast("int") - 1)))


def date_yrday(y: Column, day: Column) -> Column:
    return F.when(day.between(1, 366), from_date(F.date_add(F.make_date(y.cast("int"), F.lit(1), F.lit(1)), day.cast("int") - 1)))


def date_wkyr(w: Column, y: Column) -> Column:
    return F.when(w.between(1, 53), from_date(F.date_add(F.make_date(y.cast("int"), F.lit(1), F.lit(1)), (w.cast("int") - 1) * 7)))


def date_qyr(q: Column, y: Column) -> Column:
    return F.when(q.isin(1, 2, 3, 4), date_dmy(F.lit(1), q * 3 - 2, y))


def time_hms(h: Column, m: Column, s: Column) -> Column:
    return h * 3600 + m * 60 + s


def time_days(days: Column) -> Column:
    return days * DAY


def ctime(unit: str, x: Column) -> Column:
    """A length of time in days, hours, minutes or seconds."""
    return x / {"days": DAY, "hours": 3600.0, "minutes": 60.0, "seconds": 1.0}[unit]


def date_mdy(m: Column, d: Column, y: Column) -> Column:
    return date_dmy(d, m, y)


def date_moyr(m: Column, y: Column) -> Column:
    return date_dmy(F.lit(1), m, y)


def yrmoda(y: Column, m: Column, d: Column) -> Column:
    """Days since 14 October 1582; years 0 to 99 are of the twentieth century."""
    return date_dmy(d, m, F.when(y.between(0, 99), y + 1900).otherwise(y)) / DAY


def xdate(part: str, x: Column) -> Column:
    d = to_date(x)
    out = {
        "tday": lambda: F.floor(x / DAY), "hour": lambda: F.floor(x / 3600) % 24, "minute": lambda: F.floor(x / 60) % 60, "second": lambda: x % 60, "date": lambda: F.floor(x / DAY) * DAY, "time": lambda: x % DAY,
        "jday": lambda: F.dayofyear(d), "mday": lambda: F.dayofmonth(d), "month": lambda: F.month(d), "quarter": lambda: F.quarter(d), "week": lambda: F.floor((F.dayofyear(d) - 1) / 7) + 1, "wkday": lambda: F.dayofweek(d), "year": lambda: F.year(d),
    }[part]()
    return out.cast("double") if part in ("tday", "hour", "minute", "second", "date", "time") else F.when(x >= DAY, out.cast("double"))


def datediff(later: Column, earlier: Column, unit: str) -> Column:
    """Whole units between, cut towards zero."""
    seconds = {"weeks": 7 * DAY, "days": DAY, "hours": 3600.0, "minutes": 60.0, "seconds": 1.0}
    if unit in seconds:
        return trunc((later - earlier) / seconds[unit])
    whole = lambda a, b: (F.year(to_date(a)) - F.year(to_date(b))) * 12 + F.month(to_date(a)) - F.month(to_date(b)) - ((F.dayofmonth(to_date(a)) * DAY + a % DAY) < (F.dayofmonth(to_date(b)) * DAY + b % DAY)).cast("int")
    months = F.when(later >= earlier, whole(later, earlier)).otherwise(-whole(earlier, later))
    return trunc(months / {"months": 1, "quarters": 3, "years": 12}[unit])


def datesum(x: Column, n: Column, unit: str, rollover: bool = False) -> Column:
    seconds = {"weeks": 7 * DAY, "days": DAY, "hours": 3600.0, "minutes": 60.0, "seconds": 1.0}
    if unit in seconds:
        return x + n * seconds[unit]
    months = (trunc(n) * {"months": 1, "quarters": 3, "years": 12}[unit]).cast("int")
    moved = F.add_months(to_date(x), months)
    if rollover:
        moved = F.date_add(F.add_months(F.trunc(to_date(x), "month"), months), F.dayofmonth(to_date(x)) - 1)
    return from_date(moved) + x % DAY


# -- strings --------------------------------------------------------------------------


def same(a: Column, b: Column) -> Column:
    """Equality of strings, trailing blanks aside."""
    return F.rtrim(a) == F.rtrim(b)


def index(s: Column, needle: str) -> Column:
    """Place of the first ``needle``, 0 if there is none; an empty needle is missing."""
    return F.when(s.isNotNull(), F.instr(s, needle)).cast("double") if needle else F.lit(None).cast("double")


def rindex(s: Column, needle: str) -> Column:
    if not needle:
        return F.lit(None).cast("double")
    at = F.instr(F.reverse(s), needle[::-1])
    return F.when(at == 0, 0).otherwise(F.length(s) - at - len(needle) + 2).cast("double")


def lpad(s: Column, n: int, c: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, c))


def rpad(s: Column, n: int, c: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, c))


def ltrim(s: Column, c: str = " ") -> Column:
    return F.ltrim(s) if c == " " else F.ltrim(s, F.lit(c))


def rtrim(s: Column, c: str = " ") -> Column:
    return F.rtrim(s) if c == " " else F.rtrim(s, F.lit(c))


def substr(s: Column, at: Column, n: Column | None = None) -> Column:
    whole = n if n is not None else F.length(s)
    return F.when((at >= 1) & (whole >= 1), F.substr(s, at.cast("int"), whole.cast("int"))).otherwise("")


def number(s: Column, decimals: int = 0) -> Column:
    """A number in F format; without a point the last ``decimals`` digits are the fraction."""
    value = F.trim(s).try_cast("double")
    return F.when(F.instr(s, ".") > 0, value).otherwise(value / 10**decimals)


def string(x: Column, width: int, decimals: int) -> Column:
    """A number in F<width>.<decimals> format."""
    return F.lpad(F.format_string(f"%.{decimals}f", x), width, " ")


def value_label(c: Column, labels: dict) -> Column:
    out = F.lit("")
    for k, v in labels.items():
        out = F.when(c == k, v).otherwise(out)
    return out


# -- distributions with closed forms -------------------------------------------------


def closed(name: str, x: Column, *a) -> Column:
    """CDF, IDF and PDF of the distributions that need no special function; missing outside the domain."""
    kind, family = name.lower().split(".")
    a = [lit(v).cast("double") for v in a]
    z = (x - a[0]) / a[1] if len(a) > 1 else x
    p, pi = x, math.pi
    table = {
        "exp": lambda: {"cdf": F.when(x >= 0, 1 - F.exp(-a[0] * x)), "idf": F.when((p >= 0) & (p < 1), -F.log1p(-p) / a[0]), "pdf": F.when(x >= 0, a[0] * F.exp(-a[0] * x))},
        "cauchy": lambda: {"cdf": 0.5 + F.atan(z) / pi, "idf": F.when((p > 0) & (p < 1), a[0] + a[1] * F.tan(pi * (p - 0.5))), "pdf": 1 / (pi * a[1] * (1 + z * z))},
        "laplace": lambda: {"cdf": F.when(z < 0, F.exp(z) / 2).otherwise(1 - F.exp(-z) / 2), "idf": F.when((p > 0) & (p < 1), a[0] + a[1] * F.when(p < 0.5, F.log(2 * p)).otherwise(-F.log(2 * (1 - p)))), "pdf": F.exp(-F.abs(z)) / (2 * a[1])},
        "logistic": lambda: {"cdf": 1 / (1 + F.exp(-z)), "idf": F.when((p > 0) & (p < 1), a[0] + a[1] * F.log(p / (1 - p))), "pdf": F.exp(-z) / (a[1] * (1 + F.exp(-z)) * (1 + F.exp(-z)))},
        "pareto": lambda: {"cdf": F.when(x >= a[0], 1 - F.pow(a[0] / x, a[1])), "idf": F.when((p >= 0) & (p < 1), a[0] * F.pow(1 - p, -1 / a[1])), "pdf": F.when(x >= a[0], a[1] / a[0] * F.pow(a[0] / x, a[1] + 1))},
        "rayleigh": lambda: {"cdf": F.when(x >= 0, 1 - F.exp(-x * x / (2 * a[0] * a[0]))), "idf": F.when((p >= 0) & (p < 1), a[0] * F.sqrt(-2 * F.log1p(-p))), "pdf": F.when(x >= 0, x / (a[0] * a[0]) * F.exp(-x * x / (2 * a[0] * a[0])))},
        "uniform": lambda: {"cdf": F.when(x.between(a[0], a[1]), (x - a[0]) / (a[1] - a[0])), "idf": F.when(p.between(0, 1), a[0] + p * (a[1] - a[0])), "pdf": F.when(x.between(a[0], a[1]), 1 / (a[1] - a[0]))},
        "weibull": lambda: {"cdf": F.when(x >= 0, 1 - F.exp(-F.pow(x / a[0], a[1]))), "idf": F.when((p >= 0) & (p < 1), a[0] * F.pow(-F.log1p(-p), 1 / a[1])), "pdf": F.when(x >= 0, a[1] / a[0] * F.pow(x / a[0], a[1] - 1) * F.exp(-F.pow(x / a[0], a[1])))},
        "t1g": lambda: {"cdf": F.exp(-a[1] * F.exp(-a[0] * x)), "idf": F.when((p > 0) & (p < 1), -F.log(-F.log(p) / a[1]) / a[0]), "pdf": a[0] * a[1] * F.exp(-(a[1] * F.exp(-a[0] * x) + a[0] * x))},
        "t2g": lambda: {"cdf": F.when(x > 0, F.exp(-a[1] * F.pow(x, -a[0]))), "idf": F.when((p > 0) & (p < 1), F.pow(-F.log(p) / a[1], -1 / a[0])), "pdf": F.when(x > 0, a[0] * a[1] * F.pow(x, -a[0] - 1) * F.exp(-a[1] * F.pow(x, -a[0])))},
        "bernoulli": lambda: {"cdf": F.when(x == 1, 1.0).when(x == 0, 1 - a[0]), "pdf": F.when(x == 1, a[0]).when(x == 0, 1 - a[0])},
        "geom": lambda: {"cdf": F.when(x >= 1, 1 - F.pow(1 - a[0], x)), "pdf": F.when(x >= 1, a[0] * F.pow(1 - a[0], x - 1))},
    }
    return finite(table[family]()[kind])


def _stable(alpha: Column, beta: Column, seed: int) -> Column:
    """A standard stable variate from a uniform angle and an exponential."""
    v, w = math.pi * (F.rand(seed) - 0.5), -F.log1p(-F.rand(seed + 1))
    half = math.pi / 2
    one = 2 / math.pi * ((half + beta * v) * F.tan(v) - beta * F.log(half * w * F.cos(v) / (half + beta * v)))
    t = beta * F.tan(half * alpha)
    b, s = F.atan(t) / alpha, F.pow(1 + t * t, 1 / (2 * alpha))
    other = s * F.sin(alpha * (v + b)) / F.pow(F.cos(v), 1 / alpha) * F.pow(F.cos(v - alpha * (v + b)) / w, (1 - alpha) / alpha)
    return F.when(alpha == 1, one).otherwise(other)


def random_variate(family: str, seed: int, *a) -> Column:
    """A random variate, by the inverse of its distribution unless there is a shorter way."""
    from quillstat.functions.special import distribution

    u, a = F.rand(seed), [lit(v).cast("double") for v in a]
    ways = {
        "normal": lambda: a[0] + a[1] * F.randn(seed),
        "bernoulli": lambda: (u < a[0]).cast("double"),
        "lnormal": lambda: a[0] * F.exp(a[1] * F.randn(seed)),
        "geom": lambda: F.ceil(F.log1p(-u) / F.log1p(-a[0])).cast("double"),
        "levy": lambda: a[0] * _stable(a[1], F.lit(0.0), seed),
        "lvskew": lambda: a[0] * _stable(a[1], a[2], seed),
        "landau": lambda: math.pi / 2 * _stable(F.lit(1.0), F.lit(1.0), seed) + math.log(math.pi / 2),
        "xpower": lambda: F.when(F.rand(seed + 1) < 0.5, -1.0).otherwise(1.0) * a[0] * F.pow(distribution("idf.gamma", u, 1 / a[1], F.lit(1.0)), 1 / a[1]),
        "ntail": lambda: -a[1] * distribution("probit", (1 - u) * distribution("cdfnorm", -a[0] / a[1])),
        "rtail": lambda: F.sqrt(a[0] * a[0] - 2 * a[1] * a[1] * F.log1p(-u)),
        "log": lambda: F.floor(1 + F.log1p(-F.rand(seed + 1)) / F.log(1 - F.pow(1 - a[0], u))).cast("double"),
    }
    if family in ways:
        return finite(ways[family]())
    if family in ("beta", "chisq", "f", "gamma", "t", "binom", "hyper", "negbin", "poisson"):
        return distribution(f"idf.{family}", u, *a)
    return closed(f"idf.{family}", u, *a)
