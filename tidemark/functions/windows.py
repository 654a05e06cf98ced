"""Rolling columns over bars (instrument, d, o, h, l, c, v): all built-in window functions, none of Python.

A value is null until its window is full. Every function returns a column, to be used after ``select`` or ``withColumn``;
windows share one partitioning and ordering, so that Spark sorts a series once for all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import desk

KEY, TIME = "instrument", "d"
ANNUAL = 252


def ordered() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TIME)


def trailing(n: int) -> WindowSpec:
    return ordered().rowsBetween(1 - n, 0)


def full(value: Column, of: Column, n: int) -> Column:
    """value where the last n rows all have of."""
    return F.when(F.count(of).over(trailing(n)) == n, value)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def simple_return(price: Column | str = "c", n: int = 1) -> Column:
    return F.try_divide(col(price), F.lag(col(price), n).over(ordered())) - 1


def log_return(price: Column | str = "c") -> Column:
    return F.log(F.try_divide(col(price), F.lag(col(price)).over(ordered())))


def mean(x: Column | str, n: int) -> Column:
    return full(F.avg(col(x)).over(trailing(n)), col(x), n)


def sd(x: Column | str, n: int) -> Column:
    return full(F.stddev_samp(col(x)).over(trailing(n)), col(x), n)


def highest(x: Column | str, n: int) -> Column:
    return full(F.max(col(x)).over(trailing(n)), col(x), n)


def lowest(x: Column | str, n: int) -> Column:
    return full(F.min(col(x)).over(trailing(n)), col(x), n)


def scaled_momentum(r: Column | str, n: int) -> Column:
    """Sum of n returns by what n independent ones would vary."""
    return F.try_divide(full(F.sum(col(r)).over(trailing(n)), col(r), n), sd(r, n) * math.sqrt(n))


def realised_vol(r: Column | str, n: int) -> Column:
    return sd(r, n) * math.sqrt(ANNUAL)


def parkinson(n: int) -> Column:
    x = F.pow(F.log(F.try_divide(F.col("h"), F.col("l"))), 2)
    return F.sqrt(mean(x, n) / (4 * math.log(2)) * ANNUAL)


def yang_zhang(n: int) -> Column:
    """From overnight, open-to-close and range variances."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    night = F.log(F.try_divide(F.col("o"), F.lag("c").over(ordered())))
    day = F.log(F.try_divide(F.col("c"), F.col("o")))
    up, down = F.log(F.try_divide(F.col("h"), F.col("o"))), F.log(F.try_divide(F.col("l"), F.col("o")))
    rs = up * (up - day) + down * (down - day)
    var = lambda x: full(F.var_samp(x).over(trailing(n)), night, n)
    return F.sqrt((var(night) + k * var(day) + (1 - k) * full(F.avg(rs).over(trailing(n)), night, n)) * ANNUAL)


def true_range() -> Column:
    prev = F.coalesce(F.lag("c").over(ordered()), F.first("c").over(ordered()))
    return F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - prev), F.abs(F.col("l") - prev))


def prior_high(x: str, n: int) -> Column:
    """Highest of the n rows before this one."""
    w = ordered().rowsBetween(-n, -1)
    return F.when(F.count(x).over(w) == n, F.max(x).over(w))


def prior_low(x: str, n: int) -> Column:
    w = ordered().rowsBetween(-n, -1)
    return F.when(F.count(x).over(w) == n, F.min(x).over(w))


def z_score(x: Column | str, n: int, least: int) -> Column:
    """Against the population of the last n rows, of which least must be there."""
    w = trailing(n)
    return F.when(F.count(col(x)).over(w) >= least, F.try_divide(col(x) - F.avg(col(x)).over(w), F.nullif(F.stddev_pop(col(x)).over(w), F.lit(0.0))))


def drawdown(x: Column | str) -> Column:
    return F.try_divide(col(x), F.max(col(x)).over(ordered().rowsBetween(Window.unboundedPreceding, 0))) - 1


def share_below(x: str, n: int) -> Column:
    """Share of the last n rows whose x is less than this one's."""
    values = F.collect_list(x).over(trailing(n))
    return full(F.size(F.filter(values, lambda y: y < F.col(x))) / F.lit(n), F.col(x), n)


#: Slope per bar beyond which a series trends.
EPS = 0.0005


def place_among(x: str, n: int, least: int) -> Column:
    """Share of the values of the last n rows, least of them at least, that are less than this row's."""
    values = F.collect_list(x).over(trailing(n))
    return F.when(F.col(x).isNotNull() & (F.size(values) >= least), F.size(F.filter(values, lambda y: y < F.col(x))) / F.size(values))


def ma_trend(price: str, fast: str, slow: str) -> Column:
    p, a, b = F.col(price), F.col(fast), F.col(slow)
    return F.when(a.isNull() | b.isNull(), "sideways").when((p > a) & (a > b), "bullish").when((p < a) & (a < b), "bearish").when(p > b, "mildly bullish").otherwise("mildly bearish")


def regime_confidence(slope: str, rank: str) -> Column:
    """Mean of how far the slope is from the threshold and the rank from the edges of its band, both in [0, 1]; 0 for what is unknown."""
    one, s, r = F.lit(1.0), F.abs(F.col(slope)), F.col(rank)
    trend = F.when(s.isNull(), 0.0).when(s > EPS, F.least(one, (s - EPS) / EPS + 0.5)).otherwise(1 - s / EPS)
    vol = F.when(r.isNull(), 0.0).when(r >= 0.7, F.least(one, (r - 0.7) / 0.3)).when(r <= 0.3, F.least(one, (0.3 - r) / 0.3)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(r - 0.5) / 0.2))
    return F.greatest(F.lit(0.0), F.least(one, 0.5 * trend + 0.5 * vol))


def moments(x: str, n: int) -> dict[str, Column]:
    """skew and excess of the last n rows, corrected for bias."""
    g1, g2 = full(F.skewness(x).over(trailing(n)), F.col(x), n), full(F.kurtosis(x).over(trailing(n)), F.col(x), n)
    return {"skew": g1 * math.sqrt(n * (n - 1)) / (n - 2), "excess": (g2 * (n + 1) + 6) * (n - 1) / ((n - 2) * (n - 3))}


def tail(skew: str, excess: str, long: bool, z: float = 2.326, low: float = 0.8, high: float = 1.5) -> Column:
    """Tail factor in [low, high]; 1 where the moments are unknown."""
    found = desk.tail_factor(F.col(skew), F.col(excess), z, long)
    return F.coalesce(F.when(found.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), found))), F.lit(1.0))
