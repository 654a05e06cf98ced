"""Statistics of two or more return series: correlations of every two, tests of one against another, deflated Sharpe ratios.

Series are joined by day, so the rows are those of a day's instruments with each other; a day has few instruments, whatever the length of history.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import desk


def correlations(returns: DataFrame, last: int | None) -> DataFrame:
    """(a, b, corr, n) of every two instruments of returns (instrument, d, r), over their last common days, or all."""
    one, two = (returns.select("d", F.col("instrument").alias(k), F.col("r").alias(f"_{k}")) for k in "ab")
    both = one.join(two, "d").filter(F.col("a") < F.col("b"))
    if last:
        both = both.withColumn("_i", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("d")))).filter(F.col("_i") <= last)
    return both.groupBy("a", "b").agg(F.corr("_a", "_b").alias("corr"), F.count("*").alias("n"))


def neighbours(correlated: DataFrame, least: float) -> DataFrame:
    """(instrument, together): how many others each is correlated with at least so much."""
    each = correlated.select(F.explode(F.array("a", "b")).alias("instrument"), "corr")
    return each.groupBy("instrument").agg(F.count_if(F.col("corr") >= least).alias("together"))


def normal_below(x: Column) -> Column:
    """Probability of a normal value below x, to seven digits, by the published polynomial."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def diebold_mariano(returns: DataFrame) -> DataFrame:
    """One row (n, dm, p) of aligned returns (a, b): whether the squared returns of b are larger, corrected for small samples."""
    loss = F.col("b") * F.col("b") - F.col("a") * F.col("a")
    found = returns.agg(F.avg(loss).alias("m"), F.var_pop(loss).alias("v"), F.count("*").cast("double").alias("n"))
    stat = F.when(F.col("v") > 0, F.sqrt((F.col("n") - 1) / F.col("n")) * F.col("m") / F.sqrt(F.col("v") / F.col("n"))).otherwise(0.0)
    return found.select("n", stat.alias("dm")).withColumn("p", 1 - normal_below(F.col("dm")))


def deflated_sharpe(returns: DataFrame, key: str, trials: float) -> DataFrame:
    """(key, sharpe, benchmark, dsr) of returns (key, r): the chance that a Sharpe ratio is truly above the best of so many trials without skill."""
    each = returns.groupBy(key).agg(F.count("*").alias("n"), (F.avg("r") / F.stddev_samp("r")).alias("sharpe"), F.skewness("r").alias("g3"), (F.kurtosis("r") + 3).alias("g4"))
    spread = each.agg(F.stddev_samp("sharpe").alias("_sd")).select(desk.expected_best(F.col("_sd"), F.lit(trials)).alias("benchmark"))
    s = F.col("sharpe")
    below = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("g3") * s + (F.col("g4") - 1) / 4 * s * s))
    x = (s - F.col("benchmark")) * F.sqrt(F.col("n") - 1) / below
    return each.crossJoin(F.broadcast(spread)).select(key, "sharpe", "benchmark", normal_below(x).alias("dsr"))


def aligned(returns: DataFrame) -> DataFrame:
    """(a, b, d, x, y): of every two instruments of returns (instrument, d, r) the days that both have."""
    one, two = (returns.filter("r IS NOT NULL").select("d", F.col("instrument").alias(k), F.col("r").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return one.join(two, "d").filter(F.col("a") < F.col("b")).select("a", "b", "d", "x", "y")


def diebold_mariano_pairs(both: DataFrame, h: int = 1) -> DataFrame:
    """(a, b, n, dm, p) of aligned returns (a, b, d, x, y): whether the squared returns of b are larger over h steps, with Bartlett weights on the first h - 1 autocovariances and the correction for small samples.

    dm is 0 where the variance isn't positive."""
    by_day = Window.partitionBy("a", "b").orderBy("d")
    loss = both.withColumn("_d", F.col("y") * F.col("y") - F.col("x") * F.col("x"))
    means = loss.groupBy("a", "b").agg(F.avg("_d").alias("_m"), F.count("*").cast("double").alias("n"))
    centred = loss.join(means, ["a", "b"]).withColumn("_e", F.col("_d") - F.col("_m"))
    centred = centred.withColumns({f"_l{k}": F.lag("_e", k).over(by_day) for k in range(1, h)})
    found = centred.groupBy("a", "b", "n", F.col("_m")).agg(F.avg(F.col("_e") * F.col("_e")).alias("_g0"), *[F.avg(F.col("_e") * F.col(f"_l{k}")).alias(f"_g{k}") for k in range(1, h)])
    var = F.col("_g0") + 2 * sum([(1 - k / h) * F.coalesce(f"_g{k}", F.lit(0.0)) for k in range(1, h)], F.lit(0.0))
    n = F.col("n")
    stat = F.when(var > 0, F.col("_m") / F.sqrt(var / n)).otherwise(0.0) * F.sqrt(F.greatest(F.lit(0.0), (n + 1 - 2 * h + h * (h - 1) / n) / n))
    return found.select("a", "b", "n", stat.alias("dm")).withColumn("p", 1 - normal_below(F.col("dm")))
