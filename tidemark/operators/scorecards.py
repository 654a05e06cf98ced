"""Scorecards: metrics of returns and trades, tables by group, concentration, seasonality.

Everything is an aggregation with built-in functions; what is counted per group is combined on the map side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def return_metrics(returns: DataFrame, key: str, time: str, r: str = "r", periods: int = 252) -> DataFrame:
    """(key, n, total, ann_vol, sharpe, sortino, max_dd, win_rate, profit_factor) of the returns of each key."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    equity = returns.filter(F.col(r).isNotNull()).withColumn("_e", F.exp(F.sum(F.log1p(r)).over(w)))
    under = equity.withColumn("_dd", F.col("_e") / F.greatest(F.max("_e").over(w), F.lit(1.0)) - 1)
    x = F.col(r)
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2)))
    return under.groupBy(key).agg(
        F.count(x).alias("n"),
        (F.exp(F.sum(F.log1p(x))) - 1).alias("total"),
        (F.stddev_samp(x) * math.sqrt(periods)).alias("ann_vol"),
        F.try_divide(F.avg(x), F.stddev_samp(x)).alias("_s"),
        F.try_divide(F.avg(x), down).alias("_d"),
        F.min("_dd").alias("max_dd"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.try_divide(F.sum(F.greatest(x, F.lit(0.0))), -F.sum(F.least(x, F.lit(0.0)))).alias("profit_factor"),
    ).select(key, "n", "total", "ann_vol", (F.col("_s") * math.sqrt(periods)).alias("sharpe"), (F.col("_d") * math.sqrt(periods)).alias("sortino"), "max_dd", "win_rate", "profit_factor")


def trade_stats(pnl: Column) -> list[Column]:
    """Count, net, win rate, expectancy and profit factor of a column of results; losses are those below 0."""
    return [
        F.count(pnl).alias("n"),
        F.sum(pnl).alias("net"),
        F.avg((pnl > 0).cast("double")).alias("win_rate"),
        F.avg(pnl).alias("expectancy"),
        F.try_divide(F.sum(F.greatest(pnl, F.lit(0.0))), -F.sum(F.least(pnl, F.lit(0.0)))).alias("profit_factor"),
    ]


def concentration(parts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, share, share_abs): each key's part of the whole; parts has a row per key."""
    # The sums are one row: joined, not windowed, so that no task sees all keys.
    whole = parts.agg(F.sum(value).alias("_net"), F.sum(F.abs(value)).alias("_abs"))
    return parts.crossJoin(F.broadcast(whole)).select(key, value, F.try_divide(value, "_net").alias("share"), F.try_divide(F.abs(value), F.col("_abs")).alias("share_abs"))


def upper_median(x: str) -> Column:
    """The element after the middle of the sorted values; not interpolated."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)")
