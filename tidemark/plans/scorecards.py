"""Queries of scorecards and cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.operators import crosssection as xs, scorecards as sc
from tidemark.plans.bars import day_bars
from tidemark.plans.indicators import rounded
from tidemark.plans.joins import BARS


def _returns(spark, sf_dir) -> DataFrame:
    """Log returns scaled down to the size of market returns: the synthetic prices jump."""
    return day_bars(spark, sf_dir).withColumn("r", w.log_return() / 100)


def _trades(spark, sf_dir) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("d"), F.col("l_returnflag").alias("regime"), F.col("l_linestatus").alias("side"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"), F.col("l_tax").alias("confidence"), "l_orderkey", "l_linenumber")


_R = f"{BARS}, r AS (SELECT *, ln(c / lag(c) OVER (PARTITION BY instrument ORDER BY d)) / 100 AS r FROM day_bars)"
_T = "t AS (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS d, l_returnflag AS regime, l_linestatus AS side, l_extendedprice * (l_discount - 0.05) AS pnl, l_tax AS confidence, l_orderkey, l_linenumber FROM lineitem)"
_STATS = "count(pnl) AS n, round(sum(pnl), 4) AS net, round(avg(CAST(pnl > 0 AS DOUBLE)), 6) AS win_rate, round(avg(pnl), 6) AS expectancy, round(sum(greatest(pnl, 0)) / nullif(-sum(least(pnl, 0)), 0), 6) AS profit_factor"


def _stats(df: DataFrame, keys: list[str]) -> DataFrame:
    return rounded(df.withColumn("net", F.round("net", 4)), keys)


def a6_return_metrics(spark, sf_dir):
    return rounded(sc.return_metrics(_returns(spark, sf_dir), "instrument", "d"), ["instrument"])


def a8_by_regime(spark, sf_dir):
    return _stats(_trades(spark, sf_dir).groupBy("regime").agg(*sc.trade_stats(F.col("pnl"))), ["regime"])


def a12_upper_median(spark, sf_dir):
    # One quotient a day and instrument first, so that what is sorted stays small.
    daily = _trades(spark, sf_dir).groupBy("regime", "d").agg(F.sum("pnl").alias("x"))
    return rounded(daily.groupBy("regime").agg(F.round(sc.upper_median("x"), 4).alias("median")), ["regime"])


def a13_brier(spark, sf_dir):
    won = (F.col("pnl") > 0).cast("double")
    p = F.col("confidence") * 10 + 0.1
    band = F.when(p < 0.3, "low").when(p < 0.6, "mid").otherwise("high")
    t = _trades(spark, sf_dir)
    return rounded(t.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(won).alias("win_rate"), F.avg(p).alias("predicted"), F.avg(F.pow(p - won, 2)).alias("brier")), ["band"])


def a18_calibration(spark, sf_dir):
    band = F.least(F.floor(F.col("confidence") * 100 / 2), F.lit(4)).cast("long")
    t = _trades(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate")).filter("n >= 3")
    return rounded(t.withColumn("shrunk", (F.col("win_rate") * F.col("n") + 0.5 * 12) / (F.col("n") + 12)), ["band"])


def a20_exposure(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    signed = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return o.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("gross"), F.round(F.sum(signed), 2).alias("net"))


def a25_attribution(spark, sf_dir):
    parts = _trades(spark, sf_dir).groupBy("instrument").agg(F.sum("pnl").alias("net"))
    return sc.concentration(parts, "instrument", "net").select("instrument", F.round("net", 4).alias("net"), F.round("share_abs", 9).alias("share_abs"))


def a25_concentration(spark, sf_dir):
    parts = _trades(spark, sf_dir).groupBy("instrument").agg(F.sum("pnl").alias("net"))
    shares = sc.concentration(parts, "instrument", "net")
    return shares.agg(F.round(F.sum(F.pow("share_abs", 2)), 9).alias("hhi"), F.round(1 / F.sum(F.pow("share_abs", 2)), 6).alias("effective_n"))


def a29_cells(spark, sf_dir):
    t = _trades(spark, sf_dir).cube("regime", "side").agg(F.grouping_id().cast("long").alias("level"), *sc.trade_stats(F.col("pnl")))
    return _stats(t, ["regime", "side", "level"])


def a30_rolling_sums(spark, sf_dir):
    ws = Window.partitionBy("instrument").orderBy("d", "l_orderkey", "l_linenumber").rowsBetween(-19, 0)
    t = _trades(spark, sf_dir).withColumn("s", F.when(F.count("*").over(ws) == 20, F.sum("pnl").over(ws)))
    return t.groupBy("instrument").agg(F.round(F.min("s"), 4).alias("worst"), F.round(F.percentile("s", F.lit(0.05)), 2).alias("p05"), F.round(F.percentile("s", F.lit(0.5)), 2).alias("median"))


def a33_month_tails(spark, sf_dir):
    months = day_bars(spark, sf_dir).groupBy("instrument", F.trunc("d", "MM").alias("m")).agg(F.max_by("c", "d").alias("c"))
    diff = months.withColumn("x", F.col("c") - F.lag("c").over(Window.partitionBy("instrument").orderBy("m")))
    return rounded(diff.groupBy("instrument").agg(F.count("x").alias("n"), F.avg((F.col("x") > 0).cast("double")).alias("positive"), F.min("x").alias("worst")), ["instrument"])


def a34_by_year(spark, sf_dir):
    t = _trades(spark, sf_dir).withColumn("year", F.year("d").cast("long"))
    both = t.rollup("year", "side").agg(*sc.trade_stats(F.col("pnl")))
    return _stats(both, ["year", "side"])


def a36_daily_losses(spark, sf_dir):
    daily = _trades(spark, sf_dir).groupBy("side", "d").agg(F.sum("pnl").alias("x"))
    return daily.groupBy("side").agg(F.round(F.percentile("x", F.lit(0.01)), 4).alias("p01"), F.round(F.percentile("x", F.lit(0.05)), 4).alias("p05"), F.round(F.min("x"), 4).alias("worst"))


def a46_seasonality(spark, sf_dir):
    m = day_bars(spark, sf_dir).groupBy("instrument", F.year("d").alias("y"), F.month("d").cast("long").alias("month")).agg((F.max_by("c", "d") / F.min_by("c", "d") - 1).alias("r"))
    return rounded(m.groupBy("instrument", "month").agg(F.count("*").alias("years"), F.avg("r").alias("mean"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.max("r").alias("best"), F.min("r").alias("worst")).filter("years >= 3"), ["instrument", "month"])


def a47_top_market(spark, sf_dir):
    n = _trades(spark, sf_dir).groupBy("instrument").agg(F.count("*").alias("n"))
    return n.agg(F.max_by("instrument", F.struct("n", -F.col("instrument"))).alias("instrument"), F.max("n").alias("n"))


def r1_long_short(spark, sf_dir):
    scored = _returns(spark, sf_dir).withColumn("score", w.scaled_momentum("r", 21))
    return rounded(xs.buckets(scored, "score", 0.3, 3).select("instrument", "d", "z", "side"), ["instrument", "d"])


def r2_top_two(spark, sf_dir):
    scored = day_bars(spark, sf_dir).withColumn("score", w.simple_return(n=21)).filter("score IS NOT NULL")
    k = F.row_number().over(xs.day().orderBy(F.desc("score"), "instrument"))
    return rounded(scored.withColumn("k", k.cast("long")).filter("k <= 2").select("instrument", "d", "k", "score"), ["instrument", "d"])


def r7_above_median(spark, sf_dir):
    scored = day_bars(spark, sf_dir).withColumn("score", w.simple_return(n=21)).filter("score IS NOT NULL")
    median = scored.groupBy("d").agg(F.percentile("score", F.lit(0.5)).alias("m"))
    return scored.join(median, "d").select("instrument", "d", (F.col("score") > F.col("m")).alias("above"))


def r8_average_rank(spark, sf_dir):
    b = day_bars(spark, sf_dir).withColumn("rank", xs.average_rank("v").cast("double"))
    return b.select("instrument", "d", "rank")


def w51_inverse_vol(spark, sf_dir):
    b = _returns(spark, sf_dir).withColumn("vol", w.sd("r", 20)).filter("vol IS NOT NULL")
    return rounded(b.withColumn("weight", xs.inverse_vol_weights("vol")).select("instrument", "d", "weight"), ["instrument", "d"])


def w43_beta(spark, sf_dir):
    r = _returns(spark, sf_dir).filter("r IS NOT NULL")
    both = r.withColumn("m", F.avg("r").over(xs.day()))
    t = w.trailing(60)
    beta = F.when(F.count("r").over(t) == 60, F.try_divide(F.covar_samp("r", "m").over(t), F.var_samp("m").over(t)))
    out = both.withColumn("beta", beta).withColumn("residual", F.col("r") - F.col("beta") * F.col("m"))
    return rounded(out.select("instrument", "d", "beta", "residual"), ["instrument", "d"])


def t29_weight_backtest(spark, sf_dir):
    """The two best scores of each day, weighted by inverse volatility, earn the next bar's return."""
    b = _returns(spark, sf_dir).withColumns({"score": w.scaled_momentum("r", 21), "vol": w.sd("r", 20)}).withColumn("next", F.lead("r").over(w.ordered())).filter("score IS NOT NULL AND vol > 0")
    k = F.row_number().over(xs.day().orderBy(F.desc("score"), "instrument"))
    held = b.withColumn("k", k).filter("k <= 2").withColumn("weight", xs.inverse_vol_weights("vol"))
    return held.groupBy("d").agg(F.round(F.sum(F.col("weight") * F.col("next")), 8).alias("r"), F.count("*").alias("n"))


_TOP = "(PARTITION BY d ORDER BY score DESC, instrument)"
_M21 = f"WITH {BARS}, s AS (SELECT *, c / lag(c, 21) OVER (PARTITION BY instrument ORDER BY d) - 1 AS score FROM day_bars), f AS (SELECT * FROM s WHERE score IS NOT NULL)"
_T21 = "(PARTITION BY instrument ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"
_T20 = "(PARTITION BY instrument ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_T60 = "(PARTITION BY instrument ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_SCORE = f"CASE WHEN count(r) OVER {_T21} = 21 THEN sum(r) OVER {_T21} END / nullif(stddev_samp(r) OVER {_T21} * sqrt(21), 0)"
_VOL = f"CASE WHEN count(r) OVER {_T20} = 20 THEN stddev_samp(r) OVER {_T20} END"
ORACLE_SQL = {
    "a6_return_metrics": f"WITH {_R}, e AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY instrument ORDER BY d)) AS e FROM r WHERE r IS NOT NULL), u AS (SELECT *, e / greatest(max(e) OVER (PARTITION BY instrument ORDER BY d), 1) - 1 AS dd FROM e) SELECT instrument, count(r) AS n, round(exp(sum(ln(1 + r))) - 1, 6) AS total, round(stddev_samp(r) * sqrt(252), 6) AS ann_vol, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(avg(r) / sqrt(avg(power(least(r, 0), 2))) * sqrt(252), 6) AS sortino, round(min(dd), 6) AS max_dd, round(avg(CAST(r > 0 AS DOUBLE)), 6) AS win_rate, round(sum(greatest(r, 0)) / -sum(least(r, 0)), 6) AS profit_factor FROM u GROUP BY 1",
    "a8_by_regime": f"WITH {_T} SELECT regime, {_STATS} FROM t GROUP BY 1",
    "a12_upper_median": f"WITH {_T}, x AS (SELECT regime, d, sum(pnl) AS x FROM t GROUP BY 1, 2) SELECT regime, round(list_sort(list(x))[count(*) // 2 + 1], 4) AS median FROM x GROUP BY 1",
    "a13_brier": f"WITH {_T}, x AS (SELECT confidence * 10 + 0.1 AS p, CAST(pnl > 0 AS DOUBLE) AS won FROM t) SELECT CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.6 THEN 'mid' ELSE 'high' END AS band, count(*) AS n, round(avg(won), 6) AS win_rate, round(avg(p), 6) AS predicted, round(avg(power(p - won, 2)), 6) AS brier FROM x GROUP BY 1",
    "a18_calibration": f"WITH {_T}, x AS (SELECT CAST(least(floor(confidence * 100 / 2), 4) AS BIGINT) AS band, count(*) AS n, avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate FROM t GROUP BY 1 HAVING count(*) >= 3) SELECT band, n, round(win_rate, 6) AS win_rate, round((win_rate * n + 6) / (n + 12), 6) AS shrunk FROM x",
    "a20_exposure": "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS gross, round(sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END), 2) AS net FROM orders GROUP BY 1",
    "a25_attribution": f"WITH {_T}, p AS (SELECT instrument, sum(pnl) AS net FROM t GROUP BY 1) SELECT instrument, round(net, 4) AS net, round(abs(net) / (SELECT sum(abs(net)) FROM p), 9) AS share_abs FROM p",
    "a25_concentration": f"WITH {_T}, p AS (SELECT instrument, sum(pnl) AS net FROM t GROUP BY 1), s AS (SELECT abs(net) / (SELECT sum(abs(net)) FROM p) AS x FROM p) SELECT round(sum(x * x), 9) AS hhi, round(1 / sum(x * x), 6) AS effective_n FROM s",
    "a29_cells": f"WITH {_T} SELECT regime, side, CAST(grouping(regime, side) AS BIGINT) AS level, {_STATS} FROM t GROUP BY CUBE (regime, side)",
    "a30_rolling_sums": f"WITH {_T}, x AS (SELECT instrument, CASE WHEN count(*) OVER w = 20 THEN sum(pnl) OVER w END AS s FROM t WINDOW w AS (PARTITION BY instrument ORDER BY d, l_orderkey, l_linenumber ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT instrument, round(min(s), 4) AS worst, round(quantile_cont(s, 0.05), 2) AS p05, round(quantile_cont(s, 0.5), 2) AS median FROM x GROUP BY 1",
    "a33_month_tails": f"WITH {BARS}, m AS (SELECT instrument, date_trunc('month', d) AS m, max_by(c, d) AS c FROM day_bars GROUP BY 1, 2), x AS (SELECT instrument, c - lag(c) OVER (PARTITION BY instrument ORDER BY m) AS x FROM m) SELECT instrument, count(x) AS n, round(avg(CAST(x > 0 AS DOUBLE)), 6) AS positive, round(min(x), 6) AS worst FROM x GROUP BY 1",
    "a34_by_year": f"WITH {_T} SELECT year(d) AS year, side, {_STATS} FROM t GROUP BY ROLLUP (year(d), side)",
    "a36_daily_losses": f"WITH {_T}, x AS (SELECT side, d, sum(pnl) AS x FROM t GROUP BY 1, 2) SELECT side, round(quantile_cont(x, 0.01), 4) AS p01, round(quantile_cont(x, 0.05), 4) AS p05, round(min(x), 4) AS worst FROM x GROUP BY 1",
    "a46_seasonality": f"WITH {BARS}, m AS (SELECT instrument, year(d) AS y, month(d) AS month, max_by(c, d) / min_by(c, d) - 1 AS r FROM day_bars GROUP BY 1, 2, 3) SELECT instrument, month, count(*) AS years, round(avg(r), 6) AS mean, round(avg(CAST(r > 0 AS DOUBLE)), 6) AS win_rate, round(max(r), 6) AS best, round(min(r), 6) AS worst FROM m GROUP BY 1, 2 HAVING count(*) >= 3",
    "a47_top_market": f"WITH {_T}, n AS (SELECT instrument, count(*) AS n FROM t GROUP BY 1) SELECT instrument, n FROM n ORDER BY n DESC, instrument LIMIT 1",
    "r1_long_short": f"WITH {_R}, s AS (SELECT instrument, d, {_SCORE} AS score FROM r), k AS (SELECT *, count(*) OVER (PARTITION BY d) AS n, (score - avg(score) OVER (PARTITION BY d)) / coalesce(nullif(stddev_samp(score) OVER (PARTITION BY d), 0), 1) AS z, row_number() OVER {_TOP} AS u, row_number() OVER (PARTITION BY d ORDER BY score, instrument) AS dn FROM s WHERE score IS NOT NULL), m AS (SELECT *, greatest(1, CAST(round_even(n * 0.3, 0) AS INT)) AS many FROM k) SELECT instrument, d, round(z, 6) AS z, CASE WHEN u <= many THEN 1 WHEN dn <= least(many, n - many) THEN -1 ELSE 0 END AS side FROM m WHERE n >= 3",
    "r2_top_two": f"{_M21} SELECT instrument, d, k, round(score, 6) AS score FROM (SELECT *, row_number() OVER {_TOP} AS k FROM f) WHERE k <= 2",
    "r7_above_median": f"{_M21} SELECT instrument, d, score > quantile_cont(score, 0.5) OVER (PARTITION BY d) AS above FROM f",
    "r8_average_rank": f"WITH {BARS} SELECT instrument, d, rank() OVER (PARTITION BY d ORDER BY v DESC) + (count(*) OVER (PARTITION BY d, v) - 1) / 2.0 AS rank FROM day_bars",
    "w51_inverse_vol": f"WITH {_R}, x AS (SELECT instrument, d, {_VOL} AS vol FROM r) SELECT instrument, d, round((1 / vol) / sum(1 / vol) OVER (PARTITION BY d), 6) AS weight FROM x WHERE vol IS NOT NULL",
    "w43_beta": f"WITH {_R}, x AS (SELECT *, avg(r) OVER (PARTITION BY d) AS m FROM r WHERE r IS NOT NULL), b AS (SELECT *, CASE WHEN count(r) OVER {_T60} = 60 THEN covar_samp(r, m) OVER {_T60} / nullif(var_samp(m) OVER {_T60}, 0) END AS beta FROM x) SELECT instrument, d, round(beta, 6) AS beta, round(r - beta * m, 6) AS residual FROM b",
    "t29_weight_backtest": f"WITH {_R}, x AS (SELECT instrument, d, lead(r) OVER (PARTITION BY instrument ORDER BY d) AS nxt, {_SCORE} AS score, {_VOL} AS vol FROM r), k AS (SELECT *, row_number() OVER {_TOP} AS k FROM x WHERE score IS NOT NULL AND vol > 0), h AS (SELECT *, (1 / vol) / sum(1 / vol) OVER (PARTITION BY d) AS weight FROM k WHERE k <= 2) SELECT d, round(sum(weight * nxt), 8) AS r, count(*) AS n FROM h GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (a6_return_metrics, a8_by_regime, a12_upper_median, a13_brier, a18_calibration, a20_exposure, a25_attribution, a25_concentration, a29_cells, a30_rolling_sums, a33_month_tails, a34_by_year, a36_daily_losses, a46_seasonality, a47_top_market, r1_long_short, r2_top_two, r7_above_median, r8_average_rank, w51_inverse_vol, w43_beta, t29_weight_backtest)}
