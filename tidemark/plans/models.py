"""Queries of fitted models and of what a book permits: volatility forecasts, hidden regimes, components and clusters, entry permits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.operators import concentration, pairs, permits, regimes, volatility
from tidemark.plans import indicators
from tidemark.plans.bars import DAY_BARS_SQL, day_bars
from tidemark.plans.indicators import ORD, rounded

BARS = f"day_bars AS ({DAY_BARS_SQL})"


# Volatility and regimes --------------------------------------------------------------------------


def w10_ewma_vol(spark, sf_dir):
    """Volatility by exponential weights over the last 503 returns, at each bar."""
    return rounded(volatility.forecasts(day_bars(spark, sf_dir), "ewma"), ["instrument", "d"])


def w12_realized_vol(spark, sf_dir):
    return rounded(volatility.forecasts(day_bars(spark, sf_dir), "realized"), ["instrument", "d"])


def w11_garch(spark, sf_dir):
    """One-step GARCH volatility over 252 returns, fitted anew each month of trading, realised volatility where there is no fit."""
    found = volatility.forecasts(day_bars(spark, sf_dir), "garch", window=252, least=252, every=21, horizon=1, fallback="realized")
    return found.select("instrument", "d", "annualized", "method", "converged", "age")


def w12_garch_forecast(spark, sf_dir):
    """The mean volatility of the next five bars over 503 returns at most, 250 at least, exponential weights where there is no fit."""
    found = volatility.forecasts(day_bars(spark, sf_dir), "garch", every=63)
    return found.select("instrument", "d", "per_bar", "annualized", "horizon", "method", "converged")


def _weighted_sql(seed: str, n: int) -> str:
    """Exponential weights in closed form over a list of returns."""
    weight = f"power({volatility.DECAY}::DOUBLE, len(rs) - i)"
    return f"sqrt(power({volatility.DECAY}::DOUBLE, len(rs)) * {seed} + {1 - volatility.DECAY:.2f}::DOUBLE * list_sum(list_transform(rs, lambda x, i: x * x * {weight})))"


def _forecast_sql(value: str, n: int, name: str) -> str:
    over = f"(PARTITION BY instrument ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""
WITH {BARS}, r AS (
  SELECT instrument, d, ln(c / lag(c) OVER {ORD}) AS r FROM day_bars WHERE c > 0
), l AS (
  SELECT instrument, d, list_filter(list(r) OVER {over}, lambda x: x IS NOT NULL) AS rs, var_samp(r) OVER {over} AS v FROM r
), f AS (
  SELECT instrument, d, CASE WHEN len(rs) > 1 THEN {value} END AS per_bar, len(rs) > 1 AS converged FROM l
)
SELECT instrument, d, round(per_bar, 6) AS per_bar, round(per_bar * sqrt({volatility.ANNUAL}), 6) AS annualized, 1::INTEGER AS horizon, '{name}' AS method, converged FROM f
"""


def w15_hmm_regime(spark, sf_dir):
    """Hidden regimes of the last 756 bars of each instrument; rule-based ones, at four fifths of their confidence, where there are too few bars."""
    rule = indicators.QUERIES["w13_rule_regime"](spark, sf_dir)
    parts = F.split("regime", "/")
    found = regimes.hidden_regimes(day_bars(spark, sf_dir), rule.select("instrument", "d", parts[0].alias("trend"), parts[1].alias("vol"), "confidence"), rounds=40)
    return found.withColumn("confidence", F.round("confidence", 4))


# Concentration -----------------------------------------------------------------------------------

_STREAMS_SQL = "streams AS (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS d, l_extendedprice * (l_discount - l_tax) AS r FROM lineitem)"


def _streams(spark, sf_dir):
    """What each supplier's lines of a day gave away beyond what they were taxed, as a stream of profits and losses."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("d"), (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("r"))


def v17_correlation_matrix(spark, sf_dir):
    return concentration.matrix(_streams(spark, sf_dir), digits=6)


_MATRIX_SQL = f"""
WITH {_STREAMS_SQL}, c AS (
  SELECT instrument, d, sum(r) AS r, count(*) AS n FROM streams GROUP BY ALL
), days AS (
  SELECT DISTINCT d FROM c
), kept AS (
  SELECT instrument FROM c GROUP BY instrument HAVING sum(n) >= 3
), filled AS (
  SELECT instrument, d, coalesce(r, 0) AS r FROM kept CROSS JOIN days LEFT JOIN c USING (instrument, d)
), varied AS (
  SELECT * FROM filled WHERE instrument IN (SELECT instrument FROM filled GROUP BY instrument HAVING min(r) < max(r))
)
SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE ELSE round(c, 6) END AS corr
FROM (SELECT x.instrument AS a, y.instrument AS b, corr(x.r, y.r) AS c FROM varied x JOIN varied y ON x.d = y.d AND x.instrument <= y.instrument GROUP BY 1, 2)
"""


def v17_components(spark, sf_dir):
    """The three largest components of all suppliers' streams."""
    return rounded(concentration.components_of(_streams(spark, sf_dir)), ["component", "instrument"])


def v17_linkage(spark, sf_dir):
    """Clusters whose members all have absolute correlations of at least 0.03."""
    return concentration.clusters_of(_streams(spark, sf_dir), 0.03)


# Permits -----------------------------------------------------------------------------------------

#: Limits in proportion to the tables, whose prices move by their own size in a day.
LIMITS = permits.Limits(kelly=0.25, risk_of_trade=0.01, book_risk=0.02, vol_target=0.10, gross=0.02, correlated=0.008, correlation=0.02, breaker=0.25, reducing=0.15, daily_loss=0.008, slots=6, position=0.003, buckets={"swing": 2, "intraday": 2, "scalp": 1}, sleeves={"trend": 2})
_CANDIDATE = {
    "sleeve": "CASE WHEN o_orderkey % 5 = 0 THEN 'trend' WHEN o_orderkey % 7 = 0 THEN 'other' ELSE '' END",
    "bucket": "CASE o_custkey % 4 WHEN 0 THEN 'swing' WHEN 1 THEN 'intraday' WHEN 2 THEN 'scalp' ELSE 'odd' END",
    "side": "CAST(o_orderkey % 9 AS INT)",
    "p": "0.35e0 + (o_custkey % 40) / 100e0",
    "payoff": "1e0 + (o_orderkey % 4) / 2e0",
    "news": "o_custkey % 17 = 0",
    "tail": "0.9e0 + (o_custkey % 13) / 10e0",
}


def x7_permits(spark, sf_dir):
    """Each order as a candidate of its day, by total price, against what its instrument's bars say and the positions of the day before that are still open."""
    b = day_bars(spark, sf_dir).withColumns({"r": w.log_return(), "_tr": w.true_range()}).withColumns({"stop": 2 * F.avg("_tr").over(w.trailing(14)), "ann_vol": w.sd("r", 21) * F.sqrt(F.lit(252.0)), "_dd": 1 - F.col("c") / F.max("c").over(w.ordered()), "regime": F.when(F.col("c") > F.col("o"), 1.0).otherwise(0.5)})
    account = b.groupBy("d").agg(F.round(0.3 * F.avg("_dd"), 6).alias("drawdown"), F.round(0.02 * F.greatest(F.lit(0.0), F.avg(1 - F.col("c") / F.col("o"))), 6).alias("daily_loss"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("d", F.to_date("o_orderdate"))
    open_ = o.filter("o_orderstatus = 'O'").selectExpr("date_add(d, 1) AS d", "struct(o_orderpriority AS instrument, " + ", ".join(f"{_CANDIDATE[k]} AS {k}" for k in ("sleeve", "bucket")) + ", 1000e0 AS notional, 1500e0 AS risk) AS h")
    positions = open_.groupBy("d").agg(F.collect_list("h").alias("positions"))
    accounts = account.join(positions, "d", "left").select(F.col("d").alias("at"), (1e6 * (1 - F.col("drawdown"))).alias("equity"), "drawdown", "daily_loss", F.when(F.dayofmonth("d") % 10 == 0, 0.8).alias("scalar"), "positions")
    both = pairs.correlations(b.filter("r IS NOT NULL").select("instrument", "d", "r"), None)
    way = both.select("a", F.col("b").alias("_b"), "corr").union(both.select("b", "a", "corr"))
    corr = way.groupBy(F.col("a").alias("instrument")).agg(F.map_from_entries(F.collect_list(F.struct("_b", F.round("corr", 6)))).alias("corr"))
    asked = o.selectExpr("o_orderkey AS id", "o_totalprice AS score", "o_orderpriority AS instrument", "d", *[f"{x} AS {k}" for k, x in _CANDIDATE.items()])
    candidates = asked.join(b.select("instrument", "d", F.col("c").alias("price"), "stop", "ann_vol", "regime"), ["instrument", "d"]).join(corr, "instrument", "left").withColumn("rate", F.lit(1.0)).withColumnRenamed("d", "at")
    found = permits.permits(candidates, accounts, LIMITS)
    return found.select("id", "permitted", "reason", F.round("risk", 8).alias("risk"), F.round("notional", 4).alias("notional"), "caps")


def _permit_sql(x: permits.Limits) -> str:
    bucket_limit = " ".join(f"WHEN '{k}' THEN {v}" for k, v in x.buckets.items())
    sleeve_limit = " ".join(f"WHEN '{k}' THEN {v}" for k, v in x.sleeves.items())
    over = "(PARTITION BY instrument ORDER BY d ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    return f"""
WITH RECURSIVE {BARS}, b0 AS (
  SELECT *, ln(c / lag(c) OVER {ORD}) AS r, coalesce(lag(c) OVER {ORD}, c) AS pc, 1 - c / max(c) OVER {ORD} AS dd FROM day_bars
), b AS (
  SELECT instrument, d, c, o, r, dd, 2 * avg(greatest(h - l, abs(h - pc), abs(l - pc))) OVER {over.format(13)} AS stop,
         CASE WHEN count(r) OVER {over.format(20)} = 21 THEN stddev_samp(r) OVER {over.format(20)} * sqrt(252) END AS ann_vol, CASE WHEN c > o THEN 1.0 ELSE 0.5 END AS regime FROM b0
), account AS (
  SELECT d, round(0.3 * avg(dd), 6) AS drawdown, round(0.02 * greatest(0, avg(1 - c / o)), 6) AS daily_loss FROM b GROUP BY d
), ord AS (
  SELECT o_orderkey AS id, o_totalprice AS score, o_orderpriority AS instrument, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS d, {", ".join(f"{e} AS {k}" for k, e in _CANDIDATE.items())} FROM orders
), held AS (
  SELECT d + 1 AS d, list({{'instrument': instrument, 'sleeve': sleeve, 'bucket': bucket, 'notional': 1000::DOUBLE, 'risk': 1500::DOUBLE}}) AS held FROM ord WHERE status = 'O' GROUP BY ALL
), two AS (
  SELECT p.instrument AS a, q.instrument AS b, round(corr(p.r, q.r), 6) AS corr FROM b p JOIN b q ON p.d = q.d AND p.instrument <> q.instrument WHERE p.r IS NOT NULL AND q.r IS NOT NULL GROUP BY ALL
), near AS (
  SELECT a AS instrument, list(b) FILTER (abs(corr) >= {x.correlation}) AS near FROM two GROUP BY a
), c0 AS MATERIALIZED (
  SELECT o.*, b.c AS price, b.stop, ann_vol, regime, 1000000 * (1 - drawdown) AS equity, drawdown, daily_loss, CASE WHEN day(o.d) % 10 = 0 THEN 0.8 ELSE 1.0 END AS scalar, coalesce(near, []) AS near,
         least({x.tail[1]}, greatest({x.tail[0]}, tail)) AS t, {x.kelly} * (p - (1 - p) / payoff) AS kelly,
         CASE WHEN drawdown >= {x.reducing} THEN ({x.breaker} - drawdown) / ({x.breaker} - {x.reducing}) ELSE 1.0 END AS ramp,
         row_number() OVER (PARTITION BY o.d ORDER BY score DESC, id) AS k
  FROM ord o JOIN b USING (instrument, d) JOIN account USING (d) LEFT JOIN near USING (instrument)
), cand AS MATERIALIZED (
  SELECT *, least(kelly, {x.risk_of_trade}) * ramp * scalar * regime AS asked, CASE WHEN ann_vol > 0 THEN equity * {x.vol_target} / (ann_vol * t) ELSE 0 END AS at_vol,
         CASE WHEN side = 0 THEN 'flat_signal' WHEN daily_loss >= {x.daily_loss} THEN 'daily_loss_stop' WHEN drawdown >= {x.breaker} THEN 'drawdown_breaker' WHEN news THEN 'news_veto' END AS early,
         CASE WHEN NOT coalesce(stop > 0 AND price > 0, FALSE) THEN 'invalid_stop' WHEN NOT kelly > 0 THEN 'no_edge' WHEN ramp <= 0 THEN 'drawdown_reducing_zero' END AS late
  FROM c0
), walk AS (
  SELECT d, 0::BIGINT AS k, NULL::BIGINT AS id, coalesce(held, []) AS held, NULL::VARCHAR AS reason, 0::DOUBLE AS notional, 0::DOUBLE AS risk, '' AS caps FROM (SELECT DISTINCT d FROM cand) LEFT JOIN held USING (d)
  UNION ALL
  SELECT d, k, id, CASE WHEN reason IS NULL THEN list_append(held, {{'instrument': instrument, 'sleeve': sleeve, 'bucket': bucket, 'notional': n4, 'risk': n4 / price * stop}}) ELSE held END, reason,
         CASE WHEN reason IS NULL THEN n4 ELSE 0 END, CASE WHEN reason IS NULL THEN n4 / price * stop / equity ELSE 0 END, CASE WHEN reason IS NULL THEN named ELSE '' END
  FROM (
    SELECT *, coalesce(early, slots, late, CASE WHEN risk_room <= 0 THEN 'book_risk_full' WHEN NOT n4 > {x.least} THEN 'below_least' END) AS reason,
           concat_ws(',', CASE WHEN kelly > {x.risk_of_trade} THEN 'risk_of_trade' END, CASE WHEN asked > risk_room THEN 'book_risk' END, CASE WHEN at_vol < n0 THEN 'vol_target' END, CASE WHEN gross_room < n1 THEN 'gross_exposure' END, CASE WHEN near_room < n2 THEN 'correlated_exposure' END, CASE WHEN {x.position} * equity < n3 THEN 'position_size' END) AS named
    FROM (
      SELECT *, least(n3, {x.position} * equity) AS n4 FROM (SELECT *, least(n2, near_room) AS n3 FROM (SELECT *, least(n1, gross_room) AS n2 FROM (SELECT *, least(n0, at_vol) AS n1 FROM (
        SELECT *, equity * least(asked, risk_room) / (stop * t) * price AS n0 FROM (
          SELECT c.*, w.held,
            CASE WHEN (CASE c.sleeve {sleeve_limit} END) IS NOT NULL THEN CASE WHEN len(list_filter(w.held, lambda h: h.sleeve = c.sleeve)) >= (CASE c.sleeve {sleeve_limit} END) THEN 'sleeve_full' WHEN len(w.held) >= {x.slots} THEN 'all_slots_full' END
                 WHEN len(list_filter(w.held, lambda h: h.sleeve = '' AND h.bucket = c.bucket)) >= (CASE c.bucket {bucket_limit} ELSE {x.other_bucket} END) THEN 'bucket_full'
                 WHEN len(w.held) >= {x.slots} THEN 'all_slots_full' END AS slots,
            {x.book_risk} - coalesce(list_sum(list_transform(w.held, lambda h: h.risk)), 0) / c.equity AS risk_room,
            greatest(0, {x.gross} * c.equity - coalesce(list_sum(list_transform(w.held, lambda h: h.notional)), 0)) AS gross_room,
            greatest(0, {x.correlated} * c.equity - coalesce(list_sum(list_transform(list_filter(w.held, lambda h: h.instrument = c.instrument OR list_contains(c.near, h.instrument)), lambda h: h.notional)), 0)) AS near_room
          FROM walk w JOIN cand c ON c.d = w.d AND c.k = w.k + 1
        )))))
    )
  )
)
SELECT id, reason IS NULL AS permitted, reason, round(risk, 8) AS risk, round(notional, 4) AS notional, caps FROM walk WHERE k > 0
"""


QUERIES = {f.__name__: f for f in (w10_ewma_vol, w11_garch, w12_realized_vol, w12_garch_forecast, w15_hmm_regime, v17_correlation_matrix, v17_components, v17_linkage, x7_permits)}
ORACLE_SQL = {
    "w10_ewma_vol": _forecast_sql(_weighted_sql("v", 503), 503, "ewma"),
    "w12_realized_vol": _forecast_sql("sqrt(v)", 21, "realized_21"),
    "v17_correlation_matrix": _MATRIX_SQL,
    "x7_permits": _permit_sql(LIMITS),
}
