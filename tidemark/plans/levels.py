"""Queries of sessions by class, of swings and their extensions, of residual momentum, and of every two instruments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendars, desk as dk, windows as w
from tidemark.operators import pairs
from tidemark.plans import desk
from tidemark.plans.bars import DAY_BARS_SQL, day_bars
from tidemark.plans.indicators import ORD, rounded
from tidemark.plans.series import _normal_sql

BARS = f"day_bars AS ({DAY_BARS_SQL})"

# Sessions ----------------------------------------------------------------------------------------

_HOURS = "ts + make_interval(0, 0, 0, 0, CAST(w % 24 AS INT), 0, 0)"
_FRAME = desk.pick("w", ["1h", "1d", "1w", "15m"])


def _opens(spark, sf_dir):
    """Setups as bars that open at some hour of their day, with their class and time frame."""
    return desk.setups(spark, sf_dir).select("id", F.expr(_HOURS).alias("t"), dk.asset_class(F.col("symbol")).alias("class"), F.expr(_FRAME).alias("frame"))


def p7_sessions_by_class(spark, sf_dir):
    s = _opens(spark, sf_dir)
    return s.select("id", calendars.session_date(F.col("t"), F.col("class"), F.col("frame")).alias("session"))


def p8_off_calendar_by_class(spark, sf_dir):
    s = _opens(spark, sf_dir)
    return s.groupBy("class", "frame").agg(F.count_if(calendars.off_calendar(F.col("t"), F.col("class"), F.col("frame"))).alias("off"), F.count("*").alias("n"))


_CLASS_SQL = "CASE symbol WHEN 'EUR/USD' THEN 'forex' WHEN 'BTC/USD' THEN 'crypto' WHEN 'XAU/USD' THEN 'forex' WHEN 'USD/JPY' THEN 'forex' WHEN 'ETH-USD' THEN 'crypto' WHEN 'BINANCE_BTC_USD' THEN 'crypto' WHEN 'EUR_GBP' THEN 'forex' ELSE 'equity' END"
_OPENS_SQL = f"""WITH b AS (SELECT {", ".join(f"{x} AS {k}" for k, x in desk._BASE.items())} FROM orders), s AS (SELECT *, {", ".join(f"{x} AS {k}" for k, x in desk._SETUP.items())} FROM b),
o AS (SELECT id, ts + to_hours(CAST(w % 24 AS INT)) AS t, {_CLASS_SQL} AS class, {_FRAME} AS frame FROM s)"""


# Swings ------------------------------------------------------------------------------------------

_EXTENSIONS = {"e1272": 0.272, "e1618": 0.618, "e2000": 1.0, "e2618": 1.618}


def w33_extensions(spark, sf_dir):
    """Targets beyond the swing of the last 60 bars, 20 at least: below the low where the high came last, above the high otherwise."""
    last = w.trailing(60)
    b = day_bars(spark, sf_dir).withColumns({"hi": F.max("h").over(last), "lo": F.min("l").over(last), "n": F.count("*").over(last), "bars": F.collect_list(F.struct("d", "h", "l")).over(last)})
    first = lambda x, of: F.array_min(F.transform(F.filter("bars", lambda s: s[x] == F.col(of)), lambda s: s["d"]))
    b = b.filter((F.col("n") >= 20) & (F.col("hi") > F.col("lo"))).withColumn("down", first("l", "lo") < first("h", "hi"))
    span = F.col("hi") - F.col("lo")
    levels = {k: F.round(F.when(F.col("down"), F.col("lo") - span * x).otherwise(F.col("hi") + span * x), 4) for k, x in _EXTENSIONS.items()}
    return b.select("instrument", "d", F.when(F.col("down"), "downside").otherwise("upside").alias("direction"), F.when(F.col("down"), F.col("lo")).otherwise(F.col("hi")).alias("swing"), *[v.alias(k) for k, v in levels.items()])


_EXTENSIONS_SQL = f"""
WITH {BARS}, x AS (SELECT instrument, d, max(h) OVER q AS hi, min(l) OVER q AS lo, count(*) OVER q AS n, list({{'d': d, 'h': h, 'l': l}}) OVER q AS bars FROM day_bars WINDOW q AS (PARTITION BY instrument ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, list_min(list_transform(list_filter(bars, lambda s: s.l = lo), lambda s: s.d)) < list_min(list_transform(list_filter(bars, lambda s: s.h = hi), lambda s: s.d)) AS down FROM x WHERE n >= 20 AND hi > lo)
SELECT instrument, d, CASE WHEN down THEN 'downside' ELSE 'upside' END AS direction, CASE WHEN down THEN lo ELSE hi END AS swing, {", ".join(f"round(CASE WHEN down THEN lo - (hi - lo) * {x}::DOUBLE ELSE hi + (hi - lo) * {x}::DOUBLE END, 4) AS {k}" for k, x in _EXTENSIONS.items())} FROM y
"""


# Residual momentum -------------------------------------------------------------------------------


def w43_residual_score(spark, sf_dir):
    """What 120 returns up to 21 bars ago leave beyond their beta (60 bars) to the mean of all instruments, by its own volatility."""
    r = day_bars(spark, sf_dir).withColumn("r", w.log_return()).filter("r IS NOT NULL").select("instrument", "d", "r")
    m = r.join(r.groupBy("d").agg(F.avg("r").alias("m")), "d")
    n = F.count("*").over(w.trailing(60))
    beta = F.when(n == 60, F.try_divide(F.covar_samp("r", "m").over(w.trailing(60)), F.nullif(F.var_samp("m").over(w.trailing(60)), F.lit(0.0))))
    e = m.withColumn("beta", beta).withColumn("residual", F.col("r") - F.col("beta") * F.col("m")).withColumn("_late", F.lag("residual", 21).over(w.ordered()))
    e = e.withColumns({"cumulative": w.full(F.sum("_late").over(w.trailing(120)), F.col("_late"), 120), "vol": w.sd("_late", 120) * F.sqrt(F.lit(252.0))})
    return rounded(e.select("instrument", "d", "beta", "residual", "cumulative", "vol", F.when(F.col("vol") > 0, F.col("cumulative") / F.col("vol")).alias("score")), ["instrument", "d"])


def _last(n: int) -> str:
    return f"(PARTITION BY instrument ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_RESIDUAL_SQL = f"""
WITH {BARS}, r AS (SELECT * FROM (SELECT instrument, d, ln(c / lag(c) OVER {ORD}) AS r FROM day_bars) WHERE r IS NOT NULL), m AS (SELECT instrument, d, r, avg(r) OVER (PARTITION BY d) AS m FROM r),
b AS (SELECT *, CASE WHEN count(*) OVER {_last(60)} = 60 THEN covar_samp(r, m) OVER {_last(60)} / nullif(var_samp(m) OVER {_last(60)}, 0) END AS beta FROM m), e AS (SELECT *, r - beta * m AS residual FROM b), f AS (SELECT *, lag(residual, 21) OVER {ORD} AS late FROM e),
g AS (SELECT *, CASE WHEN count(late) OVER {_last(120)} = 120 THEN sum(late) OVER {_last(120)} END AS cumulative, CASE WHEN count(late) OVER {_last(120)} = 120 THEN stddev_samp(late) OVER {_last(120)} END * sqrt(252) AS vol FROM f)
SELECT instrument, d, round(beta, 6) AS beta, round(residual, 6) AS residual, round(cumulative, 6) AS cumulative, round(vol, 6) AS vol, round(CASE WHEN vol > 0 THEN cumulative / vol END, 6) AS score FROM g
"""


# Every two instruments ---------------------------------------------------------------------------


def _returns(spark, sf_dir):
    return day_bars(spark, sf_dir).withColumn("r", w.log_return()).select("instrument", "d", "r")


def j10_every_pair(spark, sf_dir):
    """Returns of every two instruments on the days that both have."""
    return rounded(pairs.aligned(_returns(spark, sf_dir)), ["a", "b", "d"])


def v9_every_pair(spark, sf_dir):
    """Diebold-Mariano of every two instruments over five steps."""
    return rounded(pairs.diebold_mariano_pairs(pairs.aligned(_returns(spark, sf_dir)), 5), ["a", "b"])


_PAIRS_SQL = f"WITH {BARS}, r AS (SELECT * FROM (SELECT instrument, d, ln(c / lag(c) OVER {ORD}) AS r FROM day_bars) WHERE r IS NOT NULL), p AS (SELECT a.instrument AS a, b.instrument AS b, a.d, a.r AS x, b.r AS y FROM r a JOIN r b ON a.d = b.d AND a.instrument < b.instrument)"
_DM_SQL = f"""{_PAIRS_SQL}, l AS (SELECT a, b, d, y * y - x * x AS d0, avg(y * y - x * x) OVER (PARTITION BY a, b) AS m, count(*) OVER (PARTITION BY a, b)::DOUBLE AS n FROM p), e AS (SELECT *, d0 - m AS e FROM l),
g AS (SELECT a, b, m, n, e, {", ".join(f"lag(e, {k}) OVER (PARTITION BY a, b ORDER BY d) AS l{k}" for k in range(1, 5))} FROM e),
v AS (SELECT a, b, m, n, avg(e * e) + 2 * ({" + ".join(f"{1 - k / 5}::DOUBLE * coalesce(avg(e * l{k}), 0)" for k in range(1, 5))}) AS v FROM g GROUP BY ALL),
s AS (SELECT a, b, n, CASE WHEN v > 0 THEN m / sqrt(v / n) ELSE 0 END * sqrt(greatest(0, (n + 1 - 10 + 20 / n) / n)) AS dm FROM v)
SELECT a, b, n, round(dm, 6) AS dm, round(1 - ({_normal_sql("dm")}), 6) AS p FROM s"""

QUERIES = {f.__name__: f for f in (p7_sessions_by_class, p8_off_calendar_by_class, w33_extensions, w43_residual_score, j10_every_pair, v9_every_pair)}
ORACLE_SQL = {
    "p7_sessions_by_class": f"{_OPENS_SQL} SELECT id, CASE WHEN frame IN ('1d', '1w') THEN CAST(CASE WHEN class = 'forex' THEN CAST(t AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) + 1 ELSE CAST(t AS DATE) END AS TIMESTAMP) ELSE t END AS session FROM o",
    "p8_off_calendar_by_class": f"{_OPENS_SQL} SELECT class, frame, count(*) FILTER (CASE class WHEN 'crypto' THEN FALSE WHEN 'forex' THEN CASE frame WHEN '1w' THEN isodow(t) <> 1 WHEN '1d' THEN isodow(t) > 5 ELSE isodow(t) = 6 OR (isodow(t) = 7 AND hour(t) < 21) OR (isodow(t) = 5 AND hour(t) >= 22) END ELSE isodow(t) > 5 END) AS off, count(*) AS n FROM o GROUP BY ALL",
    "w33_extensions": _EXTENSIONS_SQL,
    "w43_residual_score": _RESIDUAL_SQL,
    "j10_every_pair": f"{_PAIRS_SQL} SELECT a, b, d, round(x, 6) AS x, round(y, 6) AS y FROM p",
    "v9_every_pair": _DM_SQL,
}
