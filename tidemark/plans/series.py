"""Queries of several series together: alignment on one time line, calendars, contexts, strengths, tests of two series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendars, desk as dk, windows as w
from tidemark.operators import alignment, pairs
from tidemark.plans.bars import day_bars
from tidemark.plans.desk import inverse_normal_sql
from tidemark.plans.indicators import ORD, _mean, rounded
from tidemark.plans.joins import BARS

# The instruments of the tables, read as pairs of currencies.
PAIRS = (("1-URGENT", "EUR", "USD"), ("2-HIGH", "USD", "JPY"), ("3-MEDIUM", "EUR", "JPY"), ("4-NOT SPECIFIED", "GBP", "USD"), ("5-LOW", "EUR", "GBP"))
RATES = (("EUR", 0.02), ("USD", 0.05), ("JPY", 0.001), ("GBP", 0.0475))
_PAIRS_SQL = f"pairs(instrument, base, quote) AS (VALUES {', '.join(str(p) for p in PAIRS)})"
_RATES_SQL = f"rates(ccy, rate) AS (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {r}::DOUBLE)' for c, r in RATES)})"


def _pairs(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(PAIRS), "instrument string, base string, quote string"))


def j1_union_timeline(spark, sf_dir):
    """Every instrument on every day that any has, null where it has no bar."""
    b = day_bars(spark, sf_dir).select("instrument", "d", "c")
    return b.select("d").distinct().crossJoin(b.select("instrument").distinct()).join(b, ["instrument", "d"], "left")


def _ticks(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("event"), F.col("o_orderpriority").alias("instrument"), F.date_sub(F.to_date("o_orderdate"), 9).alias("d"))


def j4_clipped_asof(spark, sf_dir):
    """The last close at or before, of what lies before all bars the first."""
    b = day_bars(spark, sf_dir).select("instrument", "d", F.col("c").alias("close"))
    first = b.groupBy("instrument").agg(F.min_by("close", "d").alias("_first"))
    found = alignment.asof(_ticks(spark, sf_dir), b, "instrument", "d", ["close"]).join(F.broadcast(first), "instrument")
    return found.select("event", F.coalesce("close", "_first").alias("close"))


def j6_asof_scalar(spark, sf_dir):
    """Each series at the end of each quarter."""
    b = day_bars(spark, sf_dir)
    ends = b.select(F.last_day(F.add_months(F.trunc("d", "QUARTER"), 2)).alias("d")).distinct().crossJoin(b.select("instrument").distinct())
    return alignment.asof(ends, b.select("instrument", "d", "c"), "instrument", "d", ["c"])


def j7_publication_lag(spark, sf_dir):
    """A week's last close, known only three business days later, at each day."""
    b = day_bars(spark, sf_dir)
    weekly = b.groupBy("instrument", F.date_trunc("week", "d").cast("date").alias("week")).agg(F.max_by("c", "d").alias("value"), F.max("d").alias("seen"))
    known = weekly.select("instrument", calendars.business_days_after(F.col("seen"), 3).alias("d"), "value")
    return alignment.asof(b.select("instrument", "d"), known, "instrument", "d", ["value"])


def j8_weekly_context(spark, sf_dir):
    """A day's bar with the close and the mean of four of the weeks that begin at or before it."""
    b = day_bars(spark, sf_dir)
    weekly = b.groupBy("instrument", F.date_trunc("week", "d").cast("date").alias("d")).agg(F.max_by("c", "d").alias("c")).withColumn("ma", w.mean("c", 4))
    context = weekly.select("instrument", "d", F.col("c").alias("week_close"), F.col("ma").alias("week_mean"))
    return rounded(alignment.asof(b.select("instrument", "d"), context, "instrument", "d", ["week_close", "week_mean"]), ["instrument", "d"])


def p10_bar_close(spark, sf_dir):
    """When a day's bar is complete, in UTC: 17:00 in New York for pairs, the next midnight for others."""
    return day_bars(spark, sf_dir).select("instrument", "d", calendars.day_close(F.col("d"), F.col("instrument") < "3").alias("closed"))


def p11_forming_tail(spark, sf_dir):
    """Bars that are complete at noon of 1998-07-01."""
    b = day_bars(spark, sf_dir)
    return b.filter(calendars.day_close(F.col("d"), F.col("instrument") < "3") <= F.lit("1998-07-01 12:00:00").cast("timestamp_ntz")).groupBy("instrument").agg(F.max("d").alias("last"), F.count("*").alias("n"))


def p13_day_migration(spark, sf_dir):
    """One bar of each instrument and day, the last that came."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("instrument"), F.to_date("o_orderdate").alias("d"), "o_orderkey", "o_totalprice")
    return o.groupBy("instrument", "d").agg(F.max_by("o_totalprice", "o_orderkey").alias("price"), (F.count("*") - 1).alias("dropped"))


def p14_point_in_time(spark, sf_dir):
    """What is known at a time, with it and without it."""
    at = F.lit("1997-03-14").cast("date")
    return day_bars(spark, sf_dir).filter(F.col("d") <= at).groupBy("instrument").agg(F.count("*").alias("upto"), F.count_if(F.col("d") < at).alias("before"))


def p3_class_gaps(spark, sf_dir):
    """Holes of more than one expected bar, on calendar days for coins (here 5-LOW), on business days for others."""
    b = day_bars(spark, sf_dir).select("instrument", "d", F.lag("d").over(w.ordered()).alias("p")).filter("p IS NOT NULL")
    missing = F.when(F.col("instrument") == "5-LOW", F.datediff("d", "p") - 1).otherwise(calendars.business_days_between(F.col("p"), F.col("d")))
    return b.select("instrument", F.col("p").alias("after"), F.col("d").alias("before"), missing.cast("bigint").alias("missing")).filter("missing > 1")


def g3_carry_veto(spark, sf_dir):
    """Momentum signals, flat where the direction earns a negative carry."""
    rates = spark.createDataFrame(list(RATES), "ccy string, rate double")
    carry = _pairs(spark).join(rates.select(F.col("ccy").alias("base"), F.col("rate").alias("b")), "base").join(rates.select(F.col("ccy").alias("quote"), F.col("rate").alias("q")), "quote").select("instrument", (F.col("b") - F.col("q")).alias("carry"))
    b = day_bars(spark, sf_dir).withColumn("side", F.signum(w.simple_return(n=21)).cast("int")).join(F.broadcast(carry), "instrument")
    return b.select("instrument", "d", F.when(F.col("side") * F.col("carry") < 0, 0).otherwise(F.col("side")).alias("signal"))


def g5_currency_momentum(spark, sf_dir):
    """Strength of each currency as the mean score of its pairs, signed by the leg; the pair of the strongest with the weakest is traded."""
    b = day_bars(spark, sf_dir).withColumn("score", w.simple_return(n=21)).filter("score IS NOT NULL").join(_pairs(spark), "instrument")
    strengths = b.select("d", F.explode(F.array(F.struct(F.col("base").alias("ccy"), F.col("score").alias("x")), F.struct(F.col("quote").alias("ccy"), (-F.col("score")).alias("x")))).alias("s")).groupBy("d", "s.ccy").agg(F.avg("s.x").alias("x"))
    day = Window.partitionBy("d")
    placed = strengths.withColumns({"top": F.row_number().over(day.orderBy(F.desc("x"), "ccy")), "low": F.row_number().over(day.orderBy("x", "ccy")), "many": F.count("*").over(day), "z": F.try_divide(F.col("x") - F.avg("x").over(day), F.stddev_samp("x").over(day))}).filter("many >= 3")
    legs = [placed.select("d", *[F.col(c).alias(f"{c}_{k}") for c in ("ccy", "top", "low", "z")]) for k in ("b", "q")]
    both = b.select("instrument", "d", F.col("base").alias("ccy_b"), F.col("quote").alias("ccy_q")).join(legs[0], ["d", "ccy_b"]).join(legs[1], ["d", "ccy_q"])
    side = F.when((F.col("top_b") == 1) & (F.col("low_q") == 1), 1).when((F.col("low_b") == 1) & (F.col("top_q") == 1), -1)
    return rounded(both.withColumn("side", side).filter("side IS NOT NULL").select("instrument", "d", "side", (F.col("z_b") - F.col("z_q")).alias("z")), ["instrument", "d"])


def g18_spillover(spark, sf_dir):
    """Momentum of an instrument only in the direction of the benchmark's trend, as last known."""
    b = day_bars(spark, sf_dir).withColumn("r21", w.simple_return(n=21))
    mark = b.filter("instrument = '1-URGENT'").select(F.lit(1).alias("_k"), "d", (F.col("r21") > 0).alias("on"))
    first = mark.agg(F.min_by("on", "d").alias("_first"))
    asked = b.filter("instrument <> '1-URGENT'").select("instrument", "d", F.signum("r21").cast("int").alias("side"), F.lit(1).alias("_k"))
    days = asked.select("_k", "d").distinct()
    state = alignment.asof(days, mark, "_k", "d", ["on"]).crossJoin(F.broadcast(first)).select("d", F.coalesce("on", "_first", F.lit(False)).alias("on"))
    veto = (F.col("side") == 1) & ~F.col("on") | (F.col("side") == -1) & F.col("on")
    return asked.join(state, "d").select("instrument", "d", F.when(veto, 0).otherwise(F.col("side")).alias("signal"))


def w52_correlations(spark, sf_dir):
    """Correlation of every two instruments over their last 63 common days."""
    r = day_bars(spark, sf_dir).withColumn("r", w.simple_return()).filter("r IS NOT NULL").select("instrument", "d", "r")
    return rounded(pairs.correlations(r, 63), ["a", "b"])


def v17_clusters(spark, sf_dir):
    """Instruments and how many others go with each at a correlation of 0.05, over all days."""
    r = day_bars(spark, sf_dir).withColumn("r", w.simple_return()).filter("r IS NOT NULL").select("instrument", "d", "r")
    return pairs.neighbours(pairs.correlations(r, None), 0.05)


def v18_heat_list(spark, sf_dir):
    """Pairs with at least fifteen common days, the strongest first."""
    r = day_bars(spark, sf_dir).withColumn("r", w.simple_return()).filter("r IS NOT NULL").select("instrument", "d", "r")
    return rounded(pairs.correlations(r, None).filter("n >= 15").withColumn("strength", F.abs("corr")).orderBy(F.desc("strength"), "a", "b").limit(6), ["a", "b"])


def _two(spark, sf_dir) -> DataFrame:
    r = day_bars(spark, sf_dir).withColumn("r", w.simple_return()).filter("r IS NOT NULL AND r < 5")
    return r.groupBy("d").agg(F.max(F.when(F.col("instrument") == "1-URGENT", F.col("r"))).alias("a"), F.max(F.when(F.col("instrument") == "2-HIGH", F.col("r"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")


def v9_diebold_mariano(spark, sf_dir):
    return rounded(pairs.diebold_mariano(_two(spark, sf_dir)), [])


def v3_deflated_sharpe(spark, sf_dir):
    """Of each instrument's returns: how sure its Sharpe ratio is above the best that so many trials lead to expect."""
    r = day_bars(spark, sf_dir).withColumn("r", w.log_return()).filter("r IS NOT NULL")
    return rounded(pairs.deflated_sharpe(r, "instrument", 40.0), ["instrument"])


def v19_trials_panel(spark, sf_dir):
    """All instruments as trials: how many, the best Sharpe ratio, and what the best would be without skill."""
    r = day_bars(spark, sf_dir).withColumn("r", w.log_return()).filter("r IS NOT NULL")
    each = r.groupBy("instrument").agg((F.avg("r") / F.stddev_samp("r")).alias("s"))
    panel = each.agg(F.count("*").cast("double").alias("n"), F.max("s").alias("best"), F.stddev_samp("s").alias("sd"))
    return rounded(panel.select("n", "best", dk.expected_best(F.col("sd"), F.col("n")).alias("expected")).withColumn("beats", F.col("best") > F.col("expected")), [])


def v10_trial_ledger(spark, sf_dir):
    """Configurations that were tried: rows and different ones, by a key that doesn't depend on the order of names."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    config = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))).otherwise(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")))
    return p.groupBy("p_type").agg(F.count("*").alias("rows"), F.count_distinct(dk.config_key(config)).alias("trials"))


def z12_proximity(spark, sf_dir):
    """Bars that enter a zone around the close of five bars before, from outside."""
    b = day_bars(spark, sf_dir).withColumn("level", F.lag("c", 5).over(w.ordered()))
    inside = (F.col("l") <= F.col("level") * 1.01) & (F.col("h") >= F.col("level") * 0.99)
    return b.withColumn("inside", inside).withColumn("was", F.lag("inside").over(w.ordered())).filter("inside AND NOT was").select("instrument", "d")


_BO = f"WITH {BARS}"
_SHIFT = "CASE isodow({d}) WHEN 3 THEN 5 WHEN 4 THEN 5 WHEN 5 THEN 5 WHEN 6 THEN 4 ELSE 3 END"
_CLOSED = "CASE WHEN instrument < '3' THEN timezone('UTC', timezone('America/New_York', CAST(d AS TIMESTAMP) + INTERVAL 17 HOUR)) ELSE CAST(d + 1 AS TIMESTAMP) END"
_RET = f"r AS (SELECT instrument, d, c / lag(c) OVER {ORD} - 1 AS r FROM day_bars)"
_WD = "((date_diff('day', DATE '1900-01-01', {x}) // 7) * 5 + least(date_diff('day', DATE '1900-01-01', {x}) % 7, 5))"


def _corr_sql(last: int | None) -> str:
    limit = f" WHERE i <= {last}" if last else ""
    return f"pr AS (SELECT x.instrument AS a, y.instrument AS b, x.r AS u, y.r AS v, row_number() OVER (PARTITION BY x.instrument, y.instrument ORDER BY x.d DESC) AS i FROM r x JOIN r y ON x.d = y.d AND x.instrument < y.instrument AND x.r IS NOT NULL AND y.r IS NOT NULL), cr AS (SELECT a, b, corr(u, v) AS corr, count(*) AS n FROM pr{limit} GROUP BY 1, 2)"


def _normal_sql(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"exp(-{x} * {x} / 2) / 2.5066282746310002 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


_DM = "sqrt((n - 1) / n) * m / sqrt(v / n)"
ORACLE_SQL = {
    "j1_union_timeline": f"{_BO} SELECT i.instrument, t.d, b.c FROM (SELECT DISTINCT d FROM day_bars) t CROSS JOIN (SELECT DISTINCT instrument FROM day_bars) i LEFT JOIN day_bars b ON b.instrument = i.instrument AND b.d = t.d",
    "j4_clipped_asof": f"{_BO}, e AS (SELECT o_orderkey AS event, o_orderpriority AS instrument, CAST(o_orderdate AS DATE) - 9 AS d FROM orders), f AS (SELECT instrument, min_by(c, d) AS c FROM day_bars GROUP BY 1) SELECT event, coalesce(b.c, f.c) AS close FROM e ASOF LEFT JOIN day_bars b ON e.instrument = b.instrument AND e.d >= b.d JOIN f ON f.instrument = e.instrument",
    "j6_asof_scalar": f"{_BO}, q AS (SELECT DISTINCT CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS d FROM day_bars), e AS (SELECT * FROM q CROSS JOIN (SELECT DISTINCT instrument FROM day_bars)) SELECT e.instrument, e.d, b.c FROM e ASOF LEFT JOIN day_bars b ON e.instrument = b.instrument AND e.d >= b.d",
    "j7_publication_lag": f"{_BO}, k AS (SELECT instrument, max_by(c, d) AS value, max(d) AS seen FROM day_bars GROUP BY instrument, date_trunc('week', d)), p AS (SELECT instrument, seen + {_SHIFT.format(d='seen')} AS d, value FROM k), s AS (SELECT instrument, d, max(value) AS value FROM p GROUP BY 1, 2) SELECT b.instrument, b.d, s.value FROM day_bars b ASOF LEFT JOIN s ON b.instrument = s.instrument AND b.d >= s.d",
    "j8_weekly_context": f"{_BO}, k AS (SELECT instrument, CAST(date_trunc('week', d) AS DATE) AS d, max_by(c, d) AS c FROM day_bars GROUP BY 1, 2), m AS (SELECT *, {_mean('c', 4)} AS ma FROM k) SELECT b.instrument, b.d, round(m.c, 6) AS week_close, round(m.ma, 6) AS week_mean FROM day_bars b ASOF LEFT JOIN m ON b.instrument = m.instrument AND b.d >= m.d",
    "p10_bar_close": f"{_BO} SELECT instrument, d, {_CLOSED} AS closed FROM day_bars",
    "p11_forming_tail": f"{_BO} SELECT instrument, max(d) AS last, count(*) AS n FROM day_bars WHERE {_CLOSED} <= TIMESTAMP '1998-07-01 12:00:00' GROUP BY 1",
    "p13_day_migration": "SELECT instrument, d, price, n - 1 AS dropped FROM (SELECT o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS d, o_totalprice AS price, row_number() OVER k AS i, count(*) OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE)) AS n FROM orders WINDOW k AS (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC)) WHERE i = 1",
    "p14_point_in_time": f"{_BO} SELECT instrument, count(*) AS upto, count(*) FILTER (d < DATE '1997-03-14') AS before FROM day_bars WHERE d <= DATE '1997-03-14' GROUP BY 1",
    "p3_class_gaps": f"{_BO}, x AS (SELECT instrument, lag(d) OVER {ORD} AS p, d FROM day_bars), y AS (SELECT instrument, p AS after, d AS before, CAST(CASE WHEN instrument = '5-LOW' THEN d - p - 1 ELSE {_WD.format(x='d')} - {_WD.format(x='p + 1')} END AS BIGINT) AS missing FROM x WHERE p IS NOT NULL) SELECT * FROM y WHERE missing > 1",
    "g3_carry_veto": f"{_BO}, {_PAIRS_SQL}, {_RATES_SQL}, s AS (SELECT instrument, d, CAST(sign(c / lag(c, 21) OVER {ORD} - 1) AS INTEGER) AS side FROM day_bars) SELECT s.instrument, s.d, CASE WHEN side * (b.rate - q.rate) < 0 THEN 0 ELSE side END AS signal FROM s JOIN pairs p ON p.instrument = s.instrument JOIN rates b ON b.ccy = p.base JOIN rates q ON q.ccy = p.quote",
    "g5_currency_momentum": f"{_BO}, {_PAIRS_SQL}, s AS (SELECT * FROM (SELECT instrument, d, c / lag(c, 21) OVER {ORD} - 1 AS score FROM day_bars) JOIN pairs USING (instrument) WHERE score IS NOT NULL), l AS (SELECT d, base AS ccy, score AS x FROM s UNION ALL SELECT d, quote, -score FROM s), g AS (SELECT d, ccy, avg(x) AS x FROM l GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY x DESC, ccy) AS top, row_number() OVER (PARTITION BY d ORDER BY x, ccy) AS low, count(*) OVER (PARTITION BY d) AS many, (x - avg(x) OVER (PARTITION BY d)) / stddev_samp(x) OVER (PARTITION BY d) AS z FROM g) SELECT s.instrument, s.d, CASE WHEN b.top = 1 THEN 1 ELSE -1 END AS side, round(b.z - q.z, 6) AS z FROM s JOIN k b ON b.d = s.d AND b.ccy = s.base JOIN k q ON q.d = s.d AND q.ccy = s.quote WHERE b.many >= 3 AND (b.top = 1 AND q.low = 1 OR b.low = 1 AND q.top = 1)",
    "g18_spillover": f"{_BO}, s AS (SELECT instrument, d, c / lag(c, 21) OVER {ORD} - 1 AS r FROM day_bars), m AS (SELECT d, r > 0 AS up FROM s WHERE instrument = '1-URGENT'), f AS (SELECT min_by(up, d) FILTER (up IS NOT NULL) AS up0 FROM m), x AS (SELECT s.instrument, s.d, CAST(sign(s.r) AS INTEGER) AS side, coalesce(m.up, false) AS up FROM s ASOF LEFT JOIN m ON s.d >= m.d WHERE s.instrument <> '1-URGENT') SELECT instrument, d, CASE WHEN side = 1 AND NOT up OR side = -1 AND up THEN 0 ELSE side END AS signal FROM x",
    "w52_correlations": f"{_BO}, {_RET}, {_corr_sql(63)} SELECT a, b, round(corr, 6) AS corr, n FROM cr",
    "v17_clusters": f"{_BO}, {_RET}, {_corr_sql(None)}, t AS (SELECT a, b, corr FROM cr UNION ALL SELECT b, a, corr FROM cr) SELECT a AS instrument, count(*) FILTER (corr >= 0.05) AS together FROM t GROUP BY 1",
    "v18_heat_list": f"{_BO}, {_RET}, {_corr_sql(None)} SELECT a, b, round(corr, 6) AS corr, n, round(abs(corr), 6) AS strength FROM cr WHERE n >= 15 ORDER BY abs(corr) DESC, a, b LIMIT 6",
    "v9_diebold_mariano": f"{_BO}, {_RET}, t AS (SELECT d, max(r) FILTER (instrument = '1-URGENT') AS a, max(r) FILTER (instrument = '2-HIGH') AS b FROM r WHERE r < 5 GROUP BY 1), x AS (SELECT avg(b * b - a * a) AS m, var_pop(b * b - a * a) AS v, CAST(count(*) AS DOUBLE) AS n FROM t WHERE a IS NOT NULL AND b IS NOT NULL), y AS (SELECT CASE WHEN v > 0 THEN {_DM} ELSE 0 END AS s, n FROM x) SELECT n, round(s, 6) AS dm, round(1 - {_normal_sql('s')}, 6) AS p FROM y",
    "v3_deflated_sharpe": f"{_BO}, r AS (SELECT instrument, ln(c / lag(c) OVER {ORD}) AS r FROM day_bars), q AS (SELECT instrument, r - avg(r) OVER (PARTITION BY instrument) AS e, r FROM r WHERE r IS NOT NULL), s AS (SELECT instrument, count(*) AS n, avg(r) / stddev_samp(r) AS s, avg(e * e * e) / power(avg(e * e), 1.5) AS g3, avg(e * e * e * e) / power(avg(e * e), 2) AS g4 FROM q GROUP BY 1), z AS (SELECT stddev_samp(s) AS sd FROM s), t AS (SELECT instrument, s, sd * ((1 - 0.5772156649015329) * {inverse_normal_sql('(1 - 1 / 40.0::DOUBLE)')} + 0.5772156649015329 * {inverse_normal_sql('(1 - 1 / (40.0::DOUBLE * 2.718281828459045))')}) AS s0, n, g3, g4 FROM s, z), u AS (SELECT *, (s - s0) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - g3 * s + (g4 - 1) / 4 * s * s)) AS x FROM t) SELECT instrument, round(s, 6) AS sharpe, round(s0, 6) AS benchmark, round({_normal_sql('x')}, 6) AS dsr FROM u",
    "v19_trials_panel": f"{_BO}, r AS (SELECT instrument, ln(c / lag(c) OVER {ORD}) AS r FROM day_bars), s AS (SELECT avg(r) / stddev_samp(r) AS s FROM r WHERE r IS NOT NULL GROUP BY instrument), p AS (SELECT CAST(count(*) AS DOUBLE) AS n, max(s) AS best, stddev_samp(s) AS sd FROM s), e AS (SELECT n, best, sd * ((1 - 0.5772156649015329) * {inverse_normal_sql('(1 - 1 / n)')} + 0.5772156649015329 * {inverse_normal_sql('(1 - 1 / (n * 2.718281828459045))')}) AS expected FROM p) SELECT n, round(best, 6) AS best, round(expected, 6) AS expected, best > expected AS beats FROM e",
    "v10_trial_ledger": "SELECT p_type, count(*) AS rows, count(DISTINCT (p_brand, p_size)) AS trials FROM part GROUP BY 1",
    "z12_proximity": f"{_BO}, x AS (SELECT *, lag(c, 5) OVER {ORD} AS level FROM day_bars), y AS (SELECT *, l <= level * 1.01 AND h >= level * 0.99 AS inside FROM x), z AS (SELECT *, lag(inside) OVER {ORD} AS was FROM y) SELECT instrument, d FROM z WHERE inside AND NOT was",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (j1_union_timeline, j4_clipped_asof, j6_asof_scalar, j7_publication_lag, j8_weekly_context, p10_bar_close, p11_forming_tail, p13_day_migration, p14_point_in_time, p3_class_gaps, g3_carry_veto, g5_currency_momentum, g18_spillover, w52_correlations, v17_clusters, v18_heat_list, v9_diebold_mariano, v3_deflated_sharpe, v19_trials_panel, v10_trial_ledger, z12_proximity)
}
