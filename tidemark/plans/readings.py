"""Queries of readings of texts, of companies' accounts, of averages that fade, and of the gates of a validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parsing, scores, windows as w
from tidemark.operators import recurrences
from tidemark.plans import desk, sequences, series
from tidemark.plans.bars import DAY_BARS_SQL, day_bars
from tidemark.plans.indicators import ORD, rounded

BARS = f"day_bars AS ({DAY_BARS_SQL})"
_SETUPS_SQL = f"b AS (SELECT {', '.join(f'{x} AS {k}' for k, x in desk._BASE.items())} FROM orders), s AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in desk._SETUP.items())} FROM b)"


# Readings ----------------------------------------------------------------------------------------

_TEXTS = {
    "name": desk.pick("m", ["EUR/USD", "gbpjpy=X", "BTC-USD", "AAPL", "USDJPY", "XAU/USD.FX", "ETH/JPY", "brk.b", "EURUSD"]),
    "zone": desk.pick("m", ["'1.0850 - 1.0900'", "'near 1,234.5 or 1,300'", "'none'", "NULL", "'42'", "'between 7 and 3 and 5.25'"]).replace("''", "'"),
    "rr": desk.pick("w", ["'1:2.5'", "'2.5'", "'1 : 3'", "'2:1'", "NULL", "'about three'", "'0:4'"]).replace("''", "'"),
    "frame": desk.pick("w", ["15m", "4h", "1d", "1w", "30min", "2wk", "odd", "h"]),
}


def _texts(spark, sf_dir):
    return desk.setups(spark, sf_dir).selectExpr("id", *[f"{x} AS {k}" for k, x in _TEXTS.items()])


def f1_symbol_legs(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", parsing.base_of(F.col("name")).alias("base"), parsing.quote_of(F.col("name")).alias("quote"), parsing.pip_size(F.col("name")).alias("pip"))


def f3_entry_zone(spark, sf_dir):
    """Lower and upper bound and middle of the zones that the texts name."""
    n = parsing.numbers_in(F.col("zone"))
    return rounded(_texts(spark, sf_dir).select("id", F.array_min(n).alias("lo"), F.array_max(n).alias("hi"), parsing.zone_middle(F.col("zone")).alias("middle")), ["id"])


def f4_reward_ratio(spark, sf_dir):
    return rounded(_texts(spark, sf_dir).select("id", parsing.reward_ratio(F.col("rr")).alias("ratio")), ["id"])


def p9_timeframe_seconds(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", parsing.timeframe_seconds(F.col("frame")).alias("seconds"))


def p12_midnight_pin(spark, sf_dir):
    """Bars of an hour pinned to midnight of their UTC day, of each day the last one kept."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pinned = e.select(F.col("event_type").alias("instrument"), F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("t"), "ts", "event_id", "value")
    return pinned.groupBy("instrument", "t").agg(F.max_by("value", F.struct("ts", "event_id")).alias("c"))


_CLEAN = r"regexp_replace(upper(name), '(=X|\.[A-Z]+)$', '')"
_NUMBERS = r"list_transform(regexp_extract_all(regexp_replace({}, '(\d),(\d\d\d)', '\1\2', 'g'), '\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE))"


# Accounts ----------------------------------------------------------------------------------------

#: A supplier's accounts of a year, of what it shipped.
_ACCOUNTS = {
    "revenue": "sum(l_extendedprice)",
    "gross_profit": "sum(l_extendedprice * (0.6e0 - l_discount))",
    "receivables": "sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE l_extendedprice * 0.1e0 END)",
    "assets": "sum(l_extendedprice) * 1.5e0 + sum(l_quantity) * 100e0",
    "current_assets": "sum(l_extendedprice) * 0.4e0 + sum(l_quantity) * 10e0",
    "current_liabilities": "sum(l_quantity) * 20e0",
    "plant": "sum(l_quantity) * 60e0",
    "depreciation": "sum(l_extendedprice * l_tax)",
    "overhead": "sum(l_extendedprice * l_discount)",
    "debt": "sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0e0 END) * 0.5e0",
    "cash_flow": "sum(l_extendedprice * (0.1e0 + l_tax - l_discount))",
    "net_income": "sum(l_extendedprice * (0.12e0 - l_discount))",
    "shares": "CAST(count(*) AS DOUBLE)",
}


def _years(spark, sf_dir):
    from pyspark.sql import Window

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(*[F.expr(x).alias(k) for k, x in _ACCOUNTS.items()])
    now = li.select("l_suppkey", "y", F.struct(*_ACCOUNTS).alias("now"))
    return now.withColumn("before", F.lag("now").over(Window.partitionBy("l_suppkey").orderBy("y")))


def f16_strength(spark, sf_dir):
    """Nine signs of strength of each supplier's year against the one before."""
    score = scores.strength("now", "before")
    return _years(spark, sf_dir).filter("before IS NOT NULL").select("l_suppkey", "y", score.alias("score"), scores.strength_label(score).alias("quality"))


def f17_manipulation(spark, sf_dir):
    score = F.round(scores.manipulation("now", "before"), 3)
    return _years(spark, sf_dir).filter("before IS NOT NULL").select("l_suppkey", "y", score.alias("score"), F.when(score > -1.78, "MANIPULATION_RISK").when(score.isNotNull(), "CLEAN").alias("flag"))


def f19_distress(spark, sf_dir):
    a = lambda n: F.col(f"now.{n}")
    z = scores.z_score(a("current_assets") - a("current_liabilities"), a("net_income"), a("gross_profit") - a("overhead"), a("assets") - a("debt"), a("revenue"), a("assets"), F.nullif(a("debt") + a("current_liabilities"), F.lit(0.0)))
    return rounded(_years(spark, sf_dir).select("l_suppkey", "y", z.alias("z"), scores.z_zone(F.round(z, 6)).alias("zone")), ["l_suppkey", "y"])


_YEARS_SQL = f"""WITH l AS (SELECT l_suppkey, year(l_shipdate) AS y, {", ".join(f"{x} AS {k}" for k, x in _ACCOUNTS.items())} FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, {", ".join(f"lag({k}) OVER (PARTITION BY l_suppkey ORDER BY y) AS {k}0" for k in _ACCOUNTS)} FROM l)"""
_SIGNS = "CAST(net_income / assets > 0 AS INT) + CAST(cash_flow > 0 AS INT) + CAST(net_income / assets > net_income0 / assets0 AS INT) + CAST(cash_flow / assets > net_income / assets AS INT) + CAST(debt / assets <= debt0 / assets0 AS INT) + CAST(current_assets / greatest(current_liabilities, 1) >= current_assets0 / greatest(current_liabilities0, 1) AS INT) + CAST(shares <= shares0 * 1.02::DOUBLE AS INT) + CAST(gross_profit / greatest(revenue, 1) >= gross_profit0 / greatest(revenue0, 1) AS INT) + CAST(revenue / assets >= revenue0 / assets0 AS INT)"
_M = """round(-4.84 + 0.92 * ((receivables / greatest(revenue, 1)) / nullif(receivables0 / greatest(revenue0, 1), 0)) + 0.528 * ((gross_profit0 / greatest(revenue0, 1)) / nullif(gross_profit / greatest(revenue, 1), 0))
 + 0.404 * ((1 - (current_assets + plant) / assets) / nullif(1 - (current_assets0 + plant0) / assets0, 0)) + 0.892 * CASE WHEN revenue0 > 0 THEN revenue / revenue0 END
 + 0.115 * (CASE WHEN depreciation0 > 0 THEN depreciation0 / greatest(depreciation0 + plant0, 1) END / nullif(CASE WHEN depreciation > 0 THEN depreciation / greatest(depreciation + plant, 1) END, 0))
 - 0.172 * ((overhead / greatest(revenue, 1)) / nullif(overhead0 / greatest(revenue0, 1), 0)) + 4.679 * ((net_income - cash_flow) / assets) - 0.327 * (((debt + current_liabilities) / assets) / nullif((debt0 + current_liabilities0) / assets0, 0)), 3)"""
_Z = "round(1.2 * (current_assets - current_liabilities) / assets + 1.4 * net_income / assets + 3.3 * (gross_profit - overhead) / assets + 0.6 * (assets - debt) / nullif(debt + current_liabilities, 0) + revenue / assets, 6)"


# Averages ----------------------------------------------------------------------------------------


def w26_macd(spark, sf_dir):
    """The difference of the averages of 12 and 26 bars, its average of 9, and what lies between."""
    b = recurrences.faded(day_bars(spark, sf_dir).select("instrument", "d", "c"), "c", {"fast": 1 - 2 / 13, "slow": 1 - 2 / 27})
    m = recurrences.faded(b.select("instrument", "d", (F.col("fast") - F.col("slow")).alias("macd")), "macd", {"signal": 1 - 2 / 10})
    return rounded(m.select("instrument", "d", "macd", "signal", (F.col("macd") - F.col("signal")).alias("histogram")), ["instrument", "d"])


_MACD_SQL = f"""
WITH RECURSIVE {BARS}, n AS (SELECT instrument, d, c, row_number() OVER {ORD} AS i FROM day_bars), e AS (
  SELECT instrument, i, d, CAST(c AS DOUBLE) AS a, CAST(c AS DOUBLE) AS b, 0::DOUBLE AS m, 0::DOUBLE AS s FROM n WHERE i = 1
  UNION ALL
  SELECT instrument, i, d, a, b, a - b, s + 2.0::DOUBLE / 10 * (a - b - s) FROM (
    SELECT n.instrument, n.i, n.d, e.a + 2.0::DOUBLE / 13 * (n.c - e.a) AS a, e.b + 2.0::DOUBLE / 27 * (n.c - e.b) AS b, e.s FROM e JOIN n ON n.instrument = e.instrument AND n.i = e.i + 1)
) SELECT instrument, d, round(m, 6) AS macd, round(s, 6) AS signal, round(m - s, 6) AS histogram FROM e
"""


def w53_month_returns(spark, sf_dir):
    """Returns over one, three, six and twelve months of bars."""
    b = day_bars(spark, sf_dir).withColumns({f"ret{n}": w.simple_return(n=n) for n in (21, 63, 126, 252)})
    return rounded(b.select("instrument", "d", *[f"ret{n}" for n in (21, 63, 126, 252)]), ["instrument", "d"])


# Gates -------------------------------------------------------------------------------------------


def v7_gates(spark, sf_dir):
    """Of each instrument, held as a strategy: the deflated Sharpe ratio, the overfitting of the set of momentum strategies, the Sharpe ratios over all pairs of six parts of its history, and which gates it passes."""
    dsr = series.v3_deflated_sharpe(spark, sf_dir).select("instrument", "dsr")
    pbo = sequences.v4_overfitting(spark, sf_dir).select("pbo")
    r = day_bars(spark, sf_dir).withColumn("r", w.log_return()).filter("r IS NOT NULL")
    ends = r.groupBy("instrument").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    part = F.least(F.lit(5), F.floor(F.datediff("d", "a") * 6 / (F.datediff("b", "a") + 1)).cast("int"))
    parts = r.join(ends, "instrument").groupBy("instrument", part.alias("g")).agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    splits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.bit_count(i) == 2)
    each = parts.withColumn("split", F.explode(splits)).filter("(shiftright(split, g) & 1) = 1").groupBy("instrument", "split").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    mean = F.col("s") / F.col("n")
    sharpe = F.coalesce(F.try_divide(mean, F.sqrt(F.greatest(F.try_divide(F.col("q") - F.col("n") * mean * mean, F.col("n") - 1), F.lit(0.0)))), F.lit(0.0))
    oos = each.withColumn("x", F.round(sharpe, 9)).groupBy("instrument").agg(F.median("x").alias("oos_median"), F.avg((F.col("x") > 0).cast("double")).alias("positive"), F.count("*").alias("paths"))
    found = oos.join(dsr, "instrument").join(F.broadcast(pbo))
    gates = found.withColumns({"dsr_pass": F.col("dsr") > 0.95, "pbo_pass": F.coalesce(F.col("pbo") < 0.5, F.lit(False)), "cpcv_pass": (F.col("oos_median") > 0) & (F.col("positive") > 0.5)})
    return rounded(gates.withColumn("passed", F.col("dsr_pass") & F.col("pbo_pass") & F.col("cpcv_pass")), ["instrument"])


_GATES_SQL = f"""
WITH v3 AS ({series.ORACLE_SQL["v3_deflated_sharpe"]}), v4 AS ({sequences.ORACLE_SQL["v4_overfitting"]}), {BARS},
r AS (SELECT * FROM (SELECT instrument, d, ln(c / lag(c) OVER {ORD}) AS r FROM day_bars) WHERE r IS NOT NULL),
g AS (SELECT instrument, r, CAST(least(5, floor(datediff('day', min(d) OVER (PARTITION BY instrument), d) * 6 / (datediff('day', min(d) OVER (PARTITION BY instrument), max(d) OVER (PARTITION BY instrument)) + 1))) AS INT) AS g FROM r),
x AS (SELECT instrument, i AS split, round(coalesce(avg(r) / nullif(stddev_samp(r), 0), 0), 9) AS x FROM g, range(64) t(i) WHERE bit_count(i) = 2 AND (i >> g) & 1 = 1 GROUP BY ALL),
o AS (SELECT instrument, median(x) AS oos_median, avg(CAST(x > 0 AS DOUBLE)) AS positive, count(*) AS paths FROM x GROUP BY 1),
f AS (SELECT o.*, dsr, pbo, dsr > 0.95 AS dsr_pass, coalesce(pbo < 0.5, FALSE) AS pbo_pass, oos_median > 0 AND positive > 0.5 AS cpcv_pass FROM o JOIN v3 USING (instrument), v4)
SELECT instrument, round(oos_median, 6) AS oos_median, round(positive, 6) AS positive, paths, dsr, pbo, dsr_pass, pbo_pass, cpcv_pass, dsr_pass AND pbo_pass AND cpcv_pass AS passed FROM f
"""

QUERIES = {f.__name__: f for f in (f1_symbol_legs, f3_entry_zone, f4_reward_ratio, p9_timeframe_seconds, p12_midnight_pin, f16_strength, f17_manipulation, f19_distress, w26_macd, w53_month_returns, v7_gates)}
_T = f"WITH {_SETUPS_SQL}, t AS (SELECT id, {', '.join(f'{x} AS {k}' for k, x in _TEXTS.items())} FROM s)"
ORACLE_SQL = {
    "f1_symbol_legs": f"{_T}, c AS (SELECT id, {_CLEAN} AS c FROM t), l AS (SELECT id, CASE WHEN regexp_matches(c, '[/-]') THEN regexp_split_to_array(c, '[/-]')[1] WHEN regexp_full_match(c, '[A-Z]{{6}}') THEN left(c, 3) ELSE c END AS base, CASE WHEN regexp_matches(c, '[/-]') THEN regexp_split_to_array(c, '[/-]')[2] WHEN regexp_full_match(c, '[A-Z]{{6}}') THEN substr(c, 4, 3) END AS quote FROM c) SELECT *, CASE WHEN quote = 'JPY' THEN 0.01::DOUBLE ELSE 0.0001::DOUBLE END AS pip FROM l",
    "f3_entry_zone": f"{_T}, n AS (SELECT id, {_NUMBERS.format('zone')} AS n FROM t) SELECT id, round(list_min(n), 6) AS lo, round(list_max(n), 6) AS hi, round((list_min(n) + list_max(n)) / 2, 6) AS middle FROM n",
    "f4_reward_ratio": f"{_T}, n AS (SELECT id, rr, {_NUMBERS.format('rr')} AS n FROM t) SELECT id, round(CASE WHEN rr LIKE '%:%' AND len(n) >= 2 THEN n[2] / nullif(n[1], 0) ELSE n[1] END, 6) AS ratio FROM n",
    "p9_timeframe_seconds": rf"{_T}, n AS (SELECT id, TRY_CAST(regexp_extract(frame, '(\d+)', 1) AS BIGINT) AS n, lower(regexp_extract(frame, '([a-zA-Z]+)', 1)) AS u FROM t) SELECT id, n * CASE WHEN u IN ('m', 'min') THEN 60 WHEN u = 'h' THEN 3600 WHEN u = 'd' THEN 86400 WHEN u IN ('w', 'wk') THEN 604800 END AS seconds FROM n",
    "p12_midnight_pin": "SELECT event_type AS instrument, date_trunc('day', ts)::TIMESTAMP AS t, arg_max(value, (ts, event_id)) AS c FROM events GROUP BY 1, 2",
    "f16_strength": f"{_YEARS_SQL}, x AS (SELECT l_suppkey, y, {_SIGNS} AS score FROM p WHERE revenue0 IS NOT NULL) SELECT *, CASE WHEN score >= 8 THEN 'high-quality' WHEN score >= 6 THEN 'above-average' WHEN score >= 4 THEN 'average' WHEN score >= 2 THEN 'weak' ELSE 'distressed' END AS quality FROM x",
    "f17_manipulation": f"{_YEARS_SQL}, x AS (SELECT l_suppkey, y, {_M} AS score FROM p WHERE revenue0 IS NOT NULL) SELECT *, CASE WHEN score > -1.78 THEN 'MANIPULATION_RISK' WHEN score IS NOT NULL THEN 'CLEAN' END AS flag FROM x",
    "f19_distress": f"{_YEARS_SQL}, x AS (SELECT l_suppkey, y, {_Z} AS z FROM p) SELECT *, CASE WHEN z > 2.99 THEN 'safe' WHEN z < 1.81 THEN 'distress' WHEN z IS NOT NULL THEN 'grey' END AS zone FROM x",
    "w26_macd": _MACD_SQL,
    "w53_month_returns": f"WITH {BARS} SELECT instrument, d, {', '.join(f'round(c / lag(c, {n}) OVER {ORD} - 1, 6) AS ret{n}' for n in (21, 63, 126, 252))} FROM day_bars",
    "v7_gates": _GATES_SQL,
}
