"""Queries of graded setups, sessions, links, ranks, costs and caps, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.operators import alignment, crosssection, grading
from tidemark.plans import desk, indicators, reviews
from tidemark.plans.bars import day_bars
from tidemark.plans.desk import pick
from tidemark.plans.indicators import ORD, _w, rounded
from tidemark.plans.joins import BARS
from tidemark.plans.series import _PAIRS_SQL, _pairs

HORIZON = 30
#: Setups on the orders' instruments and prices, by expressions that both engines read.
_BASE = {"id": "o_orderkey", "instrument": "o_orderpriority", "d": "CAST(o_orderdate AS DATE)", "px": "o_totalprice", "m": "(o_orderkey * 7919 + o_custkey * 104729) % 1000003"}
_LEVELS = {
    "lo": "CASE WHEN m % 10 = 0 THEN NULL ELSE px * 0.9e0 END",
    "hi": "CASE WHEN m % 10 = 0 THEN NULL ELSE px * 1.1e0 END",
    "scan": "px * (1 + ((m % 9) - 4) / 20e0)",
    "side": pick("m", ["long", "short", "neutral", "long", "short"]),
    "up": "px * (1.2e0 + (m % 4) / 10e0)",
    "down": "px * (0.8e0 - (m % 3) / 10e0)",
}
_ENDS = {"target": "CASE WHEN m % 17 = 0 THEN NULL WHEN side = 'short' THEN down ELSE up END", "stop": "CASE WHEN side = 'short' THEN up ELSE down END"}


def _lines(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {k}" for k, x in columns.items())


_SETUPS_SQL = f"{BARS}, s1 AS (SELECT {_lines(_BASE)} FROM orders), s2 AS (SELECT *, {_lines(_LEVELS)} FROM s1), written AS (SELECT *, {_lines(_ENDS)} FROM s2)"


def _written(spark, sf_dir) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for step in (_BASE, _LEVELS, _ENDS):
        df = df.selectExpr(*(["*"] if step is not _BASE else []), *[f"{x} AS {k}" for k, x in step.items()])
    return df


def t3_graded(spark, sf_dir):
    """Filled, then resolved by the first bar that meets a level; a bar that meets both is ambiguous."""
    return grading.graded(_written(spark, sf_dir), day_bars(spark, sf_dir), HORIZON).select("id", "outcome", "filled", "resolved")


def t4_resolved(spark, sf_dir):
    """The older rule: the target counts first, what is open 45 days after its day has expired."""
    df = grading.graded(_written(spark, sf_dir), day_bars(spark, sf_dir), HORIZON, "tp_hit")
    price = F.when(F.col("outcome") == "tp_hit", F.col("target")).when(F.col("outcome") == "sl_hit", F.col("stop"))
    expired = F.when(F.datediff(F.lit("1998-06-01").cast("date"), "d") > 45, "expired")
    return rounded(df.select("id", F.coalesce("outcome", expired).alias("outcome"), price.alias("price")), ["id"])


def _hours(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("event_type").alias("instrument"), F.date_trunc("hour", "ts").alias("t")).agg(F.max("value").alias("h"), F.min("value").alias("l"))


def p17_walk(spark, sf_dir):
    """The bars that an event-driven walk visits: those with 60 bars before them, and how many it may see."""
    return day_bars(spark, sf_dir).select("instrument", "d", F.row_number().over(w.ordered()).cast("long").alias("seen")).filter("seen > 60")


def p19_local_sessions(spark, sf_dir):
    """Stocks from 9:30 to 16:00 on weekdays, currencies from Sunday 17:00 to Friday 17:00, New York time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York"))
    day, minute = F.weekday("t"), F.hour("t") * 60 + F.minute("t")
    forex = F.when(day == 5, False).when(day == 6, F.hour("t") >= 17).when(day == 4, F.hour("t") < 17).otherwise(True)
    return e.select("event_id", ((day < 5) & (minute >= 570) & (minute < 960)).alias("stocks"), forex.alias("forex"))


def p21_sorted_grid(spark, sf_dir):
    """Rows of a run with a result, the greatest ratio first and those without one last; the place is that within the run."""
    order = Window.partitionBy("run").orderBy(F.col("rr").desc_nulls_last(), "id")
    return reviews.setups(spark, sf_dir).filter("outcome IS NOT NULL").select("run", "id", F.row_number().over(order).cast("long").alias("place"))


def p22_weekend_split(spark, sf_dir):
    """Win rates by kind and band of confidence; coins count in those of their own part of the week, all else in both."""
    s = desk.setups(spark, sf_dir).filter("outcome IN ('tp_hit', 'sl_hit')").withColumn("split", F.explode(F.array(F.lit("weekday"), F.lit("weekend"))))
    s = s.filter((F.col("kind") != "crypto") | ((F.weekday("ts") >= 5) == (F.col("split") == "weekend")))
    return s.groupBy("split", "kind", F.floor(F.col("conf") / 20).cast("long").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("outcome") == "tp_hit").cast("double")), 6).alias("win"))


def p23_without_first_bars(spark, sf_dir):
    """Hours without the first of each day of a series, whose prices may be those of an opening auction."""
    first = Window.partitionBy("instrument", F.to_date("t")).orderBy("t")
    return _hours(spark, sf_dir).withColumn("i", F.row_number().over(first)).filter("i > 1").select("instrument", "t", "h", "l")


_TRADE = {"ticket": "CASE WHEN m % 3 = 0 THEN id + 1000000 ELSE id END", "symbol": "instrument", "side": "side", "stop": "CASE WHEN m % 5 = 0 THEN down * 1.5e0 ELSE down END", "target": "up + 0.001e0"}
_LINKED = {"id": "id", "ticket": "CASE WHEN m % 2 = 0 THEN id WHEN m % 7 = 1 THEN id + 5000000 END", "symbol": "instrument", "side": "side", "stop": "down", "target": "up"}


def j15b_link_audit(spark, sf_dir):
    s = _written(spark, sf_dir)
    linked = grading.links(s.selectExpr(*[f"{x} AS {k}" for k, x in _TRADE.items()]), s.selectExpr(*[f"{x} AS {k}" for k, x in _LINKED.items()]), 0.01)
    return linked.groupBy("link").agg(F.count("*").alias("n"))


# Rates by the day from which they hold.
_DATED = (("EUR", "1990-01-01", 0.02), ("EUR", "1995-06-01", 0.035), ("USD", "1990-01-01", 0.05), ("USD", "1996-03-15", 0.015), ("JPY", "1990-01-01", 0.001), ("GBP", "1993-01-01", 0.0475), ("GBP", "1997-02-01", 0.01))
_DATED_SQL = f"dated(ccy, d, rate) AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, DATE {chr(39)}{d}{chr(39)}, {r}::DOUBLE)' for c, d, r in _DATED)}))"


def g6_carry(spark, sf_dir):
    """Pairs of a day by the difference of their currencies' rates: the best third long, the worst short, with the z-score of the day."""
    rates = spark.createDataFrame(list(_DATED), "ccy string, d string, rate double").withColumn("d", F.to_date("d"))
    df = day_bars(spark, sf_dir).select("instrument", "d").join(_pairs(spark), "instrument")
    for leg in ("base", "quote"):
        df = alignment.asof(df.withColumnRenamed(leg, "ccy"), rates, "ccy", "d", ["rate"]).withColumnRenamed("rate", f"{leg}_rate").drop("ccy")
    ranked = crosssection.buckets(df.withColumn("carry", F.col("base_rate") - F.col("quote_rate")), "carry", 1 / 3, 3)
    return rounded(ranked.select("instrument", "d", "carry", "side", "z"), ["instrument", "d"])


def r9_slots(spark, sf_dir):
    """Three slots a day by probability, expected value, and expected value after the regime's multiplier; equal scores by name."""
    b = day_bars(spark, sf_dir).withColumns({"p": F.lit(0.45) + (F.col("v") % 5) / 20, "rr": F.lit(1.0) + F.dayofmonth("d") % 4 / 2, "calm": F.when(F.col("c") > F.col("o"), 1.0).otherwise(0.5)})
    value = F.col("p") * F.col("rr") - (1 - F.col("p"))
    modes = F.array(*[F.struct(F.lit(name).alias("mode"), F.round(score, 9).alias("score")) for name, score in (("probability", F.col("p")), ("expected_value", value), ("ev_regime", value * F.col("calm")))])
    each = b.select("instrument", "d", F.explode(modes).alias("x")).select("instrument", "d", "x.*")
    return each.withColumn("slot", F.row_number().over(Window.partitionBy("d", "mode").orderBy(F.desc("score"), "instrument")).cast("long")).filter("slot <= 3")


def t8_fill_costs(spark, sf_dir):
    s = desk.setups(spark, sf_dir)
    fills = {f"{name}_fill": F.round(grading.fill_price(F.col("px"), F.lit(name == "buy"), F.col("symbol"), F.col("kind"), 1.2, 0.5, 4.0), 6) for name in ("buy", "sell")}
    return s.select("id", *[x.alias(k) for k, x in fills.items()])


def t11_risk_cap(spark, sf_dir):
    rows = _written(spark, sf_dir).selectExpr("d", "id", "m % 3 = 0 AS is_open", "(1 + m % 50) / 10e0 AS risk", "px AS notional")
    return rounded(grading.risk_capped(rows, 0.065, 300.0, 60000.0).select("id", "gamma", "kept"), ["id"])


def t12_borrow(spark, sf_dir):
    shorts = _written(spark, sf_dir).filter("side = 'short'").selectExpr("id", "instrument", "d", "(1 + m % 7) * 1e0 AS units", "1 + m % 40 AS bars")
    return grading.borrow_cost(day_bars(spark, sf_dir), shorts, 37.0, 252).select("id", F.round("cost", 3).alias("cost"))


def t16_vol_scalar(spark, sf_dir):
    df = day_bars(spark, sf_dir).select("instrument", "d", "c")
    for step in grading.vol_scalar("c", 20, 8.0, 0.25, 2.0, 252):
        df = df.withColumns(step)
    return rounded(df.select("instrument", "d", "scalar"), ["instrument", "d"])


def w46_comomentum(spark, sf_dir):
    return rounded(grading.comomentum(day_bars(spark, sf_dir), 63, 60, 10, 2, 1), ["d", "side"])


def _entries(spark, sf_dir) -> DataFrame:
    sign = F.signum(w.simple_return(n=63))
    return day_bars(spark, sf_dir).select("instrument", "d", F.when(sign > 0, "long").when(sign < 0, "short").alias("side")).filter("side IS NOT NULL")


def g17_comomentum_gate(spark, sf_dir):
    """Momentum entries but those on days when their side is unusually crowded."""
    blocked = grading.comomentum(day_bars(spark, sf_dir), 63, 60, 10, 2, 1).filter("z > 0.5123").select("d", "side")
    return _entries(spark, sf_dir).join(blocked, ["d", "side"], "left_anti").select("instrument", "d", "side")


def g17_smoothness_gate(spark, sf_dir):
    """Momentum entries where the way there was smooth: information discreteness is known and not above 0."""
    fip = indicators.QUERIES["w40_information_discreteness"](spark, sf_dir).filter("fip <= 0").select("instrument", "d")
    return _entries(spark, sf_dir).join(fip, ["instrument", "d"], "left_semi")


def g23_regime_twins(spark, sf_dir):
    """Entries of three base strategies whose regime allows them: crossings and breakouts in a trend, reversals in a calm range."""
    labels = indicators.QUERIES["w13_rule_regime"](spark, sf_dir).select("instrument", "d", "regime")
    found = None
    for name, (column, allowed) in TWINS.items():
        entries = indicators.QUERIES[name](spark, sf_dir).filter(f"{column} <> 0").select("instrument", "d", F.lit(name).alias("base"), F.col(column).alias("side"))
        kept = entries.join(labels, ["instrument", "d"]).filter(allowed).drop("regime")
        found = kept if found is None else found.unionByName(kept)
    return found


_IN_TREND = "regime LIKE 'up/%' OR regime LIKE 'down/%'"
#: The column of each base strategy's entries, and the regimes in which its twin enters.
TWINS = {"g22_ma_cross": ("crossed", _IN_TREND), "g22_breakout": ("signal", _IN_TREND), "g22_band_reversal": ("signal", "regime = 'ranging/normal'")}


# What one unit of a currency is in pounds where no newer rate is known; fixed values.
FALLBACK = {"USD": 1 / 1.30, "CHF": 1 / 1.14, "CAD": 1 / 1.77, "NZD": 1 / 2.10, "JPY": 1 / 206.0, "EUR": 1 / 0.84}
_LIVE = (("USD", "1996-05-01", 1.51), ("USD", "1996-05-20", 1.53), ("JPY", "1995-07-03", 139.2))
_LIVE_SQL = f"live(quote, d, rate) AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, DATE {chr(39)}{d}{chr(39)}, {r}::DOUBLE)' for c, d, r in _LIVE)}))"


def x12_conversion(spark, sf_dir):
    """What a unit of the symbol's quote currency is in pounds: by the last rate of at most 5 days before, else by the fixed one, else 1."""
    bare = F.upper(F.trim(F.regexp_extract("symbol", r"^([^\-._]*)", 1)))
    quote = F.when(bare.contains("/"), F.element_at(F.split(bare, "/"), -1)).when(F.length(bare) == 6, F.substring(bare, 4, 3)).otherwise("GBP")
    live = spark.createDataFrame(list(_LIVE), "quote string, d string, rate double").withColumn("d", F.to_date("d")).withColumn("seen", F.col("d"))
    s = desk.setups(spark, sf_dir).select("id", quote.alias("quote"), F.to_date("ts").alias("d"))
    found = alignment.asof(s, live, "quote", "d", ["seen", "rate"])
    fixed = F.coalesce(*[F.when(F.col("quote") == c, F.lit(x)) for c, x in FALLBACK.items()], F.lit(1.0))
    rate = F.when(F.col("quote") == "GBP", 1.0).when((F.datediff("d", "seen") <= 5) & (F.col("rate") > 0), F.try_divide(F.lit(1.0), F.col("rate"))).otherwise(fixed)
    return found.select("id", "quote", F.round(rate, 9).alias("rate"))


def a52_account(spark, sf_dir):
    """By kind: what round trips and the paper book's partial exits brought, and open positions, those of paper only where the broker holds none of the symbol."""
    s = reviews.setups(spark, sf_dir)
    held = s.filter("open AND m % 5 = 0")
    paper = s.filter("open AND m % 5 = 1 AND w % 8 = 0").join(held.filter("w % 40 = 0").select("symbol").distinct(), "symbol", "left_anti")
    row = lambda df, name, pnl: df.select("kind", F.lit(name).alias("part"), F.expr(pnl).alias("pnl"))
    parts = [row(s.filter("NOT open"), "realized", "pnl"), row(s.filter("NOT open AND m % 7 = 0"), "realized", "pnl / 2"), row(held, "floating", "pnl"), row(paper, "floating", "pnl")]
    book = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    one = lambda name: F.coalesce(F.sum(F.when(F.col("part") == name, F.col("pnl"))), F.lit(0.0))
    return book.groupBy("kind").agg(F.round(one("realized"), 4).alias("realized"), F.round(one("floating"), 4).alias("floating"), F.count_if(F.col("part") == "floating").alias("n_open"))


_AFTER = f"""n AS (SELECT *, row_number() OVER {ORD} AS n FROM day_bars), k AS (SELECT s.*, n.n FROM written s JOIN n USING (instrument, d)),
a AS (SELECT k.id, b.d AS bd, b.h, b.l FROM k, range(1, {HORIZON + 1}) AS r(x) JOIN n b ON b.instrument = k.instrument AND b.n = k.n + r.x),
f AS (SELECT s.id, CASE WHEN s.lo IS NULL OR coalesce(s.scan BETWEEN s.lo - abs(s.lo) * 0.0005 AND s.hi + abs(s.hi) * 0.0005, false) THEN s.d ELSE min(a.bd) FILTER (a.l <= s.hi AND a.h >= s.lo) END AS filled
      FROM written s LEFT JOIN a USING (id) WHERE s.side <> 'neutral' AND target IS NOT NULL GROUP BY s.id, s.lo, s.hi, s.scan, s.d),
h AS (SELECT s.id, s.target, s.stop, a.bd, CASE WHEN side = 'long' THEN a.h >= target ELSE a.l <= target END AS tp, CASE WHEN side = 'long' THEN a.l <= stop ELSE a.h >= stop END AS sl
      FROM written s JOIN f USING (id) JOIN a ON a.id = s.id AND a.bd >= f.filled),
g AS (SELECT id, min(bd) AS resolved, arg_min(tp, bd) AS tp, arg_min(sl, bd) AS sl FROM h WHERE tp OR sl GROUP BY 1)"""
_NY = "timezone('America/New_York', timezone('UTC', ts))"
_BARE = "upper(trim(regexp_extract(symbol, '^([^\\-._]*)', 1)))"
_COST = "CASE WHEN kind = 'forex' THEN 0.5 * 1.2 * CASE WHEN symbol LIKE '%JPY%' THEN 0.01e0 ELSE 0.0001e0 END + 0.5e0 / 1e4 * px ELSE (0.5 * 4.0e0 + 0.5) / 1e4 * px END"
_HOURS_SQL = "hours AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS t, max(value) AS h, min(value) AS l FROM events GROUP BY 1, 2)"

ORACLE_SQL = {
    "t3_graded": f"WITH {_SETUPS_SQL}, {_AFTER} SELECT s.id, CASE WHEN tp AND sl THEN 'ambiguous' WHEN tp THEN 'tp_hit' WHEN sl THEN 'sl_hit' END AS outcome, f.filled, g.resolved FROM written s LEFT JOIN f USING (id) LEFT JOIN g USING (id)",
    "t4_resolved": f"WITH {_SETUPS_SQL}, {_AFTER} SELECT s.id, CASE WHEN tp THEN 'tp_hit' WHEN sl THEN 'sl_hit' WHEN DATE '1998-06-01' - s.d > 45 THEN 'expired' END AS outcome, round(CASE WHEN tp THEN s.target WHEN sl THEN s.stop END, 6) AS price FROM written s LEFT JOIN g USING (id)",
    "p17_walk": f"WITH {BARS}, x AS (SELECT instrument, d, row_number() OVER {ORD} AS seen FROM day_bars) SELECT * FROM x WHERE seen > 60",
    "p19_local_sessions": f"WITH x AS (SELECT event_id, {_NY} AS t FROM events) SELECT event_id, isodow(t) < 6 AND hour(t) * 60 + minute(t) BETWEEN 570 AND 959 AS stocks, CASE isodow(t) WHEN 6 THEN false WHEN 7 THEN hour(t) >= 17 WHEN 5 THEN hour(t) < 17 ELSE true END AS forex FROM x",
    "p21_sorted_grid": f"WITH {reviews.SQL} SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY rr DESC NULLS LAST, id) AS place FROM setups WHERE outcome IS NOT NULL",
    "p22_weekend_split": f"WITH {desk.SETUPS_SQL}, x AS (SELECT *, unnest(['weekday', 'weekend']) AS split FROM setups WHERE outcome IN ('tp_hit', 'sl_hit')) SELECT split, kind, CAST(floor(conf / 20) AS BIGINT) AS band, count(*) AS n, round(avg(CAST(outcome = 'tp_hit' AS DOUBLE)), 6) AS win FROM x WHERE kind <> 'crypto' OR (isodow(ts) > 5) = (split = 'weekend') GROUP BY 1, 2, 3",
    "p23_without_first_bars": f"WITH {_HOURS_SQL} SELECT instrument, t, h, l FROM hours QUALIFY row_number() OVER (PARTITION BY instrument, CAST(t AS DATE) ORDER BY t) > 1",
    "j15b_link_audit": f"""WITH {_SETUPS_SQL}, tr AS (SELECT {_lines(_TRADE)} FROM written), se AS (SELECT {_lines(_LINKED)} FROM written),
bt AS (SELECT ticket, arg_min({{'symbol': symbol, 'side': side, 'stop': stop}}, id) AS s FROM se WHERE ticket IS NOT NULL GROUP BY 1),
sg AS (SELECT t.ticket, arg_min(coalesce(CAST(s.ticket AS VARCHAR), 'none'), s.id) AS other FROM tr t JOIN se s ON s.symbol = t.symbol AND s.side = t.side AND s.stop > 0 AND s.stop BETWEEN t.stop - 1 AND t.stop + 1 AND abs(s.stop - t.stop) <= 0.01 AND abs(s.target - t.target) <= 0.01 GROUP BY 1),
x AS (SELECT CASE WHEN bt.s IS NOT NULL THEN CASE WHEN s.symbol = t.symbol AND s.side = t.side AND abs(s.stop - t.stop) <= 0.01 THEN 'correct_ticket' ELSE 'wrong_ticket' END WHEN other = 'none' THEN 'correct_signature' WHEN other IS NOT NULL THEN 'wrong_signature' ELSE 'unlinked' END AS link FROM tr t LEFT JOIN bt USING (ticket) LEFT JOIN sg USING (ticket))
SELECT link, count(*) AS n FROM x GROUP BY 1""",
    "g6_carry": f"""WITH {BARS}, {_PAIRS_SQL}, {_DATED_SQL}, p AS (SELECT instrument, d, base, quote FROM day_bars JOIN pairs USING (instrument)),
q AS (SELECT p.*, dated.rate AS br FROM p ASOF LEFT JOIN dated ON p.base = dated.ccy AND p.d >= dated.d), c AS (SELECT q.instrument, q.d, br - dated.rate AS carry FROM q ASOF LEFT JOIN dated ON q.quote = dated.ccy AND q.d >= dated.d),
x AS (SELECT *, count(*) OVER k AS n, row_number() OVER (PARTITION BY d ORDER BY carry DESC, instrument) AS up, row_number() OVER (PARTITION BY d ORDER BY carry, instrument) AS down, (carry - avg(carry) OVER k) / coalesce(nullif(stddev_samp(carry) OVER k, 0), 1) AS z FROM c WHERE carry IS NOT NULL WINDOW k AS (PARTITION BY d)),
y AS (SELECT *, greatest(1, CAST(round_even(n * {1 / 3}, 0) AS INTEGER)) AS many FROM x WHERE n >= 3)
SELECT instrument, d, round(carry, 6) AS carry, CASE WHEN up <= many THEN 1 WHEN down <= least(many, n - many) THEN -1 ELSE 0 END AS side, round(z, 6) AS z FROM y""",
    "r9_slots": f"""WITH {BARS}, b AS (SELECT *, 0.45e0 + (v % 5) / 20 AS p, 1 + day(d) % 4 / 2 AS rr, CASE WHEN c > o THEN 1 ELSE 0.5 END AS calm FROM day_bars),
x AS (SELECT instrument, d, unnest([{{'mode': 'probability', 'score': round(p, 9)}}, {{'mode': 'expected_value', 'score': round(p * rr - (1 - p), 9)}}, {{'mode': 'ev_regime', 'score': round((p * rr - (1 - p)) * calm, 9)}}], recursive := true) FROM b)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d, mode ORDER BY score DESC, instrument) AS slot FROM x) WHERE slot <= 3""",
    "t8_fill_costs": f"WITH {desk.SETUPS_SQL} SELECT id, round(px + ({_COST}), 6) AS buy_fill, round(px - ({_COST}), 6) AS sell_fill FROM setups",
    "t11_risk_cap": f"WITH {_SETUPS_SQL}, x AS (SELECT d, id, m % 3 = 0 AS is_open, (1 + m % 50) / 10e0 AS risk, px AS notional FROM written), y AS (SELECT *, least(1, 0.065e0 * 300 / sum(risk) OVER (PARTITION BY d)) AS gamma FROM x) SELECT id, round(gamma, 6) AS gamma, is_open OR gamma = 1 OR notional * gamma > 60000 AS kept FROM y",
    "t12_borrow": f"WITH {_SETUPS_SQL}, n AS (SELECT *, row_number() OVER {ORD} AS n FROM day_bars) SELECT s.id, round(sum(b.c) * (1 + m % 7) * 37 / 1e4 / 252, 3) AS cost FROM written s JOIN n USING (instrument, d) JOIN n b ON b.instrument = s.instrument AND b.n >= n.n AND b.n < n.n + 1 + m % 40 WHERE s.side = 'short' GROUP BY s.id, m",
    "t16_vol_scalar": f"WITH {BARS}, x AS (SELECT instrument, d, c / lag(c) OVER {ORD} - 1 AS r FROM day_bars), y AS (SELECT *, stddev_samp(r) OVER {_w(20)} * {math.sqrt(252)} AS rv, count(*) OVER {_w(21)} AS k FROM x) SELECT instrument, d, round(CASE WHEN k <= 10 THEN 1 WHEN rv > 1e-9 THEN greatest(0.25, least(2, 8 / rv)) ELSE 2 END, 6) AS scalar FROM y",
    "w46_comomentum": f"""WITH {BARS}, t AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM day_bars)), own AS (SELECT instrument, d, c, c / lag(c) OVER {ORD} - 1 AS r FROM day_bars),
s AS (SELECT t.d, i, x.instrument, r, last_value(c IGNORE NULLS) OVER (PARTITION BY x.instrument ORDER BY t.d) AS c FROM t CROSS JOIN (SELECT DISTINCT instrument FROM day_bars) x LEFT JOIN own ON own.instrument = x.instrument AND own.d = t.d),
m AS (SELECT *, CAST(sign(c / lag(c, 63) OVER {ORD} - 1) AS INTEGER) AS g FROM s),
p AS (SELECT x.d, x.i, x.g AS ga, y.g AS gb, corr(x.r, y.r) OVER (PARTITION BY x.instrument, y.instrument ORDER BY x.d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS k FROM m x JOIN m y ON x.d = y.d AND x.instrument < y.instrument),
e AS (SELECT d, ga AS g, avg(k) AS mean FROM p WHERE i >= 60 AND ga = gb AND ga <> 0 AND k IS NOT NULL AND NOT isnan(k) GROUP BY 1, 2),
z AS (SELECT t.d, g.g, mean FROM t CROSS JOIN (VALUES (1), (-1)) g(g) LEFT JOIN e ON e.d = t.d AND e.g = g.g)
SELECT d, CASE WHEN g > 0 THEN 'long' ELSE 'short' END AS side, round(mean, 6) AS together, round(CASE WHEN count(mean) OVER b = 10 THEN (mean - median(mean) OVER b) / nullif(stddev_pop(mean) OVER b, 0) END, 6) AS z FROM z WINDOW b AS (PARTITION BY g ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "x12_conversion": f"""WITH {desk.SETUPS_SQL}, {_LIVE_SQL}, s AS (SELECT id, CAST(ts AS DATE) AS d, CASE WHEN contains({_BARE}, '/') THEN split_part({_BARE}, '/', -1) WHEN len({_BARE}) = 6 THEN substr({_BARE}, 4) ELSE 'GBP' END AS quote FROM setups),
f AS (SELECT s.*, live.rate AS now, s.d - live.d AS age FROM s ASOF LEFT JOIN live ON s.quote = live.quote AND s.d >= live.d)
SELECT id, quote, round(CASE WHEN quote = 'GBP' THEN 1 WHEN age <= 5 THEN 1 / now ELSE CASE quote {' '.join(f"WHEN '{c}' THEN {x}" for c, x in FALLBACK.items())} ELSE 1 END END, 9) AS rate FROM f""",
    "a52_account": f"""WITH {reviews.SQL}, held AS (SELECT * FROM setups WHERE open AND m % 5 = 0), book AS (SELECT kind, 'r' AS part, pnl FROM setups WHERE NOT open UNION ALL SELECT kind, 'r', pnl / 2 FROM setups WHERE NOT open AND m % 7 = 0
UNION ALL SELECT kind, 'f', pnl FROM held UNION ALL SELECT kind, 'f', pnl FROM setups WHERE open AND m % 5 = 1 AND w % 8 = 0 AND symbol NOT IN (SELECT symbol FROM held WHERE w % 40 = 0))
SELECT kind, round(coalesce(sum(pnl) FILTER (part = 'r'), 0), 4) AS realized, round(coalesce(sum(pnl) FILTER (part = 'f'), 0), 4) AS floating, count(*) FILTER (part = 'f') AS n_open FROM book GROUP BY 1""",
}
_ENTRIES_SQL = f"x AS (SELECT instrument, d, sign(c / lag(c, 63) OVER {ORD} - 1) AS g FROM day_bars), entries AS (SELECT instrument, d, CASE WHEN g > 0 THEN 'long' ELSE 'short' END AS side FROM x WHERE g <> 0)"
ORACLE_SQL |= {
    "g17_comomentum_gate": f"WITH {BARS}, {_ENTRIES_SQL} SELECT * FROM entries WHERE (d, side) NOT IN (SELECT (d, side) FROM ({ORACLE_SQL['w46_comomentum']}) WHERE z > 0.5123)",
    "g17_smoothness_gate": f"WITH {BARS}, {_ENTRIES_SQL} SELECT e.* FROM entries e JOIN ({indicators.ORACLE_SQL['w40_information_discreteness']}) f USING (instrument, d) WHERE fip <= 0",
    "g23_regime_twins": f"WITH labels AS ({indicators.ORACLE_SQL['w13_rule_regime']}) " + " UNION ALL ".join(f"SELECT instrument, d, '{name}' AS base, {column} AS side FROM ({indicators.ORACLE_SQL[name]}) JOIN labels USING (instrument, d) WHERE {column} <> 0 AND ({allowed})" for name, (column, allowed) in TWINS.items()),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (g17_comomentum_gate, g17_smoothness_gate, g23_regime_twins, t3_graded, t4_resolved, p17_walk, p19_local_sessions, p21_sorted_grid, p22_weekend_split, p23_without_first_bars, j15b_link_audit, g6_carry, r9_slots, t8_fill_costs, t11_risk_cap, t12_borrow, t16_vol_scalar, w46_comomentum, x12_conversion, a52_account)
}
