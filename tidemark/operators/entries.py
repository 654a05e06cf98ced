"""Entry signals of 22 base strategies over day bars, as columns: averages, crossings, oscillators, bands, breakouts.

What a strategy asks at a bar is a condition over the bar's series and those of the bar before, stated once, as text that SQL engines read. Series are windows over
an instrument; those that fade (averages, RSI, ATR, MACD) are joined up from months (``recurrences``). Nothing here holds positions.

Defined results: a series is null until it has its bars, and no condition over it holds; a series of no losses has an RSI of 100; a range of no height a stochastic of 50. Stops are multiples of the ATR
from the close, null without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.operators.recurrences import fading

#: Digits of the averages: what floating point adds to a series that stands still is no crossing.
DIGITS = 8
EMAS, SMAS, LOOKS = (10, 12, 20, 26, 50, 100, 200), (10, 20, 50, 100, 200), (10, 20, 50)


def _cross(fast: str, slow: str) -> tuple[str, str]:
    return f"{fast}_1 <= {slow}_1 AND {fast} > {slow}", f"{fast}_1 >= {slow}_1 AND {fast} < {slow}"


def _above(x: str, level: float) -> tuple[str, str]:
    return f"{x}_1 <= {level} AND {x} > {level}", f"{x}_1 >= {level} AND {x} < {level}"


def _triple() -> tuple[str, str]:
    up, down = _cross("ema10", "ema20")
    return f"{up} AND c > ema50", f"{down} AND c < ema50"


#: (name, regime of its twin, long, short, multiple of the ATR to the stop, targets of long and short).
STRATEGIES: tuple[tuple[str, str, str, str, float, tuple[str, str]], ...] = (
    *((f"{kind}_{a}_{b}", "trend", *_cross(f"{kind}{a}", f"{kind}{b}"), 2.0, ("", "")) for kind in ("sma", "ema") for a, b in ((10, 50), (20, 100), (50, 200))),
    ("triple_ema", "trend", *_triple(), 2.0, ("", "")),
    ("px_ema50", "trend", *_cross("c", "ema50"), 2.0, ("", "")),
    ("px_ema200", "trend", *_cross("c", "ema200"), 2.0, ("", "")),
    ("macd_cross", "trend", *_cross("macd", "sig"), 2.0, ("", "")),
    ("macd_hist", "trend", *_above("hist", 0), 2.0, ("", "")),
    ("rsi_revert", "ranging", "rsi_1 <= 30 AND rsi > 30", "rsi_1 >= 70 AND rsi < 70", 2.0, ("c + 2 * coalesce(atr, 0)", "c - 2 * coalesce(atr, 0)")),
    ("rsi_center", "trend", *_above("rsi", 50), 2.0, ("", "")),
    ("stoch_cross", "ranging", "k_1 <= kd_1 AND k > kd AND k < 20", "k_1 >= kd_1 AND k < kd AND k > 80", 2.0, ("", "")),
    ("rsi_macd", "trend", "rsi > 50 AND macd > sig AND (coalesce(rsi_1, 0) <= 50 OR coalesce(macd_1, 0) <= coalesce(sig_1, 0))", "rsi < 50 AND macd < sig AND (coalesce(rsi_1, 0) >= 50 OR coalesce(macd_1, 0) >= coalesce(sig_1, 0))", 2.0, ("", "")),
    ("bb_breakout", "trend", "c > sma20 + 2 * dev AND v > vma * 1.2", "c < sma20 - 2 * dev AND v > vma * 1.2", 2.0, ("", "")),
    ("bb_revert", "ranging", "c < sma20 - 2 * dev", "c > sma20 + 2 * dev", 3.0, ("sma20", "sma20")),
    ("atr_channel", "trend", "c > hi20 + atr", "c < lo20 - atr", 4.0, ("", "")),
    ("breakout_20", "trend", "c > hi20", "c < lo20", 4.0, ("", "")),
    ("breakout_50", "trend", "c > hi50", "c < lo50", 4.0, ("", "")),
    ("range_20", "trend", "c > hi20", "c < lo20", 4.0, ("", "")),
    ("swing_retest", "trend", "hi10 IS NOT NULL AND c_1 > hi10_1 AND c <= hi10_1 * 1.002 AND c >= hi10_1 * 0.995", "hi10 IS NOT NULL AND c_1 < lo10_1 AND c >= lo10_1 * 0.998 AND c <= lo10_1 * 1.005", 4.0, ("", "")),
)
#: Series of which the value of the bar before is asked for.
BEFORE = ("c", *[f"sma{p}" for p in SMAS], *[f"ema{p}" for p in (10, 20, 50, 100, 200)], "macd", "sig", "hist", "rsi", "k", "kd", "hi10", "lo10")


def with_series(bars: DataFrame) -> DataFrame:
    """bars (instrument, d, o, h, l, c, v) with all series, and those of the bar before under _1."""
    o = w.ordered()
    b = bars.withColumns({"i": F.row_number().over(o), "move": F.col("c") - F.lag("c").over(o), "tr": w.true_range(), **{f"sma{p}": w.mean("c", p) for p in (*SMAS, 12, 26)}})
    b = b.withColumns({"up": F.greatest(F.col("move"), F.lit(0.0)), "down": F.greatest(-F.col("move"), F.lit(0.0)), "tr": F.when(F.col("i") > 1, F.col("tr"))})
    seeded = {f"x_ema{p}": F.when(F.col("i") == p, F.col(f"sma{p}")).when(F.col("i") > p, F.col("c")) for p in EMAS}
    seeded |= {f"x_{x}": F.when(F.col("i") == 15, F.avg(x).over(w.trailing(14))).when(F.col("i") > 15, F.col(x)) for x in ("up", "down", "tr")}
    b = fading(b.withColumns(seeded), {f"ema{p}": (f"x_ema{p}", 1 - 2 / (p + 1)) for p in EMAS} | {n: (f"x_{x}", 13 / 14) for n, x in (("gain", "up"), ("fall", "down"), ("atr", "tr"))})
    b = b.withColumns({n: F.round(n, DIGITS) for n in (*[f"ema{p}" for p in EMAS], "gain", "fall")})
    b = b.withColumns({"macd": F.round(F.col("ema12") - F.col("ema26"), DIGITS), "rsi": F.when(F.col("fall") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("fall")))})
    b = fading(b.withColumn("x_sig", F.when(F.col("i") == 34, F.avg("macd").over(w.trailing(9))).when(F.col("i") > 34, F.col("macd"))), {"sig": ("x_sig", 0.8)}).withColumn("sig", F.round("sig", DIGITS))
    high, low = w.highest("h", 14), w.lowest("l", 14)
    b = b.withColumns({"hist": F.round(F.col("macd") - F.col("sig"), DIGITS), "k": F.when(high > low, (F.col("c") - low) / (high - low) * 100).when(high.isNotNull(), 50.0), "dev": w.full(F.stddev_pop("c").over(w.trailing(20)), F.col("c"), 20), "vma": w.mean("v", 20), **{f"hi{n}": w.prior_high("h", n) for n in LOOKS}, **{f"lo{n}": w.prior_low("l", n) for n in LOOKS}})
    b = b.withColumn("kd", F.when(F.col("k").isNotNull(), F.sum(F.coalesce("k", F.lit(0.0))).over(w.trailing(3)) / 3))
    return b.withColumns({f"{x}_1": F.lag(x).over(o) for x in BEFORE})


def entries(bars: DataFrame, regimes: DataFrame) -> DataFrame:
    """(instrument, d, strategy, side, stop, target, twin) of every bar at which a strategy enters. regimes (instrument, d, regime as trend/volatility); twin: the regime lets the filtered twin enter too."""
    each = with_series(bars).join(regimes, ["instrument", "d"], "left")
    trend = F.coalesce(F.col("regime").startswith("up") | F.col("regime").startswith("down"), F.lit(False))
    calm = F.coalesce(F.col("regime") == "ranging/normal", F.lit(False))
    signals = []
    for name, twin, long, short, stop, (up, down) in STRATEGIES:
        side = F.when(F.expr(long), 1).when(F.expr(short), -1)
        target = F.when(F.expr(long), F.expr(up)).otherwise(F.expr(down)) if up else F.lit(None)
        signals.append(F.struct(F.lit(name).alias("strategy"), side.alias("side"), (F.col("c") - side * stop * F.col("atr")).alias("stop"), target.cast("double").alias("target"), (trend if twin == "trend" else calm).alias("twin")))
    return each.select("instrument", "d", F.explode(F.filter(F.array(*signals), lambda s: s["side"].isNotNull())).alias("s")).select("instrument", "d", "s.*")


def entries_sql(bars: str, regimes: str) -> str:
    """The same of SQL for day_bars and for (instrument, d, regime)."""
    order = "(PARTITION BY instrument ORDER BY d)"
    last = lambda n: f"(PARTITION BY instrument ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    mean = lambda x, n: f"CASE WHEN count({x}) OVER {last(n)} = {n} THEN avg({x}) OVER {last(n)} END"
    seeds = {f"ema{p}": (p, f"sma{p}", "c", f"2.0::DOUBLE / {p + 1}") for p in EMAS} | {n: (15, f"seed_{x}", x, "1.0::DOUBLE / 14") for n, x in (("gain", "up"), ("fall", "down"), ("atr", "tr"))}
    first = ", ".join(f"NULL::DOUBLE AS {k}" for k in seeds)
    step = ", ".join(f"CASE WHEN n.i = {p} THEN n.{s} WHEN n.i > {p} THEN e.{k} + {a} * (n.{x} - e.{k}) END AS {k}" for k, (p, s, x, a) in seeds.items())
    cases = " UNION ALL ".join(
        f"SELECT instrument, d, '{name}' AS strategy, CASE WHEN {long} THEN 1 WHEN {short} THEN -1 END AS side, {stop} AS mult, c, atr, {f'CASE WHEN {long} THEN {up} ELSE {down} END' if up else 'NULL::DOUBLE'} AS target, "
        + ("regime LIKE 'up%' OR regime LIKE 'down%'" if twin == "trend" else "regime = 'ranging/normal'") + " AS twin FROM z"
        for name, twin, long, short, stop, (up, down) in STRATEGIES
    )
    return f"""
WITH RECURSIVE day_bars AS ({bars}), labels AS ({regimes}), n0 AS (
  SELECT *, row_number() OVER {order} AS i, c - lag(c) OVER {order} AS move, CASE WHEN lag(c) OVER {order} IS NOT NULL THEN greatest(h - l, abs(h - lag(c) OVER {order}), abs(l - lag(c) OVER {order})) END AS tr,
         {", ".join(f"{mean('c', p)} AS sma{p}" for p in (*SMAS, 12, 26))} FROM day_bars
), n1 AS (SELECT *, greatest(move, 0) AS up, greatest(-move, 0) AS down FROM n0), n AS MATERIALIZED (
  SELECT *, {", ".join(f"avg({x}) OVER {last(14)} AS seed_{x}" for x in ("up", "down", "tr"))} FROM n1
), e AS (
  SELECT instrument, i, {first} FROM n WHERE i = 1
  UNION ALL
  SELECT n.instrument, n.i, {step} FROM e JOIN n ON n.instrument = e.instrument AND n.i = e.i + 1
), m AS MATERIALIZED (
  SELECT *, CASE WHEN fall = 0 THEN 100 ELSE 100 - 100 / (1 + gain / fall) END AS rsi, avg(macd) OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS seed_sig
  FROM (SELECT *, round(ema12 - ema26, {DIGITS}) AS macd FROM (SELECT n.*, {", ".join("e.atr" if k == "atr" else f"round(e.{k}, {DIGITS}) AS {k}" for k in seeds)} FROM n JOIN e ON n.instrument = e.instrument AND n.i = e.i))
), s AS (
  SELECT instrument, i, NULL::DOUBLE AS sig FROM m WHERE i = 1
  UNION ALL
  SELECT m.instrument, m.i, CASE WHEN m.i = 34 THEN seed_sig WHEN m.i > 34 THEN s.sig + 0.2::DOUBLE * (macd - s.sig) END FROM s JOIN m ON m.instrument = s.instrument AND m.i = s.i + 1
), x AS (
  SELECT m.*, round(sig, {DIGITS}) AS sig, round(macd - round(sig, {DIGITS}), {DIGITS}) AS hist, max(h) OVER q AS h14, min(l) OVER q AS l14, count(*) OVER q AS n14, CASE WHEN count(c) OVER r = 20 THEN stddev_pop(c) OVER r END AS dev, CASE WHEN count(v) OVER r = 20 THEN avg(v) OVER r END AS vma,
         {", ".join(f"CASE WHEN m.i > {n} THEN max(h) OVER (PARTITION BY m.instrument ORDER BY m.i ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS hi{n}, CASE WHEN m.i > {n} THEN min(l) OVER (PARTITION BY m.instrument ORDER BY m.i ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS lo{n}" for n in LOOKS)}
  FROM m JOIN s ON m.instrument = s.instrument AND m.i = s.i WINDOW q AS (PARTITION BY m.instrument ORDER BY m.i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), r AS (PARTITION BY m.instrument ORDER BY m.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
), y0 AS (SELECT *, CASE WHEN n14 = 14 THEN CASE WHEN h14 > l14 THEN (c - l14) / (h14 - l14) * 100 ELSE 50 END END AS k FROM x), y AS (
  SELECT *, CASE WHEN k IS NOT NULL THEN sum(coalesce(k, 0)) OVER {last(3)} / 3 END AS kd FROM y0
), z AS MATERIALIZED (
  SELECT y.*, regime, {", ".join(f"lag({b}) OVER (PARTITION BY y.instrument ORDER BY y.d) AS {b}_1" for b in BEFORE)} FROM y LEFT JOIN labels ON y.instrument = labels.instrument AND y.d = labels.d
), a AS ({cases})
SELECT instrument, d, strategy, side, round(c - side * mult * atr, 6) AS stop, round(target, 6) AS target, coalesce(twin, FALSE) AS twin FROM a WHERE side IS NOT NULL
"""
