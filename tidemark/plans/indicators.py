"""Indicators on day bars, each as a query with its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.plans.bars import DAY_BARS_SQL, day_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _w(n: int) -> str:
    return f"(PARTITION BY instrument ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


ORD = "(PARTITION BY instrument ORDER BY d)"


def _mean(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN avg({x}) OVER {_w(n)} END"


def _sd(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN stddev_samp({x}) OVER {_w(n)} END"


def rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes if c not in keys])


def _add(name: str, steps: Callable[[], list[dict[str, Column]]], sql_steps: list[dict[str, str]]) -> None:
    """A query of the last step's columns; each step may use those of the steps before."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, made = day_bars(spark, sf_dir), steps()
        for step in made:
            df = df.withColumns(step)
        return rounded(df.select("instrument", "d", *made[-1]), ["instrument", "d"])

    QUERIES[name] = query
    sql, parts = "b0", [f"b0 AS ({DAY_BARS_SQL})"]
    for i, step in enumerate(sql_steps, 1):
        parts.append(f"b{i} AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in step.items())} FROM {sql})")
        sql = f"b{i}"
    shown = [k if k in _LABELS else f"round({k}, 6) AS {k}" for k in sql_steps[-1]]
    ORACLE_SQL[name] = f"WITH {', '.join(parts)} SELECT instrument, d, {', '.join(shown)} FROM {sql}"


#: Columns that aren't doubles.
_LABELS = {"squeeze", "regime", "obv", "day_of_month", "days_left", "turn_of_month", "enough", "crossed", "signal", "trend"}

def _r() -> dict[str, Column]:
    return {"r": w.log_return()}


_R_SQL = {"r": f"ln(c / lag(c) OVER {ORD})"}
def _s() -> dict[str, Column]:
    return {"r": w.simple_return()}


_S_SQL = {"r": f"c / lag(c) OVER {ORD} - 1"}

_add("w1_momentum", lambda: [{"ret1": w.simple_return(), "ret21": w.simple_return(n=21)}], [{"ret1": f"c / lag(c) OVER {ORD} - 1", "ret21": f"c / lag(c, 21) OVER {ORD} - 1"}])
_add("w2_scaled_momentum", lambda: [_r(), {"score": w.scaled_momentum("r", 21)}], [_R_SQL, {"score": f"CASE WHEN count(r) OVER {_w(21)} = 21 THEN sum(r) OVER {_w(21)} END / nullif(stddev_samp(r) OVER {_w(21)} * {math.sqrt(21)}, 0)"}])
_add("w3_blended_score", lambda: [_r(), {"s21": w.scaled_momentum("r", 21), "s63": w.scaled_momentum("r", 63)}, {"score": (F.col("s21") + F.col("s63")) / 2}],
    [_R_SQL, {f"s{n}": f"CASE WHEN count(r) OVER {_w(n)} = {n} THEN sum(r) OVER {_w(n)} END / nullif(stddev_samp(r) OVER {_w(n)} * {math.sqrt(n)}, 0)" for n in (21, 63)}, {"score": "(s21 + s63) / 2"}],
)
_add("w4_trend_slope", lambda: [{"ma": w.mean("c", 50)}, {"slope": F.try_divide(F.col("ma"), F.lag("ma", 5).over(w.ordered())) - 1}], [{"ma": _mean("c", 50)}, {"slope": f"ma / lag(ma, 5) OVER {ORD} - 1"}])
_add("w5_distance_from_mean", lambda: [{"dist": F.try_divide(F.col("c") - w.mean("c", 20), w.sd("c", 20))}], [{"dist": f"(c - ({_mean('c', 20)})) / nullif(({_sd('c', 20)}), 0)"}])
_add("w6_realised_vol", lambda: [_r(), {"vol": w.realised_vol("r", 20)}], [_R_SQL, {"vol": f"({_sd('r', 20)}) * {math.sqrt(252)}"}])
_add("w7_parkinson_vol", lambda: [{"vol": w.parkinson(20)}], [{"x": "power(ln(h / l), 2)"}, {"vol": f"sqrt(({_mean('x', 20)}) / {4 * math.log(2)} * 252)"}])
_K = 0.34 / (1.34 + 21 / 19)
_add("w8_yang_zhang_vol", lambda: [{"vol": w.yang_zhang(20)}],
    [
        {"night": f"ln(o / lag(c) OVER {ORD})", "dayr": "ln(c / o)", "up": "ln(h / o)", "dn": "ln(l / o)"},
        {"rs": "up * (up - dayr) + dn * (dn - dayr)"},
        {"vol": f"CASE WHEN count(night) OVER {_w(20)} = 20 THEN sqrt((var_samp(night) OVER {_w(20)} + {_K} * var_samp(dayr) OVER {_w(20)} + {1 - _K} * avg(rs) OVER {_w(20)}) * 252) END"},
    ],
)
def _flow() -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("c") - F.col("o"), F.col("h") - F.col("l")), F.lit(0.0))))


_add("w9_order_flow", lambda: [{"x": _flow()}, {"flow": w.mean("x", 10)}], [{"x": "greatest(-1.0, least(1.0, coalesce((c - o) / nullif(h - l, 0), 0.0)))"}, {"flow": _mean("x", 10)}])
_TR_SQL = f"greatest(h - l, abs(h - coalesce(lag(c) OVER {ORD}, c)), abs(l - coalesce(lag(c) OVER {ORD}, c)))"
_add("w17_atr_sma", lambda: [{"tr": w.true_range()}, {"atr": w.mean("tr", 14)}], [{"tr": _TR_SQL}, {"atr": _mean("tr", 14)}])
_add("w20_bollinger", lambda: [{"mid": w.mean("c", 20), "s": w.sd("c", 20)}, {"lower": F.col("mid") - 2 * F.col("s"), "upper": F.col("mid") + 2 * F.col("s"), "width": F.try_divide(400 * F.col("s"), F.col("mid"))}],
    [{"mid": _mean("c", 20), "s": _sd("c", 20)}, {"lower": "mid - 2 * s", "upper": "mid + 2 * s", "width": "400 * s / mid"}],
)
_add("w22_squeeze", lambda: [{"tr": w.true_range()}, {"atr": w.mean("tr", 20), "s": w.sd("c", 20)}, {"squeeze": 2 * F.col("s") < 1.5 * F.col("atr")}],
    [{"tr": _TR_SQL}, {"atr": _mean("tr", 20), "s": _sd("c", 20)}, {"squeeze": "2 * s < 1.5 * atr"}],
)
_add("w23_sma", lambda: [{"sma20": w.mean("c", 20), "sma50": w.mean("c", 50), "sma200": w.mean("c", 200)}], [{f"sma{n}": _mean("c", n) for n in (20, 50, 200)}])
_add("w27_stochastic", lambda: [{"hh": w.highest("h", 14), "ll": w.lowest("l", 14)}, {"k": F.try_divide(100 * (F.col("c") - F.col("ll")), F.col("hh") - F.col("ll"))}, {"pct_k": F.col("k"), "pct_d": w.mean("k", 3)}],
    [
        {"hh": f"CASE WHEN count(h) OVER {_w(14)} = 14 THEN max(h) OVER {_w(14)} END", "ll": f"CASE WHEN count(l) OVER {_w(14)} = 14 THEN min(l) OVER {_w(14)} END"},
        {"k": "100 * (c - ll) / nullif(hh - ll, 0)"},
        {"pct_k": "k", "pct_d": _mean("k", 3)},
    ],
)
_add("w30_on_balance_volume", lambda: [
        {"step": F.signum(F.col("c") - F.lag("c").over(w.ordered())).cast("long") * F.col("v"), "many": F.row_number().over(w.ordered())},
        {"obv": F.sum("step").over(w.ordered())},
        {"now": F.sum("obv").over(w.trailing(5)) / 5, "then": F.sum("obv").over(w.ordered().rowsBetween(-19, -15)) / 5},
        {"diff": F.coalesce(F.try_divide(F.col("now") - F.col("then"), F.abs("then")), F.lit(0.0))},
        {"obv": F.col("obv"), "trend": F.when(F.col("many") < 20, "neutral").when(F.col("diff") > 0.03, "accumulation").when(F.col("diff") < -0.03, "distribution").otherwise("neutral")},
    ],
    [
        {"step": f"CAST(sign(c - lag(c) OVER {ORD}) AS BIGINT) * v", "many": f"row_number() OVER {ORD}"},
        {"obv": f"CAST(sum(step) OVER {ORD} AS BIGINT)"},
        {"x": f"sum(obv) OVER {_w(5)} / 5", "y": "sum(obv) OVER (PARTITION BY instrument ORDER BY d ROWS BETWEEN 19 PRECEDING AND 15 PRECEDING) / 5"},
        {"diff": "coalesce((x - y) / nullif(abs(y), 0), 0)"},
        {"obv": "obv", "trend": "CASE WHEN many < 20 THEN 'neutral' WHEN diff > 0.03 THEN 'accumulation' WHEN diff < -0.03 THEN 'distribution' ELSE 'neutral' END"},
    ],
)
_add("w31_volume_ratio", lambda: [{"x": F.col("v").cast("double")}, {"m5": w.mean("x", 5), "m20": w.mean("x", 20)}, {"ratio": F.try_divide(F.col("m5"), F.col("m20")), "trend": F.when(F.col("m5") > F.col("m20") * 1.4, "rising").when(F.col("m5") < F.col("m20") * 0.6, "falling").otherwise("normal")}],
    [{"x": "CAST(v AS DOUBLE)"}, {"m5": _mean("x", 5), "m20": _mean("x", 20)}, {"ratio": "m5 / m20", "trend": "CASE WHEN m5 > m20 * 1.4 THEN 'rising' WHEN m5 < m20 * 0.6 THEN 'falling' ELSE 'normal' END"}],
)
_PRIOR = "(PARTITION BY instrument ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_add("w35_prior_extremes", lambda: [{"hi20": w.prior_high("h", 20), "lo20": w.prior_low("l", 20)}],
    [{"hi20": f"CASE WHEN count(h) OVER {_PRIOR} = 20 THEN max(h) OVER {_PRIOR} END", "lo20": f"CASE WHEN count(l) OVER {_PRIOR} = 20 THEN min(l) OVER {_PRIOR} END"}],
)
_add("w37_ma_trend", lambda: [{"a": w.mean("c", 20), "b": w.mean("c", 50)}, {"trend": w.ma_trend("c", "a", "b")}],
    [{"a": _mean("c", 20), "b": _mean("c", 50)}, {"trend": "CASE WHEN a IS NULL OR b IS NULL THEN 'sideways' WHEN c > a AND a > b THEN 'bullish' WHEN c < a AND a < b THEN 'bearish' WHEN c > b THEN 'mildly bullish' ELSE 'mildly bearish' END"}],
)
_add("w40_information_discreteness", lambda: [_s(), {"neg": (F.col("r") < 0).cast("double"), "pos": (F.col("r") > 0).cast("double"), "total": w.simple_return(n=63)}, {"fip": F.signum("total") * (w.mean("neg", 63) - w.mean("pos", 63))}],
    [_S_SQL, {"neg": "CAST(r < 0 AS DOUBLE)", "pos": "CAST(r > 0 AS DOUBLE)", "total": f"c / lag(c, 63) OVER {ORD} - 1"}, {"fip": f"sign(total) * (({_mean('neg', 63)}) - ({_mean('pos', 63)}))"}],
)
_add("w42_z_score", lambda: [{"z": w.z_score("c", 156, 52)}], [{"z": f"CASE WHEN count(c) OVER {_w(156)} >= 52 THEN (c - avg(c) OVER {_w(156)}) / nullif(stddev_pop(c) OVER {_w(156)}, 0) END"}])
_add("w47_drawdown", lambda: [{"dd": w.drawdown("c")}], [{"dd": f"c / max(c) OVER {ORD} - 1"}])
_add("w50_history_gate", lambda: [{"enough": F.count("c").over(w.ordered()) >= 60}], [{"enough": f"count(c) OVER {ORD} >= 60"}])
_add("w53_year_range", lambda: [{"hi": w.highest("h", 252), "lo": w.lowest("l", 252)}, {"position": F.try_divide(F.col("c") - F.col("lo"), F.col("hi") - F.col("lo")), "ret63": w.simple_return(n=63), "ret252": w.simple_return(n=252)}],
    [
        {"hi": f"CASE WHEN count(h) OVER {_w(252)} = 252 THEN max(h) OVER {_w(252)} END", "lo": f"CASE WHEN count(l) OVER {_w(252)} = 252 THEN min(l) OVER {_w(252)} END"},
        {"position": "(c - lo) / nullif(hi - lo, 0)", "ret63": f"c / lag(c, 63) OVER {ORD} - 1", "ret252": f"c / lag(c, 252) OVER {ORD} - 1"},
    ],
)
def _regime() -> list[dict[str, Column]]:
    """Trend by the slope of a mean of 200 bars over 21, volatility by its place among the last 252; how sure both are, and how much to lean in."""
    return [
        _r(),
        {"vol": w.sd("r", 21), "ma": w.mean("c", 200), "many": F.count("r").over(w.ordered())},
        {"slope": F.try_divide(F.col("ma") - F.lag("ma", 21).over(w.ordered()), 21 * F.col("c")), "rank": w.place_among("vol", 252, 5)},
        {
            "trend": F.when(F.col("slope") > w.EPS, "up").when(F.col("slope") < -w.EPS, "down").otherwise("ranging"),
            "rank": F.when(F.col("many") >= 26, F.col("rank")),
        },
        {"state": F.when(F.col("rank") >= 0.7, "high").when(F.col("rank") <= 0.3, "low").otherwise("normal"), "confidence": w.regime_confidence("slope", "rank")},
        {"regime": F.concat_ws("/", "trend", "state"), "confidence": F.col("confidence"), "aggression": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * F.when(F.col("state") == "high", 0.5).when(F.col("state") == "low", 1.0).otherwise(0.8) * F.when(F.col("trend") == "ranging", 0.5).otherwise(1.0)))},
    ]


_REGIME_SQL = [
    _R_SQL,
    {"vol": f"({_sd('r', 21)})", "ma": _mean("c", 200), "many": f"count(r) OVER {ORD}"},
    {"slope": f"(ma - lag(ma, 21) OVER {ORD}) / (21 * c)", "below": f"list(vol) OVER {_w(252)}"},
    {"rank": "CASE WHEN many >= 26 AND vol IS NOT NULL AND len(list_filter(below, lambda y: y IS NOT NULL)) >= 5 THEN len(list_filter(below, lambda y: y < vol)) * 1.0 / len(list_filter(below, lambda y: y IS NOT NULL)) END"},
    {"trend": "CASE WHEN slope > 0.0005 THEN 'up' WHEN slope < -0.0005 THEN 'down' ELSE 'ranging' END", "state": "CASE WHEN rank >= 0.7 THEN 'high' WHEN rank <= 0.3 THEN 'low' ELSE 'normal' END",
     "tc": "CASE WHEN slope IS NULL THEN 0 WHEN abs(slope) > 0.0005 THEN least(1, (abs(slope) - 0.0005) / 0.0005 + 0.5) ELSE 1 - abs(slope) / 0.0005 END",
     "vc": "CASE WHEN rank IS NULL THEN 0 WHEN rank >= 0.7 THEN least(1, (rank - 0.7) / 0.3) WHEN rank <= 0.3 THEN least(1, (0.3 - rank) / 0.3) ELSE greatest(0, 1 - abs(rank - 0.5) / 0.2) END"},
    {"confidence": "greatest(0, least(1, 0.5 * tc + 0.5 * vc))"},
    {"regime": "trend || '/' || state", "confidence": "confidence", "aggression": "greatest(0, least(1, confidence * CASE state WHEN 'high' THEN 0.5 WHEN 'low' THEN 1 ELSE 0.8 END * CASE WHEN trend = 'ranging' THEN 0.5 ELSE 1 END))"},
]
_add("w13_rule_regime", _regime, _REGIME_SQL)
_add("w18_short_atr", lambda: [{"tr": F.when(F.lag("c").over(w.ordered()).isNotNull(), w.true_range())}, {"atr": F.avg("tr").over(w.trailing(14))}], [{"tr": f"CASE WHEN lag(c) OVER {ORD} IS NOT NULL THEN {_TR_SQL} END"}, {"atr": f"avg(tr) OVER {_w(14)}"}])
_add("w21_band_width", lambda: [{"m": w.mean("c", 20)}, {"width": F.round(F.try_divide(400 * w.full(F.stddev_pop("c").over(w.trailing(20)), F.col("c"), 20), F.col("m")), 2)}], [{"m": _mean("c", 20)}, {"width": f"round(400 * stddev_pop(c) OVER {_w(20)} / m, 2)"}])
_add("w33_fibonacci", lambda: [{"high": F.max("h").over(w.trailing(120)), "low": F.min("l").over(w.trailing(120))}, {f"f{k}": F.round(F.col("high") - (F.col("high") - F.col("low")) * k / 1000, 4) for k in (236, 382, 500, 618, 786)}],
    [{"high": f"max(h) OVER {_w(120)}", "low": f"min(l) OVER {_w(120)}"}, {f"f{k}": f"round(high - (high - low) * {k} / 1000, 4)" for k in (236, 382, 500, 618, 786)}],
)
_add("w41_trend_sign", lambda: [{"sign": F.signum(w.simple_return(n=63))}], [{"sign": f"CAST(sign(c / lag(c, 63) OVER {ORD} - 1) AS DOUBLE)"}])
_add("w44_tail_factors", lambda: [_s(), w.moments("r", 63), {"skew": F.col("skew"), "excess": F.col("excess"), "long": w.tail("skew", "excess", True), "short": w.tail("skew", "excess", False)}],
    [
        _S_SQL,
        {"skew": f"CASE WHEN count(r) OVER {_w(63)} = 63 THEN skewness(r) OVER {_w(63)} END", "excess": f"CASE WHEN count(r) OVER {_w(63)} = 63 THEN kurtosis(r) OVER {_w(63)} END"},
        {"skew": "skew", "excess": "excess", **{k: f"CASE WHEN skew IS NULL THEN 1 ELSE greatest(0.8, least(1.5, abs({z} + skew / 6 * (power({z}, 2) - 1) + excess / 24 * (power({z}, 3) - 3 * {z}) - skew * skew / 36 * (2 * power({z}, 3) - 5 * {z})) / 2.326)) END" for k, z in (("long", "(-2.326)"), ("short", "2.326"))}},
    ],
)
_add("w45_rolling_median", lambda: [{"x": F.col("v").cast("double")}, {"median": w.full(F.percentile("x", F.lit(0.5)).over(w.trailing(60)), F.col("x"), 60)}], [{"x": "CAST(v AS DOUBLE)"}, {"median": f"CASE WHEN count(x) OVER {_w(60)} = 60 THEN median(x) OVER {_w(60)} END"}])
_M_SQL = [_R_SQL, {"mom": f"c / lag(c, 63) OVER {ORD} - 1", "sd63": _sd("r", 63), "sd21": _sd("r", 21), "ma": _mean("c", 50), "x": "power(ln(h / l), 2)"}, {"pvol": f"sqrt(({_mean('x', 21)}) / {4 * math.log(2)} * 252)", "slope": f"(ma - lag(ma, 10) OVER {ORD}) / (10 * c)"}]


def _features() -> list[dict[str, Column]]:
    return [_r(), {"mom": w.simple_return(n=63), "sd63": w.sd("r", 63), "sd21": w.sd("r", 21), "ma": w.mean("c", 50), "pvol": w.parkinson(21)}, {"slope": F.try_divide(F.col("ma") - F.lag("ma", 10).over(w.ordered()), 10 * F.col("c"))}]


_add("m1_feature_frame", lambda: [*_features(), {"mom_21": w.simple_return(n=21), "mom_63": F.col("mom"), "mom_vs": F.try_divide(F.col("mom"), F.col("sd63")), "rvol": F.col("sd21") * math.sqrt(252), "pvol": F.col("pvol"), "slope": F.col("slope"), "dist": F.try_divide(F.try_divide(F.col("c"), F.col("ma")) - 1, F.col("sd21"))}],
    [*_M_SQL, {"mom_21": f"c / lag(c, 21) OVER {ORD} - 1", "mom_63": "mom", "mom_vs": "mom / nullif(sd63, 0)", "rvol": f"sd21 * {math.sqrt(252)}", "pvol": "pvol", "slope": "slope", "dist": "(c / ma - 1) / nullif(sd21, 0)"}],
)
_add("m2_primary_direction", lambda: [*_features(), {"signal": F.when((F.abs("slope") > w.EPS) & (F.signum("mom") == F.signum("slope")) & F.col("sd63").isNotNull(), F.signum("mom").cast("int")).otherwise(0)}],
    [*_M_SQL, {"signal": "CASE WHEN abs(slope) > 0.0005 AND sign(mom) = sign(slope) AND sd63 IS NOT NULL THEN CAST(sign(mom) AS INTEGER) ELSE 0 END"}],
)
_add("t18_held_signal", lambda: [{"z": w.z_score("c", 52, 20), "i": F.row_number().over(w.ordered())}, {"raw": F.when(F.col("z") >= 1.5, -1).when(F.col("z") <= -1.5, 1)}, {"hit": F.last(F.when(F.col("raw").isNotNull(), F.struct("i", "raw")), ignorenulls=True).over(w.ordered())}, {"signal": F.when(F.col("i") - F.col("hit.i") < 10, F.col("hit.raw")).otherwise(0)}],
    [
        {"z": f"CASE WHEN count(c) OVER {_w(52)} >= 20 THEN (c - avg(c) OVER {_w(52)}) / nullif(stddev_pop(c) OVER {_w(52)}, 0) END", "i": f"row_number() OVER {ORD}"},
        {"raw": "CASE WHEN z >= 1.5 THEN -1 WHEN z <= -1.5 THEN 1 END"},
        {"hit": f"last_value(CASE WHEN raw IS NOT NULL THEN i END IGNORE NULLS) OVER {ORD}", "was": f"last_value(raw IGNORE NULLS) OVER {ORD}"},
        {"signal": "CASE WHEN i - hit < 10 THEN was ELSE 0 END"},
    ],
)
_add("w48_month_ordinals", lambda: [
        {"m": F.trunc("d", "MM")},
        {"day_of_month": F.row_number().over(w.Window.partitionBy("instrument", "m").orderBy("d")).cast("long"), "days_left": F.row_number().over(w.Window.partitionBy("instrument", "m").orderBy(F.desc("d"))).cast("long")},
        {"day_of_month": F.col("day_of_month"), "days_left": F.col("days_left"), "turn_of_month": (F.col("day_of_month") <= 3) | (F.col("days_left") <= 1)},
    ],
    [
        {"m": "date_trunc('month', d)"},
        {"a": "row_number() OVER (PARTITION BY instrument, m ORDER BY d)", "b": "row_number() OVER (PARTITION BY instrument, m ORDER BY d DESC)"},
        {"day_of_month": "a", "days_left": "b", "turn_of_month": "a <= 3 OR b <= 1"},
    ],
)
# Strategies whose signals are window expressions.
_add("g22_ma_cross", lambda: [{"a": w.mean("c", 20), "b": w.mean("c", 50)}, {"up": F.col("a") > F.col("b")}, {"crossed": F.when(F.col("up") & ~F.lag("up").over(w.ordered()), 1).when(~F.col("up") & F.lag("up").over(w.ordered()), -1).otherwise(0)}], [{"a": _mean("c", 20), "b": _mean("c", 50)}, {"up": "a > b"}, {"crossed": f"CASE WHEN up AND NOT lag(up) OVER {ORD} THEN 1 WHEN NOT up AND lag(up) OVER {ORD} THEN -1 ELSE 0 END"}])
_add("g22_breakout", lambda: [{"hi": w.prior_high("h", 20), "lo": w.prior_low("l", 20)}, {"signal": F.when(F.col("c") > F.col("hi"), 1).when(F.col("c") < F.col("lo"), -1).otherwise(0)}], [{"hi": f"CASE WHEN count(h) OVER {_PRIOR} = 20 THEN max(h) OVER {_PRIOR} END", "lo": f"CASE WHEN count(l) OVER {_PRIOR} = 20 THEN min(l) OVER {_PRIOR} END"}, {"signal": "CASE WHEN c > hi THEN 1 WHEN c < lo THEN -1 ELSE 0 END"}])
_add("g22_band_reversal", lambda: [{"z": F.try_divide(F.col("c") - w.mean("c", 20), w.sd("c", 20))}, {"signal": F.when(F.col("z") < -2, 1).when(F.col("z") > 2, -1).otherwise(0)}], [{"z": f"(c - ({_mean('c', 20)})) / nullif(({_sd('c', 20)}), 0)"}, {"signal": "CASE WHEN z < -2 THEN 1 WHEN z > 2 THEN -1 ELSE 0 END"}])
_add("g1_gated_momentum", lambda: [_r(), {"score": w.scaled_momentum("r", 21), "ma": w.mean("c", 50)}, {"slope": F.try_divide(F.col("ma"), F.lag("ma", 5).over(w.ordered())) - 1}, {"signal": F.when((F.col("score") > 0.5) & (F.col("slope") > 0), 1).when((F.col("score") < -0.5) & (F.col("slope") < 0), -1).otherwise(0), "p": F.least(F.lit(0.62), F.lit(0.52) + 0.06 * F.abs("score"))}],
    [_R_SQL, {"score": f"CASE WHEN count(r) OVER {_w(21)} = 21 THEN sum(r) OVER {_w(21)} END / nullif(stddev_samp(r) OVER {_w(21)} * {math.sqrt(21)}, 0)", "ma": _mean("c", 50)}, {"slope": f"ma / lag(ma, 5) OVER {ORD} - 1"}, {"signal": "CASE WHEN score > 0.5 AND slope > 0 THEN 1 WHEN score < -0.5 AND slope < 0 THEN -1 ELSE 0 END", "p": "CASE WHEN score IS NULL THEN 0.62 ELSE least(0.62, 0.52 + 0.06 * abs(score)) END"}],
)
