"""Queries of the desk's columns, one row for each setup, with their SQL.

The tables hold no setups, so levels, verdicts and symbols are made of the orders' numbers, by expressions that Spark and the comparison engine both read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import desk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def pick(number: str, values: list[str | None]) -> str:
    """The value of the number modulo their count."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {cases} END"


VERDICTS: list[str | None] = ["STRONG BUY", "BUY", "SELL", "SHORT", "WAIT", "AVOID", "HOLD", None]
_BASE = {
    "id": "o_orderkey",
    "m": "(o_orderkey * 7919 + o_custkey * 104729) % 1000003",
    "w": "(o_orderkey * 31 + o_custkey * 17) % 99991",
    "px": "o_totalprice / 1017.123e0",
    "ts": "o_orderdate",
}
_SETUP = {
    "lo": "px * 0.99e0",
    "hi": "px * 1.01e0",
    "stop": "px * (1 - ((m % 7) - 3) / 50e0)",
    "target": "px * (1 + ((m % 11) - 4) / 40e0)",
    "mark": "px * (1 + ((w % 13) - 6) / 61e0)",
    "scan": "px * (1 + ((w % 9) - 4) / 53e0)",
    "verdict": pick("m", VERDICTS),
    "later": pick("w", ["BUY", "SELL", "WAIT", "CLOSE_TRADE", "HOLD_TRADE", "SCALE_OUT", "TIGHTEN_STOP", "MOVE_TO_BREAKEVEN", "SHORT", "LONG"]),
    "symbol": pick("m", ["EUR/USD", "BTC/USD", "SPY", "XAU/USD", "USD/JPY", "ETH-USD", "BINANCE_BTC_USD", "AAPL", "EUR_GBP", "BRK B!", "GLD", "ABC/XYZ"]),
    "timeframe": pick("w", ["5m", "15m", "1h", "4h", "1d", "1w", "swing trade", "scalp", "odd"]),
    "kind": pick("m", ["forex", "crypto", "equity"]),
    "outcome": pick("m", ["tp_hit", "sl_hit", "expired", "managed", None]),
    "hindsight": pick("w", ["tp_hit", "sl_hit", "", None]),
    "conf": "40 + m % 60",
}
_FRAMES = {
    "setups": "orders",
    "clock": "events",
}


def _lines(columns: dict[str, str]) -> list[str]:
    return [f"{x} AS {k}" for k, x in columns.items()]


def setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*_lines(_BASE)).selectExpr("*", *_lines(_SETUP))


SETUPS_SQL = f"setups AS (SELECT *, {', '.join(_lines(_SETUP))} FROM (SELECT {', '.join(_lines(_BASE))} FROM orders))"


def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), "ts", F.expr(pick("event_id", ["forex", "crypto", "equity"])).alias("kind"))


CLOCK_SQL = f"clock AS (SELECT event_id AS id, ts, {pick('event_id', ['forex', 'crypto', 'equity'])} AS kind FROM events)"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _add(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], made: dict[str, str] | None = None, frame: str = "setups") -> None:
    """A query of columns of a frame; made: further columns of the frame; numbers (n:...) in the SQL are rounded."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = setups(spark, sf_dir) if frame == "setups" else clock(spark, sf_dir)
        if made:
            df = df.selectExpr("*", *_lines(made))
        return _shown(df.select("id", *[c.alias(k) for k, c in columns().items()]))

    QUERIES[name] = query
    source = f"(SELECT *, {', '.join(_lines(made))} FROM {frame})" if made else frame
    shown = [f"round({x.removeprefix('n:')}, 6) AS {k}" if x.startswith("n:") else f"{x} AS {k}" for k, x in sql.items()]
    ORACLE_SQL[name] = f"WITH {SETUPS_SQL if frame == 'setups' else CLOCK_SQL} SELECT id, {', '.join(shown)} FROM {source}"


def _c(name: str) -> Column:
    return F.col(name)


def _list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_UP = "upper(coalesce(verdict, ''))"
_DIR = f"CASE WHEN {_UP} LIKE '%BUY%' THEN 'long' WHEN {_UP} LIKE '%SELL%' OR {_UP} LIKE '%SHORT%' THEN 'short' ELSE 'neutral' END"
_LATER = _DIR.replace("verdict", "later")
_KIND = f"CASE WHEN regexp_matches({_UP}, 'BUY|SELL|SHORT|LONG') THEN 'trade' WHEN regexp_matches({_UP}, 'AVOID|REDUCE|HEDGE') THEN 'avoid' ELSE 'watch' END"


def _dist(price: str) -> str:
    return f"CASE WHEN {price} >= lo AND {price} <= hi THEN 0 ELSE abs({price} - CASE WHEN {price} < lo THEN lo ELSE hi END) / abs({price}) * 100 END"


# Symbols.
_BASE_LEG = "upper(split_part(symbol, '/', 1))"
_add("f2_tickers", lambda: {"ticker": desk.ticker(_c("symbol"))}, {"ticker": f"CASE WHEN symbol LIKE '%/%' AND {_BASE_LEG} IN {_list(desk.COINS)} THEN {_BASE_LEG} || '-' || upper(split_part(symbol, '/', 2)) WHEN symbol LIKE '%/%' THEN replace(symbol, '/', '') || '=X' ELSE symbol END"})
_add("p6_asset_class", lambda: {"symbol": _c("symbol"), "class": desk.asset_class(_c("symbol"))},
    {"symbol": "symbol", "class": "CASE symbol WHEN 'EUR/USD' THEN 'forex' WHEN 'BTC/USD' THEN 'crypto' WHEN 'XAU/USD' THEN 'forex' WHEN 'USD/JPY' THEN 'forex' WHEN 'ETH-USD' THEN 'crypto' WHEN 'BINANCE_BTC_USD' THEN 'crypto' WHEN 'EUR_GBP' THEN 'forex' ELSE 'equity' END"},
)
_add("p24_taxonomy", lambda: {"label": desk.taxonomy(_c("symbol"), _c("label"))},
    {"label": f"CASE WHEN upper(symbol) IN {_list(desk.FUNDS)} THEN 'ETF' WHEN symbol LIKE '%/%' AND {_BASE_LEG} IN {_list(desk.RELABELLED)} THEN 'Crypto' WHEN regexp_matches(symbol, '^[A-Za-z]{{3}}/[A-Za-z]{{3}}$') THEN 'Forex' WHEN label = 'Equity' AND symbol NOT LIKE '%/%' THEN 'Stock' ELSE label END".replace("{{", "{").replace("}}", "}")},
    {"label": pick("w", ["Equity", "Stock", "Other"])},
)
_add("s2_slugs", lambda: {"slug": desk.slug(_c("symbol"))}, {"slug": "regexp_replace(symbol, '[^A-Za-z0-9.-]+', '_', 'g')"})
# Verdicts and levels.
_RR = "CASE WHEN abs(px - stop) > 0 THEN abs(target - px) / abs(px - stop) END"
_add("f5_reward_risk", lambda: {"ratio": desk.reward_risk(_c("px"), _c("stop"), _c("target")), "weak": desk.reward_risk(_c("px"), _c("stop"), _c("target")) < 1.49, "strong": desk.reward_risk(_c("px"), _c("stop"), _c("target")) >= 2.99}, {"ratio": f"n:{_RR}", "weak": f"{_RR} < 1.49", "strong": f"{_RR} >= 2.99"})
_add("f6_verdicts", lambda: {"direction": desk.direction(_c("verdict")), "kind": desk.verdict_kind(_c("verdict"))}, {"direction": _DIR, "kind": _KIND})
_CLOSE = " AND ".join(f"coalesce(abs({a} - {b}) / CASE WHEN abs({a}) > 0 THEN abs({a}) ELSE 1 END <= 0.02, true)" for a, b in (("px", "scan"), ("stop", "stop2"), ("target", "target")))
_add("f7_same_setup", lambda: {"close": desk.levels_close([(_c("px"), _c("scan")), (_c("stop"), _c("stop2")), (_c("target"), _c("target"))]), "same": (desk.direction(_c("verdict")) == desk.direction(_c("later"))) & (_c("today") | desk.levels_close([(_c("px"), _c("scan")), (_c("stop"), _c("stop2")), (_c("target"), _c("target"))]))},
    {"close": _CLOSE, "same": f"({_DIR}) = ({_LATER}) AND (today OR ({_CLOSE}))"}, {"stop2": "CASE WHEN w % 4 = 0 THEN NULL ELSE stop * (1 + (w % 5) / 131e0) END", "today": "m % 3 = 0"},
)


def _f8() -> dict[str, Column]:
    now, then = (desk.distance_to_zone(_c("lo"), _c("hi"), _c(p)) for p in ("mark", "scan"))
    moved = desk.approach(now, then)
    return {"pct": now, "moved": moved, "status": desk.entry_status(_c("verdict"), now, moved)}


_MOVED = f"CASE WHEN abs(({_dist('mark')}) - ({_dist('scan')})) < 0.1 THEN 'flat' WHEN ({_dist('mark')}) < ({_dist('scan')}) THEN 'closer' ELSE 'further' END"
_add("f8_proximity", _f8,
    {"pct": f"n:{_dist('mark')}", "moved": _MOVED, "status": f"CASE ({_KIND}) WHEN 'avoid' THEN 'avoid' WHEN 'watch' THEN CASE WHEN mark BETWEEN lo AND hi THEN 'watch-hit' ELSE 'watch' END ELSE CASE WHEN mark BETWEEN lo AND hi THEN 'live' WHEN ({_MOVED}) = 'closer' THEN 'approaching' WHEN ({_MOVED}) = 'further' THEN 'drifting' ELSE 'waiting' END END"},
)
_add("f9_row_time", lambda: {"seconds": desk.row_seconds(_c("created"), _c("row_id"), F.to_date("ts"))},
    {"seconds": "n:coalesce(epoch(try_cast(created AS TIMESTAMP)), try_cast(regexp_extract(row_id, '_([0-9]{10,})$', 1) AS DOUBLE) / 1000, epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)))"},
    {"created": pick("m", ["2024-05-06T07:08:09", "no time", None]), "row_id": "CASE WHEN w % 4 = 0 THEN 'x_12' ELSE concat('EURUSD_', CAST(1600000000000 + m AS STRING)) END"},
)
_add("f10_styles", lambda: {"style": desk.style(_c("timeframe"))}, {"style": "CASE WHEN regexp_matches(lower(timeframe), '15m|5m|min|scalp') THEN 'scalp' WHEN regexp_matches(lower(timeframe), '1h|4h|hour|intraday') THEN 'intraday' WHEN regexp_matches(lower(timeframe), '1d|day|swing') THEN 'swing' WHEN regexp_matches(lower(timeframe), '1w|week|position') THEN 'position' END"})
_add("f12_json_in_text", lambda: {"found": desk.json_in(_c("answer"))}, {"found": "CASE m % 5 WHEN 1 THEN '{\"a\": 5}' WHEN 2 THEN '[1, 2, 3]' WHEN 4 THEN '[{\"k\": 7}]' END"},
    {"answer": "CASE m % 5 WHEN 0 THEN 'no json' WHEN 1 THEN 'x {\"a\": 5} y' WHEN 2 THEN 'so: ```json [1, 2, 3] ``` and' WHEN 3 THEN 'bad [1, {\"k\": 7} end' ELSE '[{\"k\": 7}] tail' END".replace("bad [1, {\"k\": 7} end", "bad [1, {k 7} end")},
)
_add("f13_stripped", lambda: {"bare": desk.stripped(_c("page"))}, {"bare": "'a & b ' || CAST(m AS STRING) || ' <c>'"}, {"page": "concat('<p>a &amp; b ', CAST(m AS STRING), '</p><!-- x <b> --> &lt;c&gt; ')"})
_add("f14_texts", lambda: {"price": desk.price_text(_c("v"), _c("type")), "percent": desk.percent_text(_c("v") - 300.0171), "volume": desk.volume_text(_c("v") * 731.0)},
    {
        "price": "CASE WHEN type = 'Forex' THEN printf('%.5f', v) WHEN v >= 10000 THEN format('{:,.2f}', v) WHEN v >= 100 THEN printf('%.2f', v) ELSE printf('%.4f', v) END",
        "percent": "CASE WHEN v - 300.0171 >= 0 THEN '+' ELSE '' END || printf('%.2f', v - 300.0171) || '%'",
        "volume": "CASE WHEN v * 731.0 >= 1e9 THEN printf('%.1fB', v * 731.0 / 1e9) WHEN v * 731.0 >= 1e6 THEN printf('%.1fM', v * 731.0 / 1e6) WHEN v * 731.0 >= 1e3 THEN printf('%.1fK', v * 731.0 / 1e3) ELSE CAST(CAST(floor(v * 731.0 + 0.5) AS BIGINT) AS STRING) END",
    },
    {"v": "CASE m % 3 WHEN 0 THEN px * 1.0371231e0 WHEN 1 THEN px * 103.7123171e0 ELSE px * 0.0103711e0 END", "type": pick("w", ["Forex", "Stock"])},
)
_add("f15_features", lambda: {"rsi": F.round(desk.clamp(_c("x") / 100), 3), "adx": F.round(desk.clamp(_c("x") / 60), 3), "past": F.round(desk.clamp((_c("mark") / _c("px") - 1) * 5 + 0.5), 3)},
    {"rsi": "n:round(greatest(0, least(1, x / 100)), 3)", "adx": "n:round(greatest(0, least(1, x / 60)), 3)", "past": "n:round(greatest(0, least(1, (mark / px - 1) * 5 + 0.5)), 3)"}, {"x": "(m % 1300) / 10.13e0 - 9"},
)
_ACC = "(px - scan) / ((mark + target) / 2)"
_add("f18_accruals", lambda: {"ratio": (_c("px") - _c("scan")) / ((_c("mark") + _c("target")) / 2), "flag": desk.banded((_c("px") - _c("scan")) / ((_c("mark") + _c("target")) / 2), [(-0.05, "CONSERVATIVE"), (0.0500001, "NORMAL")], "HIGH_ACCRUALS")}, {"ratio": f"n:{_ACC}", "flag": f"CASE WHEN {_ACC} > 0.05 THEN 'HIGH_ACCRUALS' WHEN {_ACC} < -0.05 THEN 'CONSERVATIVE' ELSE 'NORMAL' END"})
_add("f20_quality_flags", lambda: {"flags": F.array_join(F.array_compact(F.array(F.when(_c("score") >= 7, "strong").when(_c("score") <= 3, "weak"), F.when(_c("w") % 5 == 0, "manipulation"), F.when(_c("w") % 3 == 0, "accruals"), F.when(_c("zone") == "distress", "distress").when(_c("zone") == "grey", "grey"))), ",")},
    {"flags": "concat_ws(',', CASE WHEN score >= 7 THEN 'strong' WHEN score <= 3 THEN 'weak' END, CASE WHEN w % 5 = 0 THEN 'manipulation' END, CASE WHEN w % 3 = 0 THEN 'accruals' END, CASE WHEN zone IN ('distress', 'grey') THEN zone END)"}, {"score": "m % 10", "zone": pick("w", ["safe", "grey", "distress", None])},
)
_add("f21_macro_labels", lambda: {"curve": desk.curve_label(_c("spread")), "credit": desk.credit_label(_c("oas")), "fear": desk.fear_label(_c("vix")), "dollar": desk.dollar_label(_c("dxy"))},
    {
        "curve": "CASE WHEN spread < -0.75 THEN 'deeply inverted' WHEN spread < 0 THEN 'inverted' WHEN spread < 0.3 THEN 'flat' WHEN spread < 1 THEN 'normal' ELSE 'steep' END",
        "credit": "CASE WHEN floor(oas * 100 + 0.5) < 250 THEN 'benign' WHEN floor(oas * 100 + 0.5) < 350 THEN 'slightly elevated' WHEN floor(oas * 100 + 0.5) < 500 THEN 'elevated' ELSE 'distressed' END",
        "fear": "CASE WHEN vix < 12 THEN 'extreme complacency' WHEN vix < 18 THEN 'calm' WHEN vix < 25 THEN 'normal' WHEN vix < 35 THEN 'elevated fear' ELSE 'extreme fear' END",
        "dollar": "CASE WHEN dxy > 108 THEN 'very strong' WHEN dxy > 103 THEN 'strong' WHEN dxy > 97 THEN 'neutral' WHEN dxy > 91 THEN 'weak' ELSE 'very weak' END",
    },
    {"spread": "(m % 400 - 150) / 97e0", "oas": "(m % 700) / 101e0", "vix": "(m % 500) / 9.7e0", "dxy": "85 + (w % 300) / 9.9e0"},
)
_add("f22_bond_equity", lambda: {"sign": F.when((_c("mark") > _c("px")) == (_c("scan") > _c("px")), "positive").otherwise("negative")}, {"sign": "CASE WHEN (mark > px) = (scan > px) THEN 'positive' ELSE 'negative' END"})
_add("f25_broker_clock", lambda: {"utc": _c("stamp") - (_c("hours") * 3600).cast("bigint")}, {"utc": "stamp - hours * 3600"}, {"stamp": "1600000000 + m", "hours": "w % 4"})
_add("f26_lots", lambda: {"units": F.round(_c("lots") * desk.lot_units(_c("kind")), 2), "back": F.round(_c("lots") * desk.lot_units(_c("kind")) / desk.lot_units(_c("kind")), 2)}, {"units": "n:round(lots * CASE WHEN kind = 'forex' THEN 100000 ELSE 1 END, 2)", "back": "n:round(lots, 2)"}, {"lots": "(m % 1000) / 100e0"})
_DIV = "(mark / px - 1) * 10000"
_add("f27_divergence", lambda: {"bps": (_c("mark") / _c("px") - 1) * 10000, "cost": F.when(_c("m") % 2 == 0, 1.0).otherwise(-1.0) * (_c("mark") / _c("px") - 1) * 10000}, {"bps": f"n:{_DIV}", "cost": f"n:CASE WHEN m % 2 = 0 THEN 1 ELSE -1 END * {_DIV}"})
_LONG = "m % 2 = 0"
_TP = f"(goal > 0 AND CASE WHEN {_LONG} THEN shut >= goal - shut * 0.0002 ELSE shut <= goal + shut * 0.0002 END)"
_SL = f"(halt > 0 AND CASE WHEN {_LONG} THEN shut <= halt + shut * 0.0002 ELSE shut >= halt - shut * 0.0002 END)"
_EXIT = {
    "shut": "CASE w % 6 WHEN 0 THEN target WHEN 1 THEN stop * 1.0001e0 WHEN 2 THEN mark WHEN 3 THEN 0e0 WHEN 4 THEN px * 1.0003e0 ELSE scan END",
    "halt": "CASE w % 5 WHEN 0 THEN 0e0 WHEN 1 THEN px * 1.0003e0 ELSE stop END",
    "goal": "CASE w % 7 WHEN 0 THEN 0e0 ELSE target END",
    "gain": "(w % 3) - 1",
}
_add("f28_exit_kind", lambda: {"kind": desk.exit_kind(_c("m") % 2 == 0, _c("shut"), _c("halt"), _c("goal"))}, {"kind": f"CASE WHEN shut <= 0 THEN 'managed' WHEN {_TP} THEN 'tp_hit' WHEN {_SL} THEN 'sl_hit' ELSE 'managed' END"}, _EXIT)
_add("f36_exit_reason", lambda: {"reason": desk.exit_reason(_c("m") % 2 == 0, _c("px"), _c("shut"), _c("halt"), _c("goal"), _c("gain"))}, {"reason": f"CASE WHEN shut <= 0 THEN 'closed' WHEN {_TP} THEN 'target' WHEN {_SL} THEN CASE WHEN abs(halt - px) <= px * 0.0005 THEN 'breakeven' WHEN gain > 0 THEN 'trailing' ELSE 'stop' END ELSE 'manual' END"}, _EXIT)
_add("f29_ticks", lambda: {"price": F.round(F.round(_c("px") / _c("tick")) * _c("tick"), 10)}, {"price": "n:round(px / tick) * tick"}, {"tick": "CASE m % 3 WHEN 0 THEN 0.01e0 WHEN 1 THEN 0.05e0 ELSE 0.25e0 END"})


def _f30() -> dict[str, Column]:
    level, reached, left = desk.ladder(_c("m") % 2 == 0, _c("px"), _c("stop"), _c("mark"))
    return {"level": level, "reached": reached, "left_over": left}


_LEVEL = f"CASE WHEN abs(px - stop) > 0 THEN CASE WHEN {_LONG} THEN px + abs(px - stop) ELSE px - abs(px - stop) END END"
_LEFT = f"CASE WHEN {_LONG} THEN ({_LEVEL}) - mark ELSE mark - ({_LEVEL}) END"
_add("f30_ladder", _f30, {"level": f"n:{_LEVEL}", "reached": f"({_LEFT}) <= 0", "left_over": f"n:CASE WHEN ({_LEFT}) > 0 THEN {_LEFT} END"})
_add("f31_funding", lambda: {"pct": F.round(_c("rate") * 100, 4), "yearly": F.round(_c("rate") * 3 * 365 * 100, 1), "label": desk.funding_label(_c("rate") * 100)}, {"pct": "n:round(rate * 100, 4)", "yearly": "n:round(rate * 3 * 365 * 100, 1)", "label": "CASE WHEN rate * 100 > 0.03 THEN 'crowded long' WHEN rate * 100 < -0.01 THEN 'crowded short' ELSE 'neutral' END"}, {"rate": "((m % 200) - 80) / 99700e0"})


def _poly(x: str, factors: tuple[float, ...]) -> str:
    out = f"({factors[0]!r}::DOUBLE)"
    for f in factors[1:]:
        out = f"({out} * {x} + ({f!r}::DOUBLE))"
    return out


def inverse_normal_sql(p: str) -> str:
    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    tail = lambda x: f"{_poly(x, desk.NORMAL_C)} / {_poly(x, desk.NORMAL_D)}"
    middle = f"{_poly(f'({q} * {q})', desk.NORMAL_A)} * {q} / {_poly(f'({q} * {q})', desk.NORMAL_B)}"
    return f"(CASE WHEN {p} < {desk.NORMAL_TAIL} THEN {tail(low)} WHEN {p} <= 1 - {desk.NORMAL_TAIL} THEN {middle} ELSE -({tail(high)}) END)"


_add("f34_inverse_normal", lambda: {"z": desk.inverse_normal(_c("p"))}, {"z": f"n:{inverse_normal_sql('p')}"}, {"p": "(m % 9999 + 0.5e0) / 10000e0"})
_add("f35_config_key", lambda: {"key": desk.config_key(F.when(_c("m") % 2 == 0, F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), (_c("w") % 5).cast("string"))).otherwise(F.create_map(F.lit("a"), (_c("w") % 5).cast("string"), F.lit("b"), F.lit("x"))))}, {"key": "'{\"a\":\"' || CAST(w % 5 AS STRING) || '\",\"b\":\"x\"}'"})
_TO_TARGET, _TO_STOP = "(mark - px) / nullif(target - px, 0)", "(mark - px) / nullif(stop - px, 0)"
_KNOWN = f"({_DIR}) <> 'neutral' AND target <> px AND stop <> px"
_AHEAD = f"({_TO_TARGET} >= 0 AND {_TO_TARGET} >= {_TO_STOP})"
_add("f37_progress", lambda: dict(zip(("pct", "toward"), desk.progress(_c("verdict"), _c("px"), _c("stop"), _c("target"), _c("mark")), strict=True)),
    {"pct": f"CAST(CASE WHEN {_KNOWN} THEN CASE WHEN {_AHEAD} THEN floor(greatest(0, least(1, {_TO_TARGET})) * 100 + 0.5) WHEN {_TO_STOP} > 0 THEN floor(greatest(0, least(1, {_TO_STOP})) * 100 + 0.5) ELSE 0 END END AS BIGINT)", "toward": f"CASE WHEN {_KNOWN} THEN CASE WHEN NOT {_AHEAD} AND {_TO_STOP} > 0 THEN 'stop' ELSE 'target' END END"},
)
_add("f38_assessment", lambda: {"assessment": desk.assessment(_c("verdict"), _c("later"))},
    {"assessment": f"CASE later WHEN 'HOLD_TRADE' THEN 'confirmed' WHEN 'TIGHTEN_STOP' THEN 'confirmed' WHEN 'MOVE_TO_BREAKEVEN' THEN 'weakening' WHEN 'SCALE_OUT' THEN 'weakening' WHEN 'CLOSE_TRADE' THEN 'invalidated' ELSE CASE WHEN ({_DIR}) = 'neutral' THEN CASE WHEN ({_LATER}) <> 'neutral' THEN 'activated' ELSE 'still-waiting' END WHEN ({_LATER}) = ({_DIR}) THEN 'confirmed' WHEN ({_LATER}) = 'neutral' THEN 'weakening' ELSE 'invalidated' END END"},
)
_H, _DAY = "(hour(ts) + minute(ts) / 60.0)", "(isodow(ts) - 1)"
_SHUT = f"({_DAY} = 5 OR {_DAY} = 6 AND {_H} < 22 OR {_DAY} = 4 AND {_H} >= 22)"
_PEAK = f"({_H} >= 13 AND {_H} < 18)"
_add("f39_market_session", lambda: dict(zip(("session", "liquidity"), desk.market_session(_c("kind"), _c("ts")), strict=True)),
    {
        "session": f"CASE kind WHEN 'crypto' THEN CASE WHEN {_H} >= 7 AND {_H} < 12 THEN 'London' WHEN {_H} >= 12 AND {_H} < 21 THEN 'US' WHEN {_H} < 9 THEN 'Asian' ELSE 'off-peak' END || CASE WHEN {_PEAK} THEN ' peak' ELSE '' END WHEN 'forex' THEN CASE WHEN {_SHUT} THEN 'closed' WHEN {_H} >= 12 AND {_H} < 16 THEN 'overlap' WHEN {_H} >= 7 AND {_H} < 16 THEN 'London' WHEN {_H} >= 12 AND {_H} < 21 THEN 'New York' ELSE 'Asian' END ELSE CASE WHEN {_DAY} >= 5 THEN 'closed' WHEN {_H} < 14.5 THEN 'pre-market' WHEN {_H} >= 21 THEN 'after-hours' WHEN {_H} < 15.5 THEN 'open' WHEN {_H} >= 16.5 AND {_H} < 19 THEN 'midday' WHEN {_H} >= 20 THEN 'power hour' ELSE 'mid-session' END END",
        "liquidity": f"CASE kind WHEN 'crypto' THEN CASE WHEN {_DAY} >= 5 THEN 'thin' WHEN {_PEAK} THEN 'high' ELSE 'normal' END WHEN 'forex' THEN CASE WHEN {_SHUT} THEN 'closed' WHEN {_H} >= 12 AND {_H} < 16 THEN 'peak' WHEN {_H} >= 7 AND {_H} < 16 THEN 'high' WHEN {_H} >= 12 AND {_H} < 21 THEN 'moderate' ELSE 'low' END ELSE CASE WHEN {_DAY} >= 5 THEN 'closed' WHEN {_H} < 14.5 OR {_H} >= 21 THEN 'thin' WHEN {_H} < 15.5 THEN 'high' WHEN {_H} >= 16.5 AND {_H} < 19 THEN 'low' WHEN {_H} >= 20 THEN 'high' ELSE 'moderate' END END",
    },
    frame="clock",
)
_add("p18_trading_hours", lambda: {"open": desk.trading_hours(_c("kind"), _c("ts")), "london_new_york": desk.london_new_york(_c("ts"))},
    {"open": f"CASE WHEN kind = 'crypto' THEN true WHEN {_DAY} >= 5 THEN false WHEN kind = 'forex' THEN true ELSE hour(ts) * 60 + minute(ts) BETWEEN 810 AND 1200 END", "london_new_york": f"{_DAY} < 5 AND hour(ts) >= 8 AND hour(ts) < 21"}, frame="clock",
)
_add("f40_position_size", lambda: {"units": desk.units_from_risk(F.lit(10000.0), F.lit(0.01), F.abs(_c("px") - _c("stop"))), "value": desk.units_from_risk(F.lit(10000.0), F.lit(0.01), F.abs(_c("px") - _c("stop"))) * _c("px"), "reward": desk.units_from_risk(F.lit(10000.0), F.lit(0.01), F.abs(_c("px") - _c("stop"))) * F.abs(_c("target") - _c("px"))},
    {k: f"n:CASE WHEN abs(px - stop) > 0 THEN 100 / abs(px - stop) * {x} ELSE 0 END" for k, x in {"units": "1", "value": "px", "reward": "abs(target - px)"}.items()},
)
_add("f41_r_multiple", lambda: {"r": desk.r_multiple(F.when(_c("m") % 2 == 0, 1).otherwise(-1), _c("px"), _c("stop"), _c("mark"))}, {"r": "n:CASE WHEN abs(px - stop) > 0 THEN CASE WHEN m % 2 = 0 THEN 1 ELSE -1 END * (mark - px) / abs(px - stop) END"})
_PAD = "((hi - lo) * 0.001 + abs(hi) * 0.0015)"
_add("f42_watchlist", lambda: {"status": desk.watch_status(_c("verdict"), _c("halt"), _c("goal"), _c("lo"), _c("hi"), _c("now")), "alert": desk.alert_reached(_c("mark"), _c("px"), _c("side"))},
    {
        "status": f"CASE WHEN now IS NULL THEN 'pending' WHEN CASE WHEN ({_DIR}) = 'short' THEN now >= halt ELSE now <= halt END THEN 'stopped' WHEN CASE WHEN ({_DIR}) = 'short' THEN now <= goal ELSE now >= goal END THEN 'target' WHEN now >= lo - {_PAD} AND now <= hi + {_PAD} THEN 'inzone' ELSE 'pending' END",
        "alert": "CASE WHEN side = 'above' THEN mark <= px WHEN side = 'below' THEN mark >= px ELSE abs(mark - px) / abs(px) < 0.002 END",
    },
    {"halt": "CASE w % 3 WHEN 0 THEN NULL ELSE stop END", "goal": "CASE w % 5 WHEN 0 THEN NULL ELSE target END", "now": "CASE w % 11 WHEN 0 THEN NULL ELSE mark END", "side": pick("w", ["above", "below", None])},
)
# Sizes.
_add("x2_vol_target", lambda: {"notional": desk.vol_target_notional(F.lit(10000.0), F.lit(0.1), _c("vol")), "units": desk.units_from_risk(F.lit(10000.0), F.lit(0.01), _c("px") - _c("stop"))}, {"notional": "n:CASE WHEN vol > 0 THEN 1000 / vol ELSE 0 END", "units": "n:CASE WHEN px - stop > 0 THEN 100 / (px - stop) ELSE 0 END"}, {"vol": "((m % 50) - 5) / 97e0"})
_DOWN = "round(floor(v / 0.01) * 0.01, 10)"
_add("x3_lot_steps", lambda: {"lots": desk.lots(_c("v"))}, {"lots": f"n:CASE WHEN v > 0 AND {_DOWN} >= 0.01 - 1e-9 THEN round({_DOWN}, 2) ELSE 0 END"}, {"v": "((m % 3000) - 200) / 1237e0"})
_add("x9_learned", lambda: {"won": desk.learned(_c("outcome"), _c("hindsight")), "quality": desk.exit_quality(_c("outcome"), _c("hindsight"))},
    {"won": "CASE WHEN outcome = 'tp_hit' THEN true WHEN outcome = 'sl_hit' THEN false WHEN hindsight = 'tp_hit' THEN true WHEN hindsight = 'sl_hit' THEN false END", "quality": "CASE WHEN outcome IN ('tp_hit', 'sl_hit') THEN NULL WHEN hindsight = 'sl_hit' THEN 'good' WHEN hindsight = 'tp_hit' THEN 'premature' END"},
)
_add("x10_day_loss", lambda: {"loss": desk.day_loss(_c("px"), _c("mark")), "breached": desk.day_loss(_c("px"), _c("mark")) >= 0.05}, {"loss": "n:CASE WHEN px > 0 THEN greatest(0, 1 - mark / px) ELSE 0 END", "breached": "greatest(0, 1 - mark / px) >= 0.05"})


def _x11() -> dict[str, Column]:
    side, p = desk.sentiment_damped(_c("side"), _c("p"), _c("score"), _c("trust"))
    return {"side": side.cast("bigint"), "p": p}


_AGAINST = "(-side * score * greatest(0, least(1, trust)))"
_add("x11_sentiment", _x11,
    {"side": f"CASE WHEN side <> 0 AND score IS NOT NULL AND {_AGAINST} >= 0.6 THEN 0 ELSE side END", "p": f"n:CASE WHEN side <> 0 AND {_AGAINST} >= 0.6 THEN 0.5 WHEN side <> 0 AND {_AGAINST} >= 0.3 THEN p - ({_AGAINST} - 0.3) / 0.3 * (p - 0.5) ELSE p END"},
    {"side": "CAST((m % 3) - 1 AS BIGINT)", "p": "0.5e0 + (m % 17) / 71e0", "score": "CASE w % 9 WHEN 0 THEN NULL ELSE ((w % 21) - 10) / 10.3e0 END", "trust": "(w % 14) / 11.7e0"},
)
_MIN = "CASE timeframe WHEN '5m' THEN 5 WHEN '15m' THEN 15 WHEN '1h' THEN 60 WHEN '4h' THEN 240 END"
_add("x13_bars_per_year", lambda: {"bars": desk.bars_per_year(_c("kind"), _c("timeframe"))},
    {"bars": f"n:CASE WHEN timeframe = '1w' THEN CASE WHEN kind = 'crypto' THEN 365 / 7.0 ELSE 52 END WHEN ({_MIN}) IS NULL THEN CASE WHEN kind = 'crypto' THEN 365 ELSE 252 END WHEN kind = 'crypto' THEN 1440 / ({_MIN}) * 365 WHEN kind = 'forex' THEN 1440 / ({_MIN}) * 5 * 52.14 ELSE 390 / ({_MIN}) * 252 END"},
)
_add("a21_drawdown_zone", lambda: {"zone": desk.drawdown_zone(_c("dd"), _c("w") % 19 == 0, 0.1, 0.2)}, {"zone": "CASE WHEN w % 19 = 0 THEN 'HALTED' WHEN dd IS NULL THEN 'UNKNOWN' WHEN dd >= 0.2 THEN 'BREAKER' WHEN dd >= 0.1 THEN 'REDUCING' ELSE 'OK' END"}, {"dd": "CASE w % 7 WHEN 0 THEN NULL ELSE (m % 30) / 101e0 END"})
_add("a19_shrunk_confidence", lambda: {"conf": desk.clamp(desk.whole(_c("n") / (_c("n") + 12) * _c("acc") + (1 - _c("n") / (_c("n") + 12)) * _c("conf")).cast("double"), 1, 99)}, {"conf": "n:greatest(1, least(99, floor(n / (n + 12) * acc + (1 - n / (n + 12)) * conf + 0.5)))"}, {"n": "(w % 40) * 1e0", "acc": "(m % 101) * 1.003e0"})
_add("v2_expected_best", lambda: {"best": desk.expected_best(_c("sd"), _c("trials"))},
    {"best": f"n:CASE WHEN trials > 1 AND sd > 0 THEN sd * ((1 - 0.5772156649015329) * {inverse_normal_sql('(1 - 1 / trials)')} + 0.5772156649015329 * {inverse_normal_sql('(1 - 1 / (trials * 2.718281828459045))')}) ELSE 0 END"}, {"sd": "(m % 90) / 991e0", "trials": "1e0 + w % 800"},
)
