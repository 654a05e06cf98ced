"""Columns of the trading desk: readings of symbols and verdicts, levels and sizes, labels of markets and of exits.

All are built-in expressions but for printed numbers (``printed``). A null input makes the result null unless a docstring says otherwise; whole-number percentages round halves up.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Currencies, metals and coins by which symbols are read.
FIAT = ("EUR", "USD", "GBP", "JPY", "AUD", "NZD", "CAD", "CHF", "XAU", "XAG")
COINS = ("BTC", "ETH", "SOL", "XRP", "ADA", "DOGE", "BNB", "LTC", "DOT", "AVAX", "LINK", "MATIC", "BCH", "ATOM", "ETC", "XLM", "ARB", "SUI")
#: Those that the correction of labels knows, fewer.
RELABELLED = ("BTC", "ETH", "SOL", "BNB", "XRP", "ADA", "AVAX", "DOGE", "MATIC", "LINK", "ARB", "SUI")
FUNDS = ("SPY", "QQQ", "IWM", "GLD", "SLV", "USO", "TLT", "HYG", "LQD", "XLF", "XLE", "XLK", "XLV", "XLI", "XLC", "ARKK", "VTI", "VOO", "VNQ", "EEM", "EFA", "GDX", "GDXJ", "XBI", "IBB", "DIA", "SMH", "SOXX")

#: Coefficients of the published rational approximation of the inverse normal distribution (fixed values).
NORMAL_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
NORMAL_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
NORMAL_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
NORMAL_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
NORMAL_TAIL = 0.02425


def whole(x: Column) -> Column:
    """The nearest whole number, halves up."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


# Symbols ----------------------------------------------------------------------------------------


def legs(symbol: Column) -> tuple[Column, Column]:
    """Base and quote of BASE/QUOTE, BASE-QUOTE and BASE_QUOTE in upper case; the quote is null for anything else."""
    clean = F.translate(F.upper(symbol), "-", "/")
    clean = F.when(~clean.contains("/") & (F.size(F.split(clean, "_")) == 2), F.translate(clean, "_", "/")).otherwise(clean)
    return F.split_part(clean, F.lit("/"), F.lit(1)), F.when(clean.contains("/"), F.regexp_extract(clean, "^[^/]*/(.*)$", 1))


def asset_class(symbol: Column) -> Column:
    """forex, crypto or equity by the form of the symbol; PROVIDER_COIN_QUOTE goes by the coin."""
    base, quote = legs(symbol)
    parts = F.split(F.upper(symbol), "_")
    provided = ~F.upper(symbol).rlike("[/-]") & (F.size(parts) > 2) & F.get(parts, 1).isin(*COINS)
    pair = quote.isNotNull()
    return F.when(provided | pair & ~(base.isin(*FIAT) & quote.isin(*FIAT)) & base.isin(*COINS), "crypto").when(pair & quote.isin(*FIAT), "forex").otherwise("equity")


def ticker(symbol: Column) -> Column:
    """BTC-USD of a pair with a coin, EURUSD=X of any other pair, else the symbol."""
    pair, base = symbol.contains("/"), F.upper(F.split_part(symbol, F.lit("/"), F.lit(1)))
    return F.when(pair & base.isin(*COINS), F.concat_ws("-", base, F.upper(F.split_part(symbol, F.lit("/"), F.lit(2))))).when(pair, F.concat(F.replace(symbol, F.lit("/"), F.lit("")), F.lit("=X"))).otherwise(symbol)


def taxonomy(symbol: Column, label: Column) -> Column:
    """The label corrected: funds, pairs with a coin, three-letter pairs, and plain symbols once called Equity."""
    up, coin = F.upper(symbol), F.upper(F.split_part(symbol, F.lit("/"), F.lit(1))).isin(*RELABELLED)
    pair = symbol.contains("/")
    return F.when(up.isin(*FUNDS), "ETF").when(pair & coin, "Crypto").when(symbol.rlike("^[A-Za-z]{3}/[A-Za-z]{3}$"), "Forex").when((label == "Equity") & ~pair, "Stock").otherwise(label)


def slug(symbol: Column) -> Column:
    """Letters, digits, dots and hyphens; each run of anything else is one underscore."""
    return F.regexp_replace(symbol, "[^A-Za-z0-9.-]+", "_")


# Verdicts and levels ----------------------------------------------------------------------------


def direction(verdict: Column) -> Column:
    u = F.upper(F.coalesce(verdict, F.lit("")))
    return F.when(u.contains("BUY"), "long").when(u.rlike("SELL|SHORT"), "short").otherwise("neutral")


def verdict_kind(verdict: Column) -> Column:
    u = F.upper(F.coalesce(verdict, F.lit("")))
    return F.when(u.rlike("BUY|SELL|SHORT|LONG"), "trade").when(u.rlike("AVOID|REDUCE|HEDGE"), "avoid").otherwise("watch")


def reward_risk(entry: Column, stop: Column, target: Column) -> Column:
    risk = F.abs(entry - stop)
    return F.when(risk > 0, F.abs(target - entry) / risk)


def levels_close(pairs: list[tuple[Column, Column]], tolerance: float = 0.02) -> Column:
    """Every pair of levels that are both there differs by at most the tolerance of the first."""
    out = F.lit(True)
    for x, y in pairs:
        below = F.when(F.abs(x) > 0, F.abs(x)).otherwise(1.0)
        out = out & F.coalesce(F.abs(x - y) / below <= tolerance, F.lit(True))
    return out


def distance_to_zone(low: Column, high: Column, price: Column) -> Column:
    """Per cent of the price to the nearer edge of the zone, 0 inside."""
    return F.when((price >= low) & (price <= high), 0.0).otherwise(F.abs(price - F.when(price < low, low).otherwise(high)) / F.abs(price) * 100)


def approach(now: Column, scanned: Column) -> Column:
    return F.when(F.abs(now - scanned) < 0.1, "flat").when(now < scanned, "closer").when(now > scanned, "further")


def entry_status(verdict: Column, now: Column, moved: Column) -> Column:
    kind = verdict_kind(verdict)
    live = F.when(now == 0, "live").when(moved == "closer", "approaching").when(moved == "further", "drifting").otherwise("waiting")
    return F.when(kind == "avoid", "avoid").when(kind == "watch", F.when(now == 0, "watch-hit").otherwise("watch")).when(now.isNotNull(), live)


def style(timeframe: Column) -> Column:
    t = F.lower(timeframe)
    return F.when(t.rlike("15m|5m|min|scalp"), "scalp").when(t.rlike("1h|4h|hour|intraday"), "intraday").when(t.rlike("1d|day|swing"), "swing").when(t.rlike("1w|week|position"), "position")


def row_seconds(created: Column, row_id: Column, day: Column) -> Column:
    """When a row was made: its time, else the milliseconds at the end of its id, else its day; in seconds."""
    at_id = F.regexp_extract(row_id, r"_(\d{10,})$", 1).try_cast("double") / 1000
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(created)).cast("double"), at_id, F.unix_timestamp(day.cast("timestamp")).cast("double"))


def progress(verdict: Column, entry: Column, stop: Column, target: Column, price: Column) -> tuple[Column, Column]:
    """(per cent, toward): how far the price has gone from the entry toward the target, or toward the stop where that is further."""
    gain, loss = F.try_divide(price - entry, target - entry), F.try_divide(price - entry, stop - entry)
    known = (direction(verdict) != "neutral") & gain.isNotNull() & loss.isNotNull()
    ahead = (gain >= 0) & (gain >= loss)
    share = F.when(ahead, whole(clamp(gain) * 100)).when(loss > 0, whole(clamp(loss) * 100)).otherwise(0)
    return F.when(known, share), F.when(known, F.when(~ahead & (loss > 0), "stop").otherwise("target"))


def assessment(old: Column, new: Column) -> Column:
    """What a second verdict says of the first."""
    managed = F.upper(F.coalesce(new, F.lit("")))
    a, b = direction(old), direction(new)
    by_direction = F.when(a == "neutral", F.when(b != "neutral", "activated").otherwise("still-waiting")).when(a == b, "confirmed").when(b == "neutral", "weakening").otherwise("invalidated")
    return F.when(managed.isin("HOLD_TRADE", "TIGHTEN_STOP"), "confirmed").when(managed.isin("MOVE_TO_BREAKEVEN", "SCALE_OUT"), "weakening").when(managed == "CLOSE_TRADE", "invalidated").otherwise(by_direction)


def watch_status(verdict: Column, stop: Column, target: Column, low: Column, high: Column, price: Column) -> Column:
    short = direction(verdict) == "short"
    pad = (high - low) * 0.001 + F.abs(high) * 0.0015
    stopped = F.when(short, price >= stop).otherwise(price <= stop)
    reached = F.when(short, price <= target).otherwise(price >= target)
    return F.when(price.isNull(), "pending").when(stopped, "stopped").when(reached, "target").when((price >= low - pad) & (price <= high + pad), "inzone").otherwise("pending")


def alert_reached(price: Column, level: Column, came_from: Column) -> Column:
    near = F.abs(price - level) / F.when(F.abs(level) > 0, F.abs(level)).otherwise(1.0) < 0.002
    return F.when(came_from == "above", price <= level).when(came_from == "below", price >= level).otherwise(near)


def r_multiple(side: Column, entry: Column, stop: Column, price: Column) -> Column:
    return F.when(F.abs(entry - stop) > 0, side * (price - entry) / F.abs(entry - stop))


def ladder(long: Column, entry: Column, stop: Column, price: Column) -> tuple[Column, Column, Column]:
    """(level of the first partial exit, one risk from the entry; whether the price has reached it; how far it is)."""
    risk = F.abs(entry - stop)
    level = F.when(risk > 0, F.when(long, entry + risk).otherwise(entry - risk))
    left = F.when(long, level - price).otherwise(price - level)
    return level, left <= 0, F.when(left > 0, left)


# Sizes ------------------------------------------------------------------------------------------


def vol_target_notional(equity: Column, target: Column, vol: Column) -> Column:
    return F.when(vol > 0, target * equity / vol).otherwise(0.0)


def units_from_risk(equity: Column, fraction: Column, stop_distance: Column) -> Column:
    return F.when(stop_distance > 0, fraction * equity / stop_distance).otherwise(0.0)


def lots(volume: Column, least: float = 0.01, step: float = 0.01) -> Column:
    """Rounded down to whole steps; 0 below the least lot."""
    down = F.round(F.floor(volume / step) * step, 10)
    return F.when((volume > 0) & (down >= least - 1e-9), F.round(down, 2)).otherwise(0.0)


def lot_units(kind: Column) -> Column:
    return F.when(kind == "forex", 100000.0).otherwise(1.0)


def tail_factor(skew: Column, excess: Column, z: float, long: bool) -> Column:
    """Cornish-Fisher quantile of the side that hurts, by the normal one."""
    q = -abs(z) if long else abs(z)
    found = q + skew / 6 * (q**2 - 1) + excess / 24 * (q**3 - 3 * q) - skew * skew / 36 * (2 * q**3 - 5 * q)
    return F.abs(found) / abs(z)


def bars_per_year(kind: Column, timeframe: Column) -> Column:
    minutes = F.element_at(F.create_map(*[F.lit(x) for k, v in {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "8h": 480, "12h": 720}.items() for x in (k, float(v))]), timeframe)
    daily = F.when(kind == "crypto", 365.0).otherwise(252.0)
    inside = F.when(kind == "crypto", 1440 / minutes * daily).when(kind == "forex", 1440 / minutes * (5 * 52.14)).otherwise(390 / minutes * daily)
    return F.when(timeframe.isin("1w", "w", "1week"), F.when(kind == "crypto", daily / 7).otherwise(52.0)).when(minutes.isNull(), daily).otherwise(inside)


def day_loss(anchor: Column, equity: Column) -> Column:
    return F.when(anchor > 0, F.greatest(F.lit(0.0), 1 - equity / anchor)).otherwise(0.0)


def sentiment_damped(side: Column, p: Column, score: Column, confidence: Column, damp: float = 0.3, veto: float = 0.6) -> tuple[Column, Column]:
    """(side, probability) after a sentiment that contradicts: flat and one half beyond veto, shrunk toward one half from damp on."""
    against = -side * score * clamp(confidence)
    share = (against - damp) / (veto - damp)
    touched = (side != 0) & score.isNotNull()
    return F.when(touched & (against >= veto), 0).otherwise(side), F.when(touched & (against >= veto), 0.5).when(touched & (against >= damp), p - share * (p - 0.5)).otherwise(p)


# Exits ------------------------------------------------------------------------------------------


def _hits(long: Column, close: Column, stop: Column, target: Column) -> tuple[Column, Column]:
    slack = close * 0.0002
    return (target > 0) & F.when(long, close >= target - slack).otherwise(close <= target + slack), (stop > 0) & F.when(long, close <= stop + slack).otherwise(close >= stop - slack)


def exit_kind(long: Column, close: Column, stop: Column, target: Column) -> Column:
    took, stopped = _hits(long, close, stop, target)
    return F.when(close <= 0, "managed").when(took, "tp_hit").when(stopped, "sl_hit").otherwise("managed")


def exit_reason(long: Column, opened: Column, close: Column, stop: Column, target: Column, profit: Column) -> Column:
    took, stopped = _hits(long, close, stop, target)
    why = F.when(F.abs(stop - opened) <= opened * 0.0005, "breakeven").when(profit > 0, "trailing").otherwise("stop")
    return F.when(close <= 0, "closed").when(took, "target").when(stopped, why).otherwise("manual")


def learned(outcome: Column, hindsight: Column) -> Column:
    """True where the market reached the target, at once or later; false for the stop; null if neither is known."""
    o, h = F.lower(F.trim(F.coalesce(outcome, F.lit("")))), F.lower(F.trim(F.coalesce(hindsight, F.lit(""))))
    return F.when(o == "tp_hit", True).when(o == "sl_hit", False).when(h == "tp_hit", True).when(h == "sl_hit", False)


def exit_quality(outcome: Column, hindsight: Column) -> Column:
    o, h = F.lower(F.trim(F.coalesce(outcome, F.lit("")))), F.lower(F.trim(F.coalesce(hindsight, F.lit(""))))
    return F.when(o.isin("tp_hit", "sl_hit"), None).when(h == "sl_hit", "good").when(h == "tp_hit", "premature")


# Labels of markets ------------------------------------------------------------------------------


def banded(x: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The label of the first bound that x is below."""
    out = F.when(x.isNull(), None)
    for bound, label in bounds:
        out = out.when(x < bound, label)
    return out.otherwise(last)


def curve_label(spread: Column) -> Column:
    return banded(spread, [(-0.75, "deeply inverted"), (0.0, "inverted"), (0.3, "flat"), (1.0, "normal")], "steep")


def credit_label(spread: Column) -> Column:
    return banded(whole(spread * 100), [(250, "benign"), (350, "slightly elevated"), (500, "elevated")], "distressed")


def fear_label(vix: Column) -> Column:
    return banded(vix, [(12, "extreme complacency"), (18, "calm"), (25, "normal"), (35, "elevated fear")], "extreme fear")


def dollar_label(index: Column) -> Column:
    return F.when(index > 108, "very strong").when(index > 103, "strong").when(index > 97, "neutral").when(index > 91, "weak").when(index.isNotNull(), "very weak")


def funding_label(pct: Column) -> Column:
    return F.when(pct > 0.03, "crowded long").when(pct < -0.01, "crowded short").when(pct.isNotNull(), "neutral")


def market_session(kind: Column, ts: Column) -> tuple[Column, Column]:
    """(session, liquidity) of crypto, forex and any other class at a time in UTC. Holidays aren't known here."""
    h, day = F.hour(ts) + F.minute(ts) / 60, F.weekday(ts)
    weekend, peak = day >= 5, (h >= 13) & (h < 18)
    coin = F.concat(F.when((h >= 7) & (h < 12), "London").when((h >= 12) & (h < 21), "US").when(h < 9, "Asian").otherwise("off-peak"), F.when(peak, " peak").otherwise(""))
    closed = (day == 5) | (day == 6) & (h < 22) | (day == 4) & (h >= 22)
    pair = F.when(closed, "closed").when((h >= 12) & (h < 16), "overlap").when((h >= 7) & (h < 16), "London").when((h >= 12) & (h < 21), "New York").otherwise("Asian")
    share = F.when(weekend, "closed").when(h < 14.5, "pre-market").when(h >= 21, "after-hours").when(h < 15.5, "open").when((h >= 16.5) & (h < 19), "midday").when(h >= 20, "power hour").otherwise("mid-session")
    liquid = (
        F.when(weekend, "thin").when(peak, "high").otherwise("normal"),
        F.when(closed, "closed").when((h >= 12) & (h < 16), "peak").when((h >= 7) & (h < 16), "high").when((h >= 12) & (h < 21), "moderate").otherwise("low"),
        F.when(weekend, "closed").when((h < 14.5) | (h >= 21), "thin").when(h < 15.5, "high").when((h >= 16.5) & (h < 19), "low").when(h >= 20, "high").otherwise("moderate"),
    )
    return tuple(F.when(kind == "crypto", c).when(kind == "forex", f).otherwise(s) for c, f, s in ((coin, pair, share), liquid))


def trading_hours(kind: Column, ts: Column) -> Column:
    """Coins always, pairs on weekdays, all else from 13:30 to 20:00 UTC on weekdays."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.when(kind == "crypto", True).when(F.weekday(ts) >= 5, False).when(kind == "forex", True).otherwise((minute >= 810) & (minute <= 1200))


def london_new_york(ts: Column) -> Column:
    return (F.weekday(ts) < 5) & (F.hour(ts) >= 8) & (F.hour(ts) < 21)


def drawdown_zone(drawdown: Column, halted: Column, reducing: float, breaker: float) -> Column:
    return F.when(halted, "HALTED").when(drawdown.isNull(), "UNKNOWN").when(drawdown >= breaker, "BREAKER").when(drawdown >= reducing, "REDUCING").otherwise("OK")


# Numbers and texts ------------------------------------------------------------------------------


def _polynomial(x: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + f
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the normal distribution; null outside of (0, 1)."""
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    tail = lambda x: _polynomial(x, NORMAL_C) / _polynomial(x, NORMAL_D)
    middle = _polynomial(q * q, NORMAL_A) * q / _polynomial(q * q, NORMAL_B)
    return F.when((p > 0) & (p < 1), F.when(p < NORMAL_TAIL, tail(low)).when(p <= 1 - NORMAL_TAIL, middle).otherwise(-tail(high)))


def expected_best(sigma: Column, trials: Column) -> Column:
    """The best Sharpe ratio that so many trials without skill lead to expect."""
    g = 0.5772156649015329
    e = 2.718281828459045
    return F.when((trials > 1) & (sigma > 0), sigma * ((1 - g) * inverse_normal(1 - 1 / trials) + g * inverse_normal(1 - 1 / (trials * e)))).otherwise(0.0)


def printed(form: Column, x: Column) -> Column:
    """x in a Python format, rounded as C does: by the exact value of the double, halves to even. (format_string rounds its shortest digits, halves up.)"""

    @F.arrow_udf("string")
    def of(forms: pa.Array, values: pa.Array) -> pa.Array:
        return pa.array([None if f is None or v is None else f.format(v) for f, v in zip(forms.to_pylist(), values.to_pylist(), strict=True)], pa.string())

    return of(form, x.cast("double"))


def price_text(x: Column, kind: Column) -> Column:
    return printed(F.when(kind == "Forex", "{:.5f}").when(x >= 10000, "{:,.2f}").when(x >= 100, "{:.2f}").otherwise("{:.4f}"), x)


def percent_text(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), printed(F.lit("{:.2f}%"), x))


def volume_text(x: Column) -> Column:
    form = F.when(x >= 1e9, "{:.1f}B").when(x >= 1e6, "{:.1f}M").when(x >= 1e3, "{:.1f}K")
    scaled = F.when(x >= 1e9, x / 1e9).when(x >= 1e6, x / 1e6).otherwise(x / 1e3)
    return F.coalesce(printed(form, scaled), whole(x).cast("string"))


def json_in(text: Column) -> Column:
    """The array, else the object, from its first bracket to its last, of a text or of its first fenced part that begins with one; null if that is no JSON."""
    parts = F.transform(F.split(text, "```"), lambda p: F.trim(F.regexp_replace(F.trim(p), "^json", "")))
    fenced = F.get(F.filter(parts, lambda p: p.rlike(r"^[\[{]")), 0)
    inside = F.when(text.contains("```"), F.coalesce(fenced, text)).otherwise(text)
    tries = [F.nullif(F.regexp_extract(inside, rf"(?s)(\{a}.*\{b})", 1), F.lit("")) for a, b in ("[]", "{}")]
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull(), t) for t in tries])


def stripped(text: Column) -> Column:
    """Without comments and tags, the common entities decoded, at most one empty line in a row."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"<[^>]+>", "")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(c))
    return F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")


def config_key(config: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config))))
