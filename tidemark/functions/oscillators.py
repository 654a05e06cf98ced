"""Oscillators and what is weighed from them: RSI and its stochastic, MACD, ADX, confluence, levels and volume by price.

RSI, MACD and ADX are recursive: they walk a series (``outcomes.walked``) with a state of a few numbers and the last 42 moves. As folds
over arrays of a window RSI and its stochastic made w38 take 13 s instead of 4 s on 8623 bars.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import windows as w

P = 14
#: Weight of the next signal of a family, against the one before.
DECAY = 0.55


def nearest_whole(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5).cast("long")


def smoothed_strengths(moves: list[float]) -> list[float]:
    """RSIs from the 14th move on: the mean of the first 14, then Wilder's smoothing; 100 where nothing fell."""
    up, down, out = sum(max(x, 0.0) for x in moves[:P]) / P, sum(max(-x, 0.0) for x in moves[:P]) / P, []
    for i in range(P - 1, len(moves)):
        if i >= P:
            up, down = (up * (P - 1) + max(moves[i], 0.0)) / P, (down * (P - 1) + max(-moves[i], 0.0)) / P
        out.append(100 - 100 / (1 + up / down) if down else 100.0)
    return out


def strength(moves: list[float]) -> tuple[int | None, int | None]:
    """(RSI of the last 42 moves, where the RSI of the last 37 stands among its last 14), both whole, 0 to 100: null with fewer than 15
    and 32 moves; the second is 50 if all 14 are equal."""
    rsi = math.floor(smoothed_strengths(moves)[-1] + 0.5) if len(moves) > P else None
    if len(moves) < 2 * P + 4:
        return rsi, None
    recent = smoothed_strengths(moves[-37:])[-P:]
    low, high = min(recent), max(recent)
    return rsi, 50 if low == high else math.floor((recent[-1] - low) / (high - low) * 100 + 0.5)


#: What trend_step returns.
TREND = "rsi bigint, stoch bigint, macd double, adx bigint"


def trend_step(state: dict, row: tuple) -> tuple:
    """RSI and its stochastic, MACD (EMAs of 12 and 26 that begin with the mean of their first bars) and whole ADX of 14; null until there
    are 16, 33, 26 and 30 bars. A bar without prices is passed over and gets nulls."""
    h, low, c = row
    if any(x is None or x != x for x in row):
        return None, None, None, None
    n = state["n"] = state.get("n", 0) + 1
    state["sum"] = state.get("sum", 0.0) + c
    for p in (12, 26):
        if n == p:
            state[p] = state["sum"] / p
        elif n > p:
            state[p] += 2 / (p + 1) * (c - state[p])
    if n > 1:
        ph, pl, pc = state["bar"]
        state["moves"] = [*state.get("moves", [])[-41:], c - pc]
        up, down = h - ph, pl - low
        found = (max(h - low, abs(h - pc), abs(low - pc)), up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0)
        sums = state.get("sums", (0.0, 0.0, 0.0))
        state["sums"] = sums = tuple(s + x if n <= P + 1 else s - s / P + x for s, x in zip(sums, found, strict=True))
        if n > P:
            true, plus, minus = sums
            dx = 100 * abs(plus - minus) / (plus + minus) if true and plus + minus > 0 else 0.0
            state["adx"] = state.get("adx", 0.0) + dx / P if n <= 2 * P else (state["adx"] * (P - 1) + dx) / P
    state["bar"] = row
    return *strength(state.get("moves", [])), state[12] - state[26] if n >= 26 else None, math.floor(state["adx"] + 0.5) if n >= 2 * P + 2 else None


def _above(a: str, b: str) -> tuple[Column, Column]:
    return F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a) > F.col(b)


def _over(a: str, level: float) -> tuple[Column, Column]:
    return F.col(a).isNotNull(), F.col(a) > level


def signals() -> list[tuple[str, int, Column, Column]]:
    """(family, weight, is it there, does it speak for a rise) of columns c, sma20 to sma200, rsi, macd, stoch, adx, volume and week_*."""
    return [
        ("day trend", 2, *_above("c", "sma20")),
        ("day trend", 2, *_above("c", "sma50")),
        ("day trend", 3, *_above("c", "sma200")),
        ("day trend", 2, *_above("sma20", "sma50")),
        ("day trend", 2, *_above("sma50", "sma200")),
        ("day trend", 1, F.coalesce(F.col("adx") > 25, F.lit(False)), F.coalesce(F.col("c") > F.col("sma20"), F.lit(False))),
        ("day momentum", 2, *_over("rsi", 50)),
        ("day momentum", 2, *_over("macd", 0)),
        ("day momentum", 1, *_over("stoch", 50)),
        ("week trend", 3, *_above("week_c", "week_sma20")),
        ("week trend", 2, *_above("week_c", "week_sma50")),
        ("week trend", 3, *_over("week_macd", 0)),
        ("week momentum", 2, *_over("week_rsi", 50)),
        ("volume", 2, F.col("volume") == "rising", F.lit(True)),
    ]


def _weighed(chosen: list[tuple[str, int, Column, Column]], decay: float) -> Column:
    """Array of (bull, weight) of the signals that are there, the heaviest first, each further one by decay less."""
    heaviest = sorted(chosen, key=lambda s: -s[1])
    there = F.filter(F.array(*[F.when(here, F.struct(bull.alias("bull"), F.lit(float(weight)).alias("weight"))) for _, weight, here, bull in heaviest]), lambda s: s.isNotNull())
    return F.transform(there, lambda s, i: F.struct(s["bull"].alias("bull"), (s["weight"] * F.pow(F.lit(decay), i)).alias("weight")))


def _total(weighed: Column, bull_only: bool = False) -> Column:
    return F.aggregate(weighed, F.lit(0.0), lambda a, s: a + (F.when(s["bull"], s["weight"]).otherwise(0.0) if bull_only else s["weight"]))


def _verdict(pct: Column) -> dict[str, Column]:
    strength = F.when((pct >= 80) | (pct <= 20), "HIGH").when((pct >= 65) | (pct <= 35), "MODERATE").otherwise("LOW")
    return {"direction": F.when(pct >= 65, "BULLISH").when(pct <= 35, "BEARISH").otherwise("MIXED"), "strength": strength}


def confluence() -> list[dict[str, Column]]:
    """Steps of columns: bull_pct, direction, strength and n_signals of all signals; null and 0 where none is there."""
    return [
        {"_all": _weighed(signals(), 1.0)},
        {"bull_pct": nearest_whole(F.try_divide(_total(F.col("_all"), True), _total(F.col("_all"))) * 100), "n_signals": F.size("_all").cast("long")},
        {k: F.when(F.col("bull_pct").isNotNull(), v) for k, v in _verdict(F.col("bull_pct")).items()},
    ]


def family_confluence() -> list[dict[str, Column]]:
    """As confluence, but each family's further signals weigh less; where one family has half of the weight, the strength is a step lower."""
    families: dict[str, list] = {}
    for signal in signals():
        families.setdefault(signal[0], []).append(signal)
    names = {f"_f{i}": chosen for i, chosen in enumerate(families.values())}
    each = [F.coalesce(_total(F.col(k)), F.lit(0.0)) for k in names]
    total, bull = sum(each[1:], each[0]), sum([_total(F.col(k), True) for k in names], F.lit(0.0))
    verdict = _verdict(F.col("bull_pct"))
    lower = F.when(F.col("strength") == "HIGH", "MODERATE").otherwise("LOW")
    return [
        {k: _weighed(chosen, DECAY) for k, chosen in names.items()},
        {
            "bull_pct": nearest_whole(F.try_divide(bull, total) * 100),
            "families": sum([F.when(F.size(k) > 0, 1).otherwise(0) for k in names], F.lit(0)).cast("long"),
            "concentrated": F.round(F.try_divide(F.greatest(*each), total), 9) >= 0.5,
        },
        {k: F.when(F.col("bull_pct").isNotNull(), v) for k, v in verdict.items()},
        {"strength": F.when(F.col("concentrated"), lower).otherwise(F.col("strength"))},
    ]


def value_area(volumes: Column, share: float = 0.7) -> Column:
    """(peak, first, last): places in the array, from 0, of its greatest value and of the stretch around it that holds share of all; it
    grows by the greater neighbour, upwards if they are equal."""
    peak = F.array_position(volumes, F.array_max(volumes)).cast("int") - 1
    last = F.size(volumes) - 1
    goal = F.aggregate(volumes, F.lit(0.0), lambda a, x: a + x) * share

    def step(a: Column, _i: Column) -> Column:
        below = F.when(a["first"] > 0, F.get(volumes, a["first"] - 1))
        above = F.when(a["last"] < last, F.get(volumes, a["last"] + 1))
        up = above.isNotNull() & (below.isNull() | (above >= below))
        grows = (a["held"] < goal) & (above.isNotNull() | below.isNotNull())
        return F.struct(
            F.when(grows & ~up, a["first"] - 1).otherwise(a["first"]).alias("first"),
            F.when(grows & up, a["last"] + 1).otherwise(a["last"]).alias("last"),
            (a["held"] + F.when(grows, F.when(up, above).otherwise(below)).otherwise(0.0)).alias("held"),
        )

    start = F.struct(peak.alias("first"), peak.alias("last"), F.array_max(volumes).alias("held"))
    return F.aggregate(volumes, start, step, lambda a: F.struct(peak.alias("peak"), a["first"].alias("first"), a["last"].alias("last")))
