"""What became of a position: barriers, excursions, matched lots, runs, and a simulator that walks the bars.

What looks ahead a bounded number of rows is a window; lots are matched by their places in the queue; only the simulator
and recursive indicators walk row by row, in sorted partitions with one series' state in memory, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered() -> WindowSpec:
    return Window.partitionBy("instrument").orderBy("d")


def triple_barrier(bars: DataFrame, target: Column, stop: Column, horizon: int) -> DataFrame:
    """bars with label (1 target, 0 stop, null neither or too few bars) and bars_held; in a bar with both the stop counts."""
    ahead = F.collect_list(F.struct("h", "l")).over(ordered().rowsBetween(1, horizon))
    at = bars.withColumns({"_ahead": ahead, "_up": target, "_down": stop})
    hit = F.transform("_ahead", lambda x, i: F.when(x["l"] <= F.col("_down"), F.struct(F.lit(0).alias("y"), (i + 1).alias("k"))).when(x["h"] >= F.col("_up"), F.struct(F.lit(1).alias("y"), (i + 1).alias("k"))))
    first = at.withColumn("_hit", F.get(F.filter(hit, lambda x: x.isNotNull()), 0))
    enough = F.size("_ahead") == horizon
    return first.withColumns({"label": F.when(enough, F.col("_hit.y")), "bars_held": F.when(enough, F.col("_hit.k"))}).drop("_ahead", "_up", "_down", "_hit")


def excursions(horizon: int) -> dict[str, Column]:
    """Best and worst move against the close over the next bars, where all are there."""
    ahead = ordered().rowsBetween(1, horizon)
    whole = F.count("*").over(ahead) == horizon
    return {"mfe": F.when(whole, F.max("h").over(ahead) - F.col("c")), "mae": F.when(whole, F.min("l").over(ahead) - F.col("c"))}


def fifo(fills: DataFrame, order: list[str]) -> DataFrame:
    """(instrument, buy_id, sell_id, qty, pnl) of fills (instrument, fill_id, side 1 or -1, qty, price), oldest lots first.

    The k-th unit bought always meets the k-th unit sold, also when the position turns: each fill is a stretch of its
    side's count, and the ends of all stretches, in order, cut out what is matched. One ordered window, no pairs.
    """
    side = Window.partitionBy("instrument", "side").orderBy(*order)
    total = F.sum("qty").over(side)
    placed = fills.withColumns({"_to": total, "_at": total - F.col("qty")})
    limits = fills.groupBy("instrument").agg(F.sum(F.when(F.col("side") > 0, F.col("qty"))).alias("_b"), F.sum(F.when(F.col("side") < 0, F.col("qty"))).alias("_s")).select("instrument", F.when(F.col("_b") < F.col("_s"), F.col("_b")).otherwise(F.col("_s")).alias("_limit")).filter("_limit > 0")
    walk = Window.partitionBy("instrument").orderBy("_at", "side", "fill_id")
    run = walk.rowsBetween(Window.unboundedPreceding, 0)
    lot = F.struct("fill_id", "price")
    cut = placed.withColumns(
        {
            "_buy": F.last(F.when(F.col("side") > 0, lot), ignorenulls=True).over(run),
            "_sell": F.last(F.when(F.col("side") < 0, lot), ignorenulls=True).over(run),
            "_next": F.lead("_at").over(walk),
        }
    ).join(limits, "instrument")
    qty = F.least(F.coalesce("_next", "_limit"), F.col("_limit")) - F.col("_at")
    return cut.withColumn("_q", qty).filter("_q > 0").select("instrument", F.col("_buy.fill_id").alias("buy_id"), F.col("_sell.fill_id").alias("sell_id"), F.col("_q").alias("qty"), (F.col("_q") * (F.col("_sell.price") - F.col("_buy.price"))).alias("pnl"))


def runs(df: DataFrame, label: str) -> DataFrame:
    """(instrument, run, label, n, first, last): stretches of equal labels in the order of d."""
    changed = F.when(F.lag(label).over(ordered()).eqNullSafe(F.col(label)), 0).otherwise(1)
    numbered = df.withColumn("run", F.sum(changed).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("instrument", "run").agg(F.first(label).alias(label), F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"))


def walked(bars: DataFrame, columns: list[str], schema: str, start: Callable[[], dict], step: Callable[[dict, tuple], tuple]) -> DataFrame:
    """(instrument, d, and what step returns) for each row in order; state: one dict per series, made by start."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, state = None, start()
        for frame in frames:
            out = []
            for name, *row in frame[["instrument", *columns]].itertuples(index=False):
                if name != series:
                    series, state = name, start()
                out.append(step(state, tuple(row)))
            yield pd.concat([frame[["instrument", "d"]], pd.DataFrame(out, columns=names, index=frame.index)], axis=1)

    sorted_ = bars.select("instrument", "d", *columns).repartition("instrument").sortWithinPartitions("instrument", "d")
    return sorted_.mapInPandas(run, f"instrument string, d date, {schema}")


def recursive_step(state: dict, row: tuple) -> tuple:
    """EMA 12 and 26, MACD and its signal, Wilder's RSI and ATR of 14, RiskMetrics variance."""
    h, low, c = row
    prev = state.get("c")
    if prev is None:
        state |= {"e12": c, "e26": c, "sig": 0.0, "up": 0.0, "dn": 0.0, "atr": h - low, "var": 0.0, "n": 0}
    else:
        k, move = state["n"] + 1, c - prev
        state["n"] = k
        for name, n in (("e12", 12), ("e26", 26)):
            state[name] += 2 / (n + 1) * (c - state[name])
        share = 1 / min(k, 14)
        state["up"] += share * (max(move, 0.0) - state["up"])
        state["dn"] += share * (max(-move, 0.0) - state["dn"])
        state["atr"] += 1 / min(k + 1, 14) * (max(h - low, abs(h - prev), abs(low - prev)) - state["atr"])
        state["sig"] += 2 / 10 * (state["e12"] - state["e26"] - state["sig"])
        r = c / prev - 1
        state["var"] = r * r if k == 1 else 0.94 * state["var"] + 0.06 * r * r
    state["c"] = c
    ready = state["n"] >= 14
    both = state["up"] + state["dn"]
    macd = state["e12"] - state["e26"]
    return state["e12"], macd, state["sig"], (100 * state["up"] / both if both else 50.0) if ready else None, state["atr"] if ready else None, state["var"] ** 0.5


def simulator(stop: float, target: float, cost: float) -> Callable[[dict, tuple], tuple]:
    """One position at a time: a signal is filled at the next open; the stop counts before the target in one bar; a gap fills at the open."""

    def step(state: dict, row: tuple) -> tuple:
        o, h, low, _c, signal = row
        side, result, reason = state.get("side", 0), None, None
        if not side and state.get("wanted"):
            side = state["wanted"]
            state |= {"side": side, "entry": o, "stop": o * (1 - side * stop), "target": o * (1 + side * target)}
        if side:
            stopped = low <= state["stop"] if side > 0 else h >= state["stop"]
            reached = h >= state["target"] if side > 0 else low <= state["target"]
            if stopped or reached:
                level = state["stop"] if stopped else state["target"]
                # Beyond the level at the open already: filled there.
                beyond = side * (o - level) < 0 if stopped else side * (o - level) > 0
                result = side * ((o if beyond else level) / state["entry"] - 1) - cost
                reason = "stop" if stopped else "target"
                state["side"] = 0
        state["wanted"] = int(signal or 0) if not state.get("side") else 0
        return state.get("side", 0), result, reason

    return step
