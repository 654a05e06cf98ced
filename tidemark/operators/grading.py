"""What became of written setups, links of trades to them, costs of fills and of shorts, caps on risk, crowding of cohorts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.alignment import asof
from tidemark.operators.outcomes import ordered


def graded(setups: DataFrame, bars: DataFrame, horizon: int, both: str = "ambiguous") -> DataFrame:
    """setups (id, instrument, d, lo, hi, scan, target, stop, side) with outcome, filled and resolved (days) from the horizon bars after their day.

    A setup is filled on its day where it has no zone or was scanned within 0.05 % of it, else by the first bar that meets the zone;
    from that bar on the first that meets a level decides, and both names what a bar that meets both is. Without levels, a side (long
    or short) or a hit the outcome is null.
    """
    # A bar before all others stands for setups older than their series.
    eve = bars.select("instrument").distinct().select("instrument", F.lit("0001-01-01").cast("date").alias("d"))
    series = bars.select("instrument", "d", "h", "l").unionByName(eve, allowMissingColumns=True)
    ahead = series.select("instrument", F.col("d").alias("_bar"), F.collect_list(F.struct("d", "h", "l")).over(ordered().rowsBetween(1, horizon)).alias("_ahead")).groupBy("instrument", "_bar").agg(F.max("_ahead").alias("_ahead"))
    # The ordered rows carry the day of their bar alone; what follows it is joined to that.
    at = asof(setups, series.select("instrument", "d", F.col("d").alias("_bar")), "instrument", "d", ["_bar"]).join(ahead, ["instrument", "_bar"], "left")
    slack = lambda x: F.abs(x) * 0.0005
    market = F.col("lo").isNull() | F.coalesce((F.col("scan") >= F.col("lo") - slack(F.col("lo"))) & (F.col("scan") <= F.col("hi") + slack(F.col("hi"))), F.lit(False))
    met = F.get(F.filter("_ahead", lambda b: (b["l"] <= F.col("hi")) & (b["h"] >= F.col("lo"))), 0)["d"]
    long = F.col("side") == "long"
    reached = lambda b: F.when(long, b["h"] >= F.col("target")).otherwise(b["l"] <= F.col("target"))
    stopped = lambda b: F.when(long, b["l"] <= F.col("stop")).otherwise(b["h"] >= F.col("stop"))
    known = F.col("side").isin("long", "short") & F.col("target").isNotNull() & F.col("stop").isNotNull()
    hit = F.get(F.filter("_ahead", lambda b: (b["d"] >= F.col("filled")) & (reached(b) | stopped(b))), 0)
    found = at.withColumn("filled", F.when(known, F.when(market, F.col("d")).otherwise(met))).withColumn("_hit", F.when(known, hit))
    outcome = F.when(reached(F.col("_hit")) & stopped(F.col("_hit")), both).when(reached(F.col("_hit")), "tp_hit").when(stopped(F.col("_hit")), "sl_hit")
    return found.withColumns({"outcome": F.when(F.col("_hit").isNotNull(), outcome), "resolved": F.col("_hit.d")}).drop("_ahead", "_bar", "_hit").select(*setups.columns, "filled", "outcome", "resolved")


def links(trades: DataFrame, setups: DataFrame, tolerance: float) -> DataFrame:
    """trades (ticket, symbol, side, stop, target) with link: correct_ticket, wrong_ticket, correct_signature, wrong_signature or unlinked.

    A ticket is right where symbol and side agree and the stop within the tolerance. Without one, the setup of least id that agrees in
    target too counts, and is wrong if it has a ticket. Levels meet in cells of the tolerance's width, each different pair of levels once.
    """
    name = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    by_ticket = setups.filter("ticket IS NOT NULL").groupBy("ticket").agg(F.min_by(F.struct("symbol", "side", "stop"), "id").alias("_s"))
    levels = ["symbol", "side", "stop", "target"]
    different = setups.filter("stop > 0").groupBy(*levels).agg(F.min(F.struct("id", "ticket")).alias("_first"))
    cell = lambda x: F.floor(x / tolerance)
    spread = name(different.withColumn("cell", F.explode(F.sequence(cell(F.col("stop")) - 1, cell(F.col("stop")) + 1))), "s_")
    asked = trades.select(*levels).distinct().withColumn("cell", cell(F.col("stop")))
    near = (F.abs(F.col("stop") - F.col("s_stop")) <= tolerance) & (F.abs(F.col("target") - F.col("s_target")) <= tolerance)
    met = asked.join(spread, (F.col("symbol") == F.col("s_symbol")) & (F.col("side") == F.col("s_side")) & (F.col("cell") == F.col("s_cell"))).filter(near)
    signature = met.groupBy(*levels).agg(F.min("s__first").alias("_first"))
    both = trades.join(by_ticket, "ticket", "left").join(signature, levels, "left")
    agrees = (F.col("_s.symbol") == F.col("symbol")) & (F.col("_s.side") == F.col("side")) & (F.abs(F.col("_s.stop") - F.col("stop")) <= tolerance)
    link = F.when(F.col("_s").isNotNull(), F.when(agrees, "correct_ticket").otherwise("wrong_ticket")).when(F.col("_first").isNotNull(), F.when(F.col("_first.ticket").isNull(), "correct_signature").otherwise("wrong_signature"))
    return both.withColumn("link", F.coalesce(link, F.lit("unlinked"))).drop("_s", "_first")


def fill_price(price: Column, buying: Column, symbol: Column, kind: Column, spread_pips: float, slippage_bps: float, spread_bps: float) -> Column:
    """Half the spread and the slippage to the worse side: in pips for forex (a pip of yen is 0.01), in basis points else."""
    pip = F.when(F.upper(symbol).contains("JPY"), 0.01).otherwise(0.0001)
    cost = F.when(kind == "forex", 0.5 * spread_pips * pip + slippage_bps / 1e4 * price).otherwise((0.5 * spread_bps + slippage_bps) / 1e4 * price)
    return F.when(buying, price + cost).otherwise(price - cost)


def risk_capped(rows: DataFrame, cap: float, equity: float, least: float) -> DataFrame:
    """rows (d, id, is_open, risk, notional) with gamma, by which a day's risk beyond cap x equity shrinks all of it, and kept: false for
    candidates whose notional that leaves at the least or below."""
    day = Window.partitionBy("d")
    gamma = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(cap * equity), F.sum("risk").over(day)), F.lit(1.0)))
    return rows.withColumn("gamma", gamma).withColumn("kept", F.col("is_open") | (F.col("gamma") == 1) | (F.col("notional") * F.col("gamma") > least))


def borrow_cost(bars: DataFrame, shorts: DataFrame, bps: float, per_year: int) -> DataFrame:
    """shorts (id, instrument, d, units, bars) with cost: the fee on each close from the bar of their day on, of so many bars or as many as there are.
    Running sums of closes: a short takes two of them, however long it lasts. Shorts on days without a bar get null."""
    run = ordered().rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = bars.select("instrument", "d", F.row_number().over(ordered()).alias("_n"), F.sum("c").over(run).alias("_sum"), F.col("c").alias("_c"), F.count("*").over(whole).alias("_all"))
    opened = shorts.join(sums, ["instrument", "d"], "left").withColumn("_to", F.least(F.col("_n") + F.col("bars") - 1, F.col("_all")))
    ends = sums.select("instrument", F.col("_n").alias("_to"), F.col("_sum").alias("_end"))
    cost = (F.col("_end") - F.col("_sum") + F.col("_c")) * F.col("units") * (bps / 1e4 / per_year)
    return opened.join(ends, ["instrument", "_to"], "left").withColumn("cost", cost).select(*shorts.columns, "cost")


def vol_scalar(equity: str, window: int, target: float, low: float, high: float, per_year: int) -> list[dict[str, Column]]:
    """Steps of columns ending in scalar: target over the volatility of the last returns within [low, high], high for a flat curve, 1 until
    more than half of the window's points are there."""
    back = ordered().rowsBetween(1 - window, 0)
    change = F.try_divide(F.col(equity) - F.lag(equity).over(ordered()), F.lag(equity).over(ordered()))
    points = F.count("*").over(ordered().rowsBetween(-window, 0))
    rv = F.col("_rv")
    scalar = F.when(rv > 1e-9, F.greatest(F.lit(low), F.least(F.lit(high), F.try_divide(F.lit(target), rv)))).otherwise(high)
    return [{"_ret": change}, {"_rv": F.stddev_samp("_ret").over(back) * math.sqrt(per_year)}, {"scalar": F.when(points > window // 2, scalar).otherwise(1.0)}]


def comomentum(bars: DataFrame, lookback: int, corr_window: int, ref_window: int, least_members: int, least_pairs: int) -> DataFrame:
    """(d, side, together, z): mean correlation of the returns of all instruments that rise (long) or fall (short) over lookback rows,
    and how unusual it is among its last ref_window rows, all of which must have one.

    Rows are the days that any instrument has. Pairs of instruments are the matter of the measure: their number is that of the
    universe squared, whatever the length of the series.
    """
    spine = bars.select("d").distinct().crossJoin(bars.select("instrument").distinct())
    own = bars.select("instrument", "d", "c", (F.try_divide("c", F.lag("c").over(ordered())) - 1).alias("r"))
    filled = spine.join(own, ["instrument", "d"], "left").withColumn("c", F.last("c", ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    moved = filled.withColumns({"mom": F.try_divide("c", F.lag("c", lookback).over(ordered())) - 1, "i": F.row_number().over(ordered())})
    left = moved.select("d", "i", F.col("instrument").alias("a"), F.col("r").alias("u"), F.signum("mom").alias("sa"))
    right = moved.select("d", F.col("instrument").alias("b"), F.col("r").alias("v"), F.signum("mom").alias("sb"))
    pairs = left.join(right, "d").filter("a < b")
    corr = F.corr("u", "v").over(Window.partitionBy("a", "b").orderBy("d").rowsBetween(1 - corr_window, 0))
    seen = pairs.withColumn("corr", F.when(F.col("i") >= corr_window, F.nanvl(corr, F.lit(None).cast("double")))).filter("sa = sb AND sa <> 0")
    means = seen.groupBy("d", F.col("sa").alias("sign")).agg(F.avg("corr").alias("mean"), F.count("corr").alias("pairs"))
    members = moved.filter("mom <> 0").groupBy("d", F.signum("mom").alias("sign")).agg(F.count("*").alias("members"))
    grid = bars.select("d").distinct().withColumn("sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    at = grid.join(means, ["d", "sign"], "left").join(members, ["d", "sign"], "left")
    at = at.withColumn("together", F.when((F.col("members") >= least_members) & (F.col("pairs") >= least_pairs), F.col("mean")))
    back = Window.partitionBy("sign").orderBy("d").rowsBetween(1 - ref_window, 0)
    spread = F.nullif(F.stddev_pop("together").over(back), F.lit(0.0))
    z = F.when(F.count("together").over(back) == ref_window, F.try_divide(F.col("together") - F.percentile("together", F.lit(0.5)).over(back), spread))
    return at.select("d", F.when(F.col("sign") > 0, "long").otherwise("short").alias("side"), "together", z.alias("z"))
