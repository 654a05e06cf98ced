"""A null model of entries: what as many entries at random would have earned, as a table of hashed draws.

Each run draws an entry at each bar with the strategy's own frequency, and a side with its share of long ones, from the digits of one hash of seed, run, instrument and day: so any machine,
in any order, draws the same. An entry earns its side's return over a fixed number of bars, as the strategy's own do. Runs are multiplied out within the tasks and summed before
they are shuffled. A strategy without ``least`` trades, or an instrument with fewer than ``bars`` bars, has no percentile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Draws are of so many values.
VALUES = 1 << 32


def drawn(digest: Column, at: int) -> Column:
    """A number from 0 to VALUES of eight hexadecimal digits of a hash."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")


def percentiles(bars: DataFrame, runs: int = 200, seed: str = "null", least: int = 10, many: int = 50) -> DataFrame:
    """Per instrument of bars (instrument, d, side: 1, -1 or null where the strategy doesn't enter, ahead: return from this bar on, null at the end): trades, earned (sum of side * ahead), median and best of
    the runs, percentile (share of the runs that earned less, in per cent) and verdict."""
    kept = bars.filter("ahead IS NOT NULL")
    own = kept.groupBy("instrument").agg(F.count("*").alias("bars"), F.count("side").alias("trades"), F.sum(F.col("side") * F.col("ahead")).alias("earned"), F.count_if(F.col("side") > 0).alias("long"))
    own = own.filter((F.col("trades") >= least) & (F.col("bars") >= many))
    rate = own.select("instrument", F.least(F.lit(0.9), F.col("trades") / F.col("bars")).alias("_p"), (F.col("long") / F.col("trades")).alias("_long"))
    each = kept.join(rate, "instrument").select("instrument", "d", "ahead", "_p", "_long", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), "run", "instrument", F.date_format("d", "yyyy-MM-dd")).cast("binary"))
    entries = each.withColumn("_h", digest).filter(drawn(F.col("_h"), 1) < F.col("_p") * VALUES)
    side = F.when(drawn(F.col("_h"), 9) < F.col("_long") * VALUES, 1).otherwise(-1)
    earned = entries.groupBy("instrument", "run").agg(F.round(F.sum(side * F.col("ahead")), 9).alias("e"))
    every = own.select("instrument", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).join(earned, ["instrument", "run"], "left").withColumn("e", F.coalesce("e", F.lit(0.0)))
    found = every.join(own, "instrument").groupBy("instrument", "trades", F.round("earned", 9).alias("earned")).agg(F.get(F.array_sort(F.collect_list("e")), F.lit(runs // 2)).alias("median"), F.max("e").alias("best"), F.count_if(F.col("e") < F.round("earned", 9)).alias("_beat"))
    percentile = F.floor(F.col("_beat") * 100 / runs + 0.5).cast("bigint")
    return found.select("instrument", "trades", "earned", "median", "best", percentile.alias("percentile"), F.when(percentile >= 95, "beats random").when(percentile >= 80, "edge unclear").otherwise("no edge vs random").alias("verdict"))
