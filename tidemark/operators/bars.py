"""Bars: resampling, cleaning, quality, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resampled(bars: DataFrame, bucket: Column, time: str = "d") -> DataFrame:
    """(instrument, t, o, h, l, c, v, n) of each bucket that has rows; combined on the map side."""
    return bars.groupBy("instrument", bucket.alias("t")).agg(
        F.min_by("o", time).alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", time).alias("c"), F.sum("v").alias("v"), F.count("*").alias("n")
    )


def chunks(bars: DataFrame, size: int, time: str = "d") -> DataFrame:
    """Bars of size consecutive rows of a series, whatever the clock says; incomplete ones stay away."""
    numbered = bars.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy("instrument").orderBy(time)) - 1) / size))
    return numbered.groupBy("instrument", "_k").agg(F.min(time).alias("t"), F.min_by("o", time).alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", time).alias("c"), F.sum("v").alias("v"), F.count("*").alias("n")).filter(F.col("n") == size).drop("_k")


def violates() -> Column:
    """High or low that don't hold open and close."""
    return (F.col("h") < F.col("l")) | (F.col("h") < F.col("o")) | (F.col("h") < F.col("c")) | (F.col("l") > F.col("o")) | (F.col("l") > F.col("c"))


def quality(raw: DataFrame, time: str = "t") -> DataFrame:
    """One row per instrument: what a contract of bars would complain about."""
    per_time = raw.groupBy("instrument", time).agg(
        F.count("*").alias("n"), F.count_if(F.col("o").isNull() | F.col("h").isNull() | F.col("l").isNull() | F.col("c").isNull()).alias("nulls"), F.count_if(F.least("o", "h", "l", "c") <= 0).alias("nonpositive"), F.count_if(violates()).alias("violations")
    )
    return per_time.groupBy("instrument").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("nulls").alias("null_rows"), F.sum("nonpositive").alias("nonpositive"), F.sum("violations").alias("violations"))


def cleaned(raw: DataFrame, time: str, last: str) -> DataFrame:
    """One row per instrument and time, that of the greatest `last`; without null or non-positive prices; high and low widened to hold open and close."""
    kept = raw.groupBy("instrument", time).agg(F.max_by(F.struct("o", "h", "l", "c", "v"), last).alias("_b")).select("instrument", time, "_b.*")
    good = kept.filter((F.col("o") > 0) & (F.col("h") > 0) & (F.col("l") > 0) & (F.col("c") > 0))
    return good.select("instrument", time, "o", F.greatest("o", "h", "l", "c").alias("h"), F.least("o", "h", "l", "c").alias("l"), "c", F.coalesce("v", F.lit(0)).alias("v"))


def gaps(bars: DataFrame, time: str = "d", allowed: int = 1) -> DataFrame:
    """(instrument, after, before, missing): stretches of more than allowed absent weekdays."""
    prev = F.lag(time).over(Window.partitionBy("instrument").orderBy(time))
    # Weekdays up to a date since a Monday long ago; the difference needs no calendar table.
    weekdays = lambda x: F.floor(F.datediff(x, F.lit("1900-01-01").cast("date")) / 7) * 5 + F.least(F.datediff(x, F.lit("1900-01-01").cast("date")) % 7 + 1, F.lit(5))
    found = bars.select("instrument", time).distinct().withColumn("_p", prev).filter(F.col("_p").isNotNull())
    missing = (weekdays(F.col(time)) - weekdays(F.col("_p")) - F.when(F.weekday(time) < 5, 1).otherwise(0)).cast("long")
    return found.select("instrument", F.col("_p").alias("after"), F.col(time).alias("before"), missing.alias("missing")).filter(F.col("missing") > allowed)
