"""Cross-sections: what ranks the instruments of one day against each other. A partition is a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def day() -> WindowSpec:
    return Window.partitionBy("d")


def buckets(df: DataFrame, score: str, share: float, least: int) -> DataFrame:
    """df with z and side (1 long, -1 short, 0): the best and worst share of each day that has at least `least` scores."""
    known = df.filter(F.col(score).isNotNull())
    n = F.count("*").over(day())
    many = F.greatest(F.lit(1), F.bround(n * share).cast("int"))
    short = F.least(many, n - many)
    up, down = (F.row_number().over(day().orderBy(o, "instrument")) for o in (F.desc(score), F.asc(score)))
    spread = F.coalesce(F.nullif(F.stddev_samp(score).over(day()), F.lit(0.0)), F.lit(1.0))
    return known.select("*", n.alias("_n"), many.alias("_many"), short.alias("_short"), up.alias("_up"), down.alias("_down"), ((F.col(score) - F.avg(score).over(day())) / spread).alias("z")).filter(F.col("_n") >= least).withColumn(
        "side", F.when(F.col("_up") <= F.col("_many"), 1).when(F.col("_down") <= F.col("_short"), -1).otherwise(0)
    ).drop("_n", "_many", "_short", "_up", "_down")


def average_rank(score: str) -> Column:
    """Rank from the best of the day, ties share the mean of their places."""
    return F.rank().over(day().orderBy(F.desc(score))) + (F.count("*").over(Window.partitionBy("d", score)) - 1) / 2


def inverse_vol_weights(vol: str) -> Column:
    inverse = F.try_divide(F.lit(1.0), F.col(vol))
    return F.try_divide(inverse, F.sum(inverse).over(day()))
