"""Statistics against overfitting: combinatorial splits, bootstraps, deflated Sharpe ratios.

Returns are reduced to sums per strategy and block before anything is combined, so that only blocks are combined, never rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def halves(spark: SparkSession, blocks: int) -> DataFrame:
    """(split, block, inside) of every choice of half of the blocks."""
    every = spark.range(1 << blocks).filter(F.bit_count("id") == blocks // 2)
    return every.select(F.col("id").alias("split"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).withColumn("inside", F.col("split").bitwiseAND(F.pow(F.lit(2), "block").cast("long")) > 0)


def overfitting(returns: DataFrame, blocks: int = 8) -> DataFrame:
    """One row (splits, pbo): of returns (strategy, block, r), in which share of the splits the strategy that is best inside ranks in the worse half outside."""
    sums = returns.groupBy("strategy", "block").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    split = sums.join(F.broadcast(halves(returns.sparkSession, blocks)), "block").groupBy("split", "strategy", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    sharpe = F.coalesce(F.try_divide(mean, F.sqrt(F.greatest((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))), F.lit(0.0))
    both = split.withColumn("x", F.round(sharpe, 9)).groupBy("split", "strategy").agg(F.max(F.when(F.col("inside"), F.col("x"))).alias("a"), F.max(F.when(~F.col("inside"), F.col("x"))).alias("b"))
    w = Window.partitionBy("split")
    placed = both.withColumns({"best": F.row_number().over(w.orderBy(F.desc("a"), "strategy")), "rank": F.row_number().over(w.orderBy("b", "strategy")), "many": F.count("*").over(w)})
    return placed.filter("best = 1").agg(F.count("*").alias("splits"), F.avg((2 * F.col("rank") <= F.col("many") + 1).cast("double")).alias("pbo"))


def purged_splits(rows: DataFrame, groups: int, tested: int, purge: int, embargo: int) -> DataFrame:
    """(split, n_test, n_train) of rows (i, g: group): every choice of tested groups; training rows within purge before or embargo
    after a tested stretch are left out. Groups are joined, rows only counted."""
    spark = rows.sparkSession
    ends = rows.groupBy("g").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    choice = spark.range(1 << groups).filter(F.bit_count("id") == tested).select(F.col("id").alias("split"))
    in_split = F.col("split").bitwiseAND(F.pow(F.lit(2), "g").cast("long")) > 0
    chosen = ends.crossJoin(F.broadcast(choice)).withColumn("test", in_split)
    w = Window.partitionBy("split").orderBy("g")
    around = chosen.withColumns({"after": F.coalesce(F.lag("test").over(w), F.lit(False)), "before": F.coalesce(F.lead("test").over(w), F.lit(False))})
    size = F.col("hi") - F.col("lo") + 1
    lost = F.least(size, F.when(F.col("after"), F.lit(embargo)).otherwise(0) + F.when(F.col("before"), F.lit(purge)).otherwise(0))
    return around.groupBy("split").agg(F.sum(F.when(F.col("test"), size).otherwise(0)).alias("n_test"), F.sum(F.when(~F.col("test"), size - lost).otherwise(0)).alias("n_train"))


def _block_draws(spark: SparkSession, n: int, draws: int, length: int, seed: int) -> DataFrame:
    """(draw, i) of circular blocks of n places, n places a draw; blocks start at a hash."""
    blocks = math.ceil(n / length)
    places = spark.range(draws * blocks).select(F.floor(F.col("id") / blocks).alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("s"), (F.col("id") % blocks).alias("b"))
    return places.select("draw", F.explode(F.sequence(F.lit(0), F.least(F.lit(length - 1), n - 1 - F.col("b") * length).cast("int"))).alias("k"), "s").select("draw", ((F.col("s") + F.col("k")) % n).alias("i"))


def block_bootstrap(returns: DataFrame, draws: int, length: int, seed: int = 42) -> DataFrame:
    """(draw, mean, total) of circular block samples of returns (i from 0, r), as long as the sample; blocks start at a hash."""
    spark = returns.sparkSession
    n = returns.count()
    if not n:
        return spark.createDataFrame([], "draw bigint, mean double, total double")
    return _block_draws(spark, n, draws, length, seed).join(returns, "i").groupBy("draw").agg(F.avg("r").alias("mean"), F.sum("r").alias("total"))


def paired_bootstrap(pairs: DataFrame, draws: int, length: int, periods: int, seed: int = 42) -> DataFrame:
    """(draw, sharpe_a, sharpe_b, delta: b less a) of circular block samples of aligned returns (i from 0, a, b), both from the same places; periods a year."""
    spark = pairs.sparkSession
    n = pairs.count()
    if not n:
        return spark.createDataFrame([], "draw bigint, sharpe_a double, sharpe_b double, delta double")
    sharpe = {c: F.coalesce(F.try_divide(F.avg(c), F.stddev_samp(c)) * math.sqrt(periods), F.lit(0.0)) for c in ("a", "b")}
    found = _block_draws(spark, n, draws, length, seed).join(pairs, "i").groupBy("draw").agg(*[x.alias(f"sharpe_{c}") for c, x in sharpe.items()])
    return found.withColumn("delta", F.col("sharpe_b") - F.col("sharpe_a"))


def drawdown_paths(trades: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """(draw, drawdown, total) of paths of as many trades (i from 0, r: simple return) as there are, drawn with replacement: the worst
    fall from a peak of the equity, which begins at 1, and the return of the whole path. A trade that loses everything ends at 0."""
    spark = trades.sparkSession
    n = trades.count()
    if not n:
        return spark.createDataFrame([], "draw bigint, drawdown double, total double")
    places = spark.range(draws * n).select(F.floor(F.col("id") / n).alias("draw"), F.col("id").alias("k"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("i"))
    log = F.when(F.col("r") <= -1, F.lit(float("-inf"))).otherwise(F.log1p("r"))
    so_far = Window.partitionBy("draw").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = places.join(trades, "i").withColumn("equity", F.sum(log).over(so_far)).withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(so_far)))
    return path.groupBy("draw").agg(F.max(1 - F.exp(F.col("equity") - F.col("peak"))).alias("drawdown"), (F.exp(F.max_by("equity", "k")) - 1).alias("total"))


def expected_max_sharpe(trials: int, variance: float) -> float:
    """Of so many independent trials without skill."""
    if trials < 2:
        return 0.0
    z, g = NormalDist().inv_cdf, 0.5772156649015329
    return math.sqrt(variance) * ((1 - g) * z(1 - 1 / trials) + g * z(1 - 1 / (trials * math.e)))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, trials: int, variance: float) -> float:
    """Probability that the Sharpe ratio per period is above what the best of the trials reaches by chance; kurtosis 3 is normal."""
    below = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    return NormalDist().cdf((sharpe - expected_max_sharpe(trials, variance)) * math.sqrt(max(n - 1, 0)) / math.sqrt(max(below, 1e-12)))
