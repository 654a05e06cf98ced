"""Queries of smaller tables: counts by family, races, tails, ranks within groups, calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.plans.bars import day_bars
from tidemark.plans.indicators import rounded
from tidemark.plans.joins import BARS


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def a39_runs_seen(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count("*").alias("n"))


def a41_base_rates(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").withColumn("won", (F.col("l_discount") > 0.05).cast("double"))
    sets = t.groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")], []], "l_returnflag", "l_linestatus")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("won"), 6).alias("rate"))


def a42_families(spark, sf_dir):
    return _table(spark, sf_dir, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("family")).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


def a45_race(spark, sf_dir):
    """Each series rebased to its first close: where it stands, its current and worst drawdown, its days."""
    run = w.ordered().rowsBetween(Window.unboundedPreceding, 0)
    b = day_bars(spark, sf_dir).withColumns({"x": F.col("c") / F.first("c").over(run), "dd": w.drawdown("c")})
    return rounded(b.groupBy("instrument").agg(F.max_by("x", "d").alias("now"), F.max_by("dd", "d").alias("dd"), F.min("dd").alias("worst"), F.count("*").alias("days")), ["instrument"])


def a54_trade_metrics(spark, sf_dir):
    """Losses below 0 and losses at or below 0, side by side."""
    p = F.round(F.col("l_extendedprice") * (F.col("l_discount") - 0.05), 2)
    t = _table(spark, sf_dir, "lineitem").withColumn("p", p)
    return t.groupBy("l_returnflag").agg(F.count_if(F.col("p") > 0).alias("wins"), F.count_if(F.col("p") < 0).alias("losses"), F.count_if(F.col("p") <= 0).alias("not_won"))


def r10_best_three(spark, sf_dir):
    g = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("x"), F.count("*").alias("n")).filter("n >= 8")
    k = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("x"), "l_suppkey"))
    return g.withColumn("k", k.cast("long")).filter("k <= 3")


def r11_worst_five(spark, sf_dir):
    day = _table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    return day.orderBy("x", "d").limit(5)


def r16_calendar(spark, sf_dir):
    """Days of either table, and which has them."""
    a = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("a", F.lit(1))
    b = _table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "d", "full_outer").select("d", F.col("a").isNotNull().alias("ordered"), F.col("b").isNotNull().alias("shipped"))


def r17_every_fifth(spark, sf_dir):
    b = day_bars(spark, sf_dir).withColumn("i", F.row_number().over(w.ordered()))
    return b.filter("i % 5 = 1").select("instrument", "d", "c")


def w36_relative_strength(spark, sf_dir):
    """Return of 21 bars less that of the mean instrument of the day."""
    b = day_bars(spark, sf_dir).withColumn("r", w.simple_return(n=21)).filter("r IS NOT NULL")
    return rounded(b.select("instrument", "d", (F.col("r") - F.avg("r").over(Window.partitionBy("d"))).alias("rs")), ["instrument", "d"])


def w49_last_of_month(spark, sf_dir):
    later = F.lead("d").over(w.ordered())
    return day_bars(spark, sf_dir).select("instrument", "d", F.coalesce(F.trunc(later, "MM") != F.trunc("d", "MM"), F.lit(True)).alias("month_end"), F.coalesce(F.date_trunc("week", later) != F.date_trunc("week", "d"), F.lit(True)).alias("week_end"))


def p20_filters(spark, sf_dir):
    """Orders by several criteria at once, all of which reach the scan."""
    o = _table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 100000) & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")))
    return o.select("o_orderkey", "o_orderpriority", "o_totalprice")


_ORD = "(PARTITION BY instrument ORDER BY d)"
ORACLE_SQL = {
    "a39_runs_seen": "SELECT o_custkey, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS n FROM orders GROUP BY 1",
    "a41_base_rates": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(CAST(l_discount > 0.05 AS DOUBLE)), 6) AS rate FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "a42_families": "SELECT split_part(p_type, ' ', 1) AS family, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1",
    "a45_race": f"WITH {BARS}, x AS (SELECT *, c / first_value(c) OVER {_ORD} AS x, c / max(c) OVER {_ORD} - 1 AS dd FROM day_bars) SELECT instrument, round(max_by(x, d), 6) AS now, round(max_by(dd, d), 6) AS dd, round(min(dd), 6) AS worst, count(*) AS days FROM x GROUP BY 1",
    "a54_trade_metrics": "WITH t AS (SELECT l_returnflag, round(l_extendedprice * (l_discount - 0.05), 2) AS p FROM lineitem) SELECT l_returnflag, count(*) FILTER (p > 0) AS wins, count(*) FILTER (p < 0) AS losses, count(*) FILTER (p <= 0) AS not_won FROM t GROUP BY 1",
    "r10_best_three": "WITH g AS (SELECT l_returnflag, l_suppkey, round(sum(l_extendedprice * l_discount), 2) AS x, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 8) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY x DESC, l_suppkey) AS k FROM g) WHERE k <= 3",
    "r11_worst_five": "SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY 1 ORDER BY x, d LIMIT 5",
    "r16_calendar": "WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) SELECT coalesce(a.d, b.d) AS d, a.d IS NOT NULL AS ordered, b.d IS NOT NULL AS shipped FROM a FULL JOIN b ON a.d = b.d",
    "r17_every_fifth": f"WITH {BARS} SELECT instrument, d, c FROM (SELECT *, row_number() OVER {_ORD} AS i FROM day_bars) WHERE i % 5 = 1",
    "w36_relative_strength": f"WITH {BARS}, x AS (SELECT instrument, d, c / lag(c, 21) OVER {_ORD} - 1 AS r FROM day_bars) SELECT instrument, d, round(r - avg(r) OVER (PARTITION BY d), 6) AS rs FROM x WHERE r IS NOT NULL",
    "w49_last_of_month": f"WITH {BARS} SELECT instrument, d, coalesce(date_trunc('month', lead(d) OVER {_ORD}) <> date_trunc('month', d), true) AS month_end, coalesce(date_trunc('week', lead(d) OVER {_ORD}) <> date_trunc('week', d), true) AS week_end FROM day_bars",
    "p20_filters": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000 AND o_orderdate >= '1996-01-01'",
}
QUERIES = {f.__name__: f for f in (a39_runs_seen, a41_base_rates, a42_families, a45_race, a54_trade_metrics, r10_best_three, r11_worst_five, r16_calendar, r17_every_fifth, w36_relative_strength, w49_last_of_month, p20_filters)}
