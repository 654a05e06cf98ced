"""Queries over trade records: links, lifts, lifetimes, stresses, and readings of texts and JSON."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.functions import parsing, scores
from tidemark.operators import alignment
from tidemark.plans.indicators import rounded


def _li(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("pnl", F.col("l_extendedprice") * (F.col("l_discount") - 0.05))


def a9_signal_lift(spark, sf_dir):
    """Win rate of fills with and without each of four labels, and the difference."""
    labels = F.array(F.struct(F.lit("large").alias("k"), (F.col("l_quantity") > 25).alias("on")), F.struct(F.lit("taxed").alias("k"), (F.col("l_tax") > 0.04).alias("on")), F.struct(F.lit("returned").alias("k"), (F.col("l_returnflag") == "R").alias("on")), F.struct(F.lit("first").alias("k"), (F.col("l_linenumber") == 1).alias("on")))
    x = _li(spark, sf_dir).select(F.explode(labels).alias("s"), (F.col("pnl") > 0).cast("double").alias("won"))
    g = x.groupBy(F.col("s.k").alias("label")).agg(F.avg(F.when(F.col("s.on"), F.col("won"))).alias("aligned"), F.avg(F.when(~F.col("s.on"), F.col("won"))).alias("misaligned"), F.count_if("s.on").alias("n"))
    return rounded(g.withColumn("lift", F.col("aligned") - F.col("misaligned")), ["label"])


def a27_exposure_over_time(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("x"))
    return o.groupBy("o_orderpriority").agg(F.round(F.max("x"), 2).alias("most"), F.round(F.avg("x"), 2).alias("mean"), F.round(F.avg((F.col("x") > 500000).cast("double")), 6).alias("above"), F.max_by("d", F.struct("x", "d")).alias("at"))


def a28_stress(spark, sf_dir):
    """Each day's exposure times the shock of its class: worst, fifth percentile and median day."""
    shock = F.when(F.col("o_orderpriority") < "2", -0.2).when(F.col("o_orderpriority") < "4", -0.1).otherwise(0.05)
    day = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum(F.col("o_totalprice") * shock).alias("x"))
    return day.agg(F.round(F.min("x"), 2).alias("worst"), F.round(F.percentile("x", F.lit(0.05)), 2).alias("p05"), F.round(F.percentile("x", F.lit(0.5)), 2).alias("median"))


def _scaled_round(x: Column, digits: int) -> Column:
    """x rounded as its SQL does it: the product of x and the power of ten, halves away from zero. (round alone goes by the shortest digits of x: 1.005 becomes 1.01 there, 1.0 here.)"""
    return F.round(x * 10.0**digits) / 10.0**digits


def a35_breach_days(spark, sf_dir):
    """Days on which a supplier's running result falls more than a limit below its peak, and the best day's share of gains.

    A day's fills are added in the order of their keys: in another order the last bit may differ, and so a sum that ends in half a cent."""
    fills = _li(spark, sf_dir).filter("pnl IS NOT NULL").groupBy("l_suppkey", F.to_date("l_shipdate").alias("d"))
    day = fills.agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "pnl"))).alias("f"))
    day = day.select("l_suppkey", "d", _scaled_round(F.aggregate("f", F.lit(0.0), lambda s, f: s + f["pnl"]), 2).alias("x"))
    run = Window.partitionBy("l_suppkey").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    e = day.withColumn("e", _scaled_round(F.sum("x").over(run), 2)).withColumn("dd", F.greatest(F.max("e").over(run), F.lit(0.0)) - F.col("e"))
    g = e.groupBy("l_suppkey").agg(F.count_if(F.col("x") < -3000).alias("daily"), F.count_if(F.col("dd") > 8000).alias("trailing"), _scaled_round(F.try_divide(F.max("x"), F.sum(F.greatest("x", F.lit(0.0)))), 6).alias("best_share"))
    return g


def a43_newest_gates(spark, sf_dir):
    """The newest order of each customer and status, counted by status."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    newest = o.groupBy("o_custkey", "o_orderstatus").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return newest.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"))


def a44_coverage(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def a48_compounded(spark, sf_dir):
    """What 1 becomes over a supplier's fills at a thousandth of each result per unit of price."""
    x = F.log1p(F.col("pnl") / F.col("l_extendedprice") / 10)
    return rounded(_li(spark, sf_dir).groupBy("l_suppkey").agg(F.exp(F.sum(x)).alias("equity"), F.count("*").alias("n")), ["l_suppkey"])


def j15_signature_link(spark, sf_dir):
    """Pending orders linked to the filled one of their priority whose price is nearest within 2 per cent, the least key of equal ones."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    asked = o.filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority", "o_totalprice")
    filled = o.filter("o_orderstatus = 'F'").select("o_orderpriority", "o_totalprice", F.col("o_orderkey").alias("linked"))
    near = alignment.nearest_level(asked, filled, "o_orderpriority", "o_totalprice", "linked", 0.02)
    return near.groupBy("o_orderkey").agg(F.min(F.struct("gap", "linked")).alias("b")).select("o_orderkey", "b.linked")


def j17_dimension(spark, sf_dir):
    """Customers with their region, segments by balance."""
    r, n = spark.read.parquet(f"{sf_dir}/region.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    named = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "r_name")
    return c.join(named, c["c_nationkey"] == named["n_nationkey"], "left").groupBy(F.coalesce("r_name", F.lit("none")).alias("region"), "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def f11_json_field(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("k").alias("n"))


def f39_sessions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(parsing.session_of(F.col("ts")).alias("session")).agg(F.count("*").alias("n"))


def f23_crowding(spark, sf_dir):
    g = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)).alias("long"), F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).otherwise(0.0)).alias("short"))
    return g.select("l_suppkey", "long", "short", scores.crowding(F.col("long"), F.col("short")).alias("label"))


def z_sessions(spark, sf_dir):
    """Sessions of a user: events at most six hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp"))
    numbered = e.withColumn("_new", F.when(gap.isNull() | (gap > 21600), 1).otherwise(0)).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


_L = "li AS (SELECT *, l_extendedprice * (l_discount - 0.05) AS pnl FROM lineitem)"
_LABELS = {"large": "l_quantity > 25", "taxed": "l_tax > 0.04", "returned": "l_returnflag = 'R'", "first": "l_linenumber = 1"}
_H = "hour(ts)"
ORACLE_SQL = {
    "a9_signal_lift": f"WITH {_L}, x AS ({' UNION ALL '.join(f'SELECT {chr(39)}{k}{chr(39)} AS label, {c} AS s, CAST(pnl > 0 AS DOUBLE) AS won FROM li' for k, c in _LABELS.items())}) SELECT label, round(avg(won) FILTER (s), 6) AS aligned, round(avg(won) FILTER (NOT s), 6) AS misaligned, count(*) FILTER (s) AS n, round(avg(won) FILTER (s) - avg(won) FILTER (NOT s), 6) AS lift FROM x GROUP BY 1",
    "a27_exposure_over_time": "WITH x AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2) SELECT o_orderpriority, round(max(x), 2) AS most, round(avg(x), 2) AS mean, round(avg(CAST(x > 500000 AS DOUBLE)), 6) AS above, max_by(d, (x, d)) AS at FROM x GROUP BY 1",
    "a28_stress": "WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice * CASE WHEN o_orderpriority < '2' THEN -0.2::DOUBLE WHEN o_orderpriority < '4' THEN -0.1::DOUBLE ELSE 0.05::DOUBLE END) AS x FROM orders GROUP BY 1) SELECT round(min(x), 2) AS worst, round(quantile_cont(x, 0.05), 2) AS p05, round(quantile_cont(x, 0.5), 2) AS median FROM x",
    "a35_breach_days": f"WITH {_L}, x AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, round(sum(pnl), 2) AS x FROM li GROUP BY 1, 2), e AS (SELECT *, round(sum(x) OVER w, 2) AS e FROM x WINDOW w AS (PARTITION BY l_suppkey ORDER BY d)), g AS (SELECT *, greatest(max(e) OVER (PARTITION BY l_suppkey ORDER BY d), 0) - e AS dd FROM e) SELECT l_suppkey, count(*) FILTER (x < -3000) AS daily, count(*) FILTER (dd > 8000) AS trailing, round(max(x) / nullif(sum(greatest(x, 0)), 0), 6) AS best_share FROM g GROUP BY 1",
    "a43_newest_gates": "WITH x AS (SELECT o_custkey, o_orderstatus, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS x FROM orders GROUP BY 1, 2) SELECT o_orderstatus, count(*) AS n, round(avg(x), 4) AS mean FROM x GROUP BY 1",
    "a44_coverage": "SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    "a48_compounded": f"WITH {_L} SELECT l_suppkey, round(exp(sum(ln(1 + pnl / l_extendedprice / 10))), 6) AS equity, count(*) AS n FROM li GROUP BY 1",
    "j15_signature_link": "SELECT o.o_orderkey, min_by(s.o_orderkey, (abs(s.o_totalprice - o.o_totalprice), s.o_orderkey)) AS linked FROM orders o JOIN orders s ON o.o_orderpriority = s.o_orderpriority AND o.o_orderstatus = 'P' AND s.o_orderstatus = 'F' AND abs(s.o_totalprice - o.o_totalprice) <= 0.02 * o.o_totalprice GROUP BY 1",
    "j17_dimension": "SELECT coalesce(r_name, 'none') AS region, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "f11_json_field": "SELECT event_type, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS k, count(props->>'k') AS n FROM events GROUP BY 1",
    "f39_sessions": f"SELECT CASE WHEN isodow(ts) >= 6 THEN 'weekend' WHEN {_H} >= 13 AND {_H} < 17 THEN 'london/new york' WHEN {_H} >= 8 AND {_H} < 17 THEN 'london' WHEN {_H} >= 13 AND {_H} < 21 THEN 'new york' ELSE 'asia' END AS session, count(*) AS n FROM events GROUP BY 1",
    "f23_crowding": "WITH g AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS long, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS short FROM lineitem GROUP BY 1), x AS (SELECT *, floor(long / nullif(long + short, 0) * 100 + 0.5) AS pct FROM g) SELECT l_suppkey, long, short, CASE WHEN pct >= 75 THEN 'crowded long' WHEN pct <= 25 THEN 'crowded short' WHEN pct IS NOT NULL THEN 'balanced' END AS label FROM x",
    "z_sessions": "WITH x AS (SELECT *, CASE WHEN epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) <= 21600 THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM x) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM y GROUP BY user_id, session",
}
QUERIES = {f.__name__: f for f in (a9_signal_lift, a27_exposure_over_time, a28_stress, a35_breach_days, a43_newest_gates, a44_coverage, a48_compounded, j15_signature_link, j17_dimension, f11_json_field, f39_sessions, f23_crowding, z_sessions)}
