"""Queries of joins in time, resampling and quality of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import alignment, bars as ops
from tidemark.plans.bars import DAY_BARS_SQL, day_bars
from tidemark.plans.indicators import rounded

BARS = f"day_bars AS ({DAY_BARS_SQL})"
HOURS = """hour_bars AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS t, min_by(value, event_id) AS o, max(value) AS h, min(value) AS l,
 max_by(value, event_id) AS c, CAST(count(*) AS BIGINT) AS v FROM events WHERE value > 0 GROUP BY 1, 2)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("value > 0")
    return e.groupBy(F.col("event_type").alias("instrument"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(
        F.min_by("value", "event_id").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "event_id").alias("c"), F.count("*").alias("v")
    )


def j2_align_fill(spark, sf_dir):
    return alignment.aligned(day_bars(spark, sf_dir), "instrument", "d", "c")


def _ticks(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.col("event_type").alias("instrument"), F.col("ts").alias("t"))


def j3_asof_backward(spark, sf_dir):
    right = hour_bars(spark, sf_dir).withColumnRenamed("c", "close").select("instrument", "t", "close")
    return alignment.asof(_ticks(spark, sf_dir), right, "instrument", "t", ["close"]).select("event_id", "close")


def j5_asof_forward(spark, sf_dir):
    right = hour_bars(spark, sf_dir).withColumnRenamed("c", "close").select("instrument", "t", "close")
    return alignment.asof(_ticks(spark, sf_dir), right, "instrument", "t", ["close"], forward=True).select("event_id", "close")


def _large(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("event"), F.col("o_orderpriority").alias("instrument"), F.date_add(F.to_date("o_orderdate"), 1).alias("d"))


def j9_ordinal_band(spark, sf_dir):
    return alignment.band(_large(spark, sf_dir), day_bars(spark, sf_dir).select("instrument", "d", "c"), "instrument", "d", 2).select("event", "instrument", "offset", "d", "c")


def j13_nearest(spark, sf_dir):
    right = day_bars(spark, sf_dir).filter("v >= 3").select("instrument", "d", F.col("c").alias("close"))
    return alignment.nearest(_large(spark, sf_dir), right, "instrument", "d", ["close"], 4).select("event", "close")


def j14_open_interest(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    trades = o.select(F.col("o_orderpriority").alias("instrument"), F.to_date("o_orderdate").alias("entry"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 10 + 1).cast("int")).alias("exit"), F.col("o_totalprice").alias("notional"))
    return rounded(alignment.active_notional(day_bars(spark, sf_dir).select("instrument", "d"), trades, "instrument", "d").withColumn("notional", F.round("notional", 2)), ["instrument", "d"])


def j10_inner_returns(spark, sf_dir):
    b = day_bars(spark, sf_dir).filter(F.col("instrument").isin("1-URGENT", "2-HIGH"))
    wide = b.groupBy("d").agg(F.max(F.when(F.col("instrument") == "1-URGENT", F.col("c"))).alias("a"), F.max(F.when(F.col("instrument") == "2-HIGH", F.col("c"))).alias("b"))
    return wide.dropna()


def j11_semi_dates(spark, sf_dir):
    b = day_bars(spark, sf_dir)
    return b.join(hour_like_days(spark, sf_dir), "d", "left_semi").select("instrument", "d", "c")


def hour_like_days(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity >= 49").select(F.to_date("l_shipdate").alias("d")).distinct()


def j12_anti_dates(spark, sf_dir):
    return day_bars(spark, sf_dir).join(hour_like_days(spark, sf_dir), "d", "left_anti").select("instrument", "d", "c")


def j19_legs(spark, sf_dir):
    e = _events(spark, sf_dir)
    legs = e.select(F.explode(F.array(F.struct(F.col("event_type").alias("leg"), F.col("value").alias("s")), F.struct(F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("leg"), (-F.col("value")).alias("s")))).alias("x"))
    return legs.groupBy("x.leg").agg(F.round(F.avg("x.s"), 6).alias("score"), F.count("*").alias("n"))


def j20_pair_correlation(spark, sf_dir):
    """Correlation of daily returns of each two instruments, over the days that both have."""
    from tidemark.functions import windows as w

    r = day_bars(spark, sf_dir).withColumn("r", w.log_return()).filter("r IS NOT NULL").select("instrument", "d", "r")
    a, b = r.select(F.col("instrument").alias("a"), "d", F.col("r").alias("ra")), r.select(F.col("instrument").alias("b"), "d", F.col("r").alias("rb"))
    return a.join(b, "d").filter("a < b").groupBy("a", "b").agg(F.round(F.corr("ra", "rb"), 6).alias("corr"), F.count("*").alias("n"))


def j21_reconciliation(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")).distinct().withColumn("_o", F.lit(True))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct().withColumn("_l", F.lit(True))
    state = F.when(F.col("_l").isNull(), "missing_in_broker").when(F.col("_o").isNull(), "unknown_in_broker").otherwise("in_sync")
    return o.join(li, "k", "full_outer").groupBy(state.alias("state")).count().withColumnRenamed("count", "n")


def p2_quality(spark, sf_dir):
    raw = _events(spark, sf_dir).select(F.col("event_type").alias("instrument"), F.date_trunc("hour", "ts").alias("t"), F.col("value").alias("o"), (F.col("value") + F.col("event_id") % 3 - 1).alias("h"), (F.col("value") - 1).alias("l"), F.col("value").alias("c"))
    return ops.quality(raw)


def p3_gaps(spark, sf_dir):
    return ops.gaps(day_bars(spark, sf_dir))


def p4_weekdays(spark, sf_dir):
    return day_bars(spark, sf_dir).groupBy("instrument", F.weekday("d").cast("long").alias("weekday")).agg(F.count("*").alias("n"))


def p5_clean(spark, sf_dir):
    raw = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("instrument"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"), F.col("value").alias("o"), (F.col("value") + F.col("event_id") % 3 - 1).alias("h"), (F.col("value") - 1).alias("l"), F.col("value").alias("c"), F.lit(None).cast("long").alias("v"))
    return ops.cleaned(raw, "t", "event_id").filter("l > 0")


def p7_session_date(spark, sf_dir):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    return _events(spark, sf_dir).select("event_id", F.date_add(F.to_date(local), 1).alias("session"))


def p8_off_calendar(spark, sf_dir):
    day, hour = F.weekday("ts"), F.hour("ts")
    off = (day == 5) | ((day == 6) & (hour < 21)) | ((day == 4) & (hour >= 22))
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count_if(off).alias("off"), F.count("*").alias("n"))


def p15_last_bars(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("d")))
    return day_bars(spark, sf_dir).withColumn("k", rank.cast("long")).filter("k <= 5").select("instrument", "d", "c", "k")


def p16_latest(spark, sf_dir):
    return day_bars(spark, sf_dir).groupBy("instrument").agg(F.max("d").alias("d"), F.max_by("c", "d").alias("c"))


def _flat(df: DataFrame) -> DataFrame:
    return rounded(df, ["instrument", "t"])


def a1_resample_month(spark, sf_dir):
    return _flat(ops.resampled(day_bars(spark, sf_dir), F.trunc("d", "MM")))


def a2_complete_4h(spark, sf_dir):
    at = F.col("t").cast("timestamp")
    bucket = (F.date_trunc("day", at) + F.make_dt_interval(hours=F.floor(F.hour(at) / 4).cast("int") * 4)).cast("timestamp_ntz")
    return _flat(ops.resampled(hour_bars(spark, sf_dir), bucket, "t").filter("n = 4"))


def a3_chunks(spark, sf_dir):
    return _flat(ops.chunks(day_bars(spark, sf_dir), 4))


def a4_iso_week(spark, sf_dir):
    return _flat(ops.resampled(day_bars(spark, sf_dir), F.date_trunc("week", "d").cast("date")))


def a5_bars_a_week(spark, sf_dir):
    weeks = ops.resampled(day_bars(spark, sf_dir), F.date_trunc("week", "d").cast("date"))
    return weeks.groupBy("instrument", "n").agg(F.count("*").alias("weeks"))


_RESAMPLED = "min_by(o, {t}) AS o, max(h) AS h, min(l) AS l, max_by(c, {t}) AS c, CAST(sum(v) AS BIGINT) AS v, count(*) AS n"
_LARGE = "large AS (SELECT o_orderkey AS event, o_orderpriority AS instrument, CAST(o_orderdate AS DATE) + 1 AS d FROM orders)"
_RAW = "raw AS (SELECT event_id, event_type AS instrument, date_trunc('hour', ts) AS t, value AS o, value + event_id % 3 - 1 AS h, value - 1 AS l, value AS c FROM events)"
_WD = "(floor(datediff('day', DATE '1900-01-01', {x}) / 7) * 5 + least(datediff('day', DATE '1900-01-01', {x}) % 7 + 1, 5))"
_SHIP = "ship AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_quantity >= 49)"

ORACLE_SQL = {
    "j2_align_fill": f"WITH {BARS}, s AS (SELECT * FROM (SELECT DISTINCT d FROM day_bars), (SELECT DISTINCT instrument FROM day_bars)) SELECT s.instrument, s.d, b.c FROM s ASOF LEFT JOIN day_bars b ON s.instrument = b.instrument AND s.d >= b.d",
    "j3_asof_backward": f"WITH {HOURS} SELECT e.event_id, b.c AS close FROM events e ASOF LEFT JOIN hour_bars b ON e.event_type = b.instrument AND e.ts >= b.t",
    "j5_asof_forward": f"WITH {HOURS} SELECT e.event_id, b.c AS close FROM events e ASOF LEFT JOIN hour_bars b ON e.event_type = b.instrument AND e.ts <= b.t",
    "j9_ordinal_band": f'WITH {BARS}, {_LARGE}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY d) AS i FROM day_bars), p AS (SELECT l.event, l.instrument, n.i FROM large l ASOF JOIN n ON l.instrument = n.instrument AND l.d <= n.d) SELECT p.event, p.instrument, CAST(n.i - p.i AS INT) AS "offset", n.d, n.c FROM p JOIN n ON p.instrument = n.instrument AND n.i BETWEEN p.i - 2 AND p.i + 2',
    "j10_inner_returns": f"WITH {BARS} SELECT a.d, a.c AS a, b.c AS b FROM day_bars a JOIN day_bars b ON a.d = b.d AND a.instrument = '1-URGENT' AND b.instrument = '2-HIGH'",
    "j11_semi_dates": f"WITH {BARS}, {_SHIP} SELECT instrument, d, c FROM day_bars WHERE d IN (SELECT d FROM ship)",
    "j12_anti_dates": f"WITH {BARS}, {_SHIP} SELECT instrument, d, c FROM day_bars WHERE d NOT IN (SELECT d FROM ship)",
    "j13_nearest": f"WITH {BARS}, {_LARGE}, n AS (SELECT * FROM day_bars WHERE v >= 3), x AS (SELECT l.event, n.c, abs(datediff('day', l.d, n.d)) AS gap, n.d, row_number() OVER (PARTITION BY l.event ORDER BY abs(datediff('day', l.d, n.d)), n.d) AS k FROM large l JOIN n ON l.instrument = n.instrument AND abs(datediff('day', l.d, n.d)) <= 4) SELECT l.event, x.c AS close FROM large l LEFT JOIN x ON l.event = x.event AND x.k = 1",
    "j14_open_interest": f"WITH {BARS}, t AS (SELECT o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS entry, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 + 1 AS INT) AS ex, o_totalprice AS x FROM orders) SELECT b.instrument, b.d, CAST(count(t.x) AS BIGINT) AS n_open, round(coalesce(sum(t.x), 0), 2) AS notional FROM day_bars b LEFT JOIN t ON b.instrument = t.instrument AND b.d >= t.entry AND b.d < t.ex GROUP BY 1, 2",
    "j19_legs": "SELECT leg, round(avg(s), 6) AS score, count(*) AS n FROM (SELECT event_type AS leg, value AS s FROM events UNION ALL SELECT 'user' || (user_id % 7), -value FROM events) GROUP BY 1",
    "j20_pair_correlation": f"WITH {BARS}, r AS (SELECT instrument, d, ln(c / lag(c) OVER (PARTITION BY instrument ORDER BY d)) AS r FROM day_bars), f AS (SELECT * FROM r WHERE r IS NOT NULL) SELECT a.instrument AS a, b.instrument AS b, round(corr(a.r, b.r), 6) AS corr, count(*) AS n FROM f a JOIN f b ON a.d = b.d AND a.instrument < b.instrument GROUP BY 1, 2",
    "j21_reconciliation": "WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT CASE WHEN l.k IS NULL THEN 'missing_in_broker' WHEN o.k IS NULL THEN 'unknown_in_broker' ELSE 'in_sync' END AS state, count(*) AS n FROM o FULL JOIN l ON o.k = l.k GROUP BY 1",
    "p2_quality": f"WITH {_RAW} SELECT instrument, count(*) AS n_rows, count(*) - count(DISTINCT t) AS duplicates, CAST(0 AS BIGINT) AS null_rows, count(*) FILTER (least(o, h, l, c) <= 0) AS nonpositive, count(*) FILTER (h < l OR h < o OR h < c OR l > o OR l > c) AS violations FROM raw GROUP BY 1",
    "p3_gaps": f"WITH {BARS}, x AS (SELECT instrument, lag(d) OVER (PARTITION BY instrument ORDER BY d) AS p, d FROM day_bars), y AS (SELECT instrument, p AS after, d AS before, CAST({_WD.format(x='d')} - {_WD.format(x='p')} - CASE WHEN isodow(d) < 6 THEN 1 ELSE 0 END AS BIGINT) AS missing FROM x WHERE p IS NOT NULL) SELECT * FROM y WHERE missing > 1",
    "p4_weekdays": f"WITH {BARS} SELECT instrument, isodow(d) - 1 AS weekday, count(*) AS n FROM day_bars GROUP BY 1, 2",
    "p5_clean": f"WITH {_RAW}, k AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY instrument, t ORDER BY event_id DESC) = 1) SELECT instrument, t, o, greatest(o, h, l, c) AS h, least(o, h, l, c) AS l, c, 0 AS v FROM k WHERE o > 0 AND h > 0 AND l > 0 AND c > 0",
    "p7_session_date": "SELECT event_id, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) + 1 AS session FROM events",
    "p8_off_calendar": "SELECT event_type, count(*) FILTER (isodow(ts) = 6 OR (isodow(ts) = 7 AND hour(ts) < 21) OR (isodow(ts) = 5 AND hour(ts) >= 22)) AS off, count(*) AS n FROM events GROUP BY 1",
    "p15_last_bars": f"WITH {BARS} SELECT instrument, d, c, k FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY d DESC) AS k FROM day_bars) WHERE k <= 5",
    "p16_latest": f"WITH {BARS} SELECT instrument, max(d) AS d, max_by(c, d) AS c FROM day_bars GROUP BY 1",
    "a1_resample_month": f"WITH {BARS} SELECT instrument, CAST(date_trunc('month', d) AS DATE) AS t, {_RESAMPLED.format(t='d')} FROM day_bars GROUP BY 1, 2",
    "a2_complete_4h": f"WITH {HOURS} SELECT instrument, time_bucket(INTERVAL 4 HOUR, t, TIMESTAMP '2000-01-01') AS t, {_RESAMPLED.format(t='hour_bars.t')} FROM hour_bars GROUP BY 1, 2 HAVING count(*) = 4",
    "a3_chunks": f"WITH {BARS}, n AS (SELECT *, (row_number() OVER (PARTITION BY instrument ORDER BY d) - 1) // 4 AS k FROM day_bars) SELECT instrument, min(d) AS t, {_RESAMPLED.format(t='d')} FROM n GROUP BY instrument, k HAVING count(*) = 4",
    "a4_iso_week": f"WITH {BARS} SELECT instrument, CAST(date_trunc('week', d) AS DATE) AS t, {_RESAMPLED.format(t='d')} FROM day_bars GROUP BY 1, 2",
    "a5_bars_a_week": f"WITH {BARS} SELECT instrument, n, count(*) AS weeks FROM (SELECT instrument, date_trunc('week', d) AS w, count(*) AS n FROM day_bars GROUP BY 1, 2) GROUP BY 1, 2",
}
QUERIES = {f.__name__: f for f in (j2_align_fill, j3_asof_backward, j5_asof_forward, j9_ordinal_band, j10_inner_returns, j11_semi_dates, j12_anti_dates, j13_nearest, j14_open_interest, j19_legs, j20_pair_correlation, j21_reconciliation, p2_quality, p3_gaps, p4_weekdays, p5_clean, p7_session_date, p8_off_calendar, p15_last_bars, p16_latest, a1_resample_month, a2_complete_4h, a3_chunks, a4_iso_week, a5_bars_a_week)}
