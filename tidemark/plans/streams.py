"""Queries of streams and of tables that change: idempotent upserts, silences, session anchors, staleness, pages, patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.indicators import rounded
from tidemark.sources import paged, tables
from tidemark.streaming import batches, timers, windows as st

LATEST = "user_id bigint, event_type string, event_id bigint, ts timestamp_ntz, value double"


def _events(spark, sf_dir):
    """events as a stream of one file a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/event[s].parquet")


def _scattered(spark, sf_dir):
    """events written in several files without regard to time, as a stream of one file a micro-batch, so that most rows come late."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = st.shared_folder(spark, "scattered")
    events.repartition(4, "event_id").write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def z6_latest_events(spark, sf_dir):
    """The newest event of each user and type, upserted batch by batch; of late events only those that are newer count."""
    table = tables.VersionedTable(spark, st.shared_folder(spark, "latest"), LATEST, ["user_id", "event_type"], 8)
    query = batches.upserting(_scattered(spark, sf_dir), table, "events", st.shared_folder(spark, "latest-state"), "newest", ["ts", "event_id"])
    query.awaitTermination()
    return table.load()


def z8_silences(spark, sf_dir):
    """Each time that an event type had no event for more than half an hour, as far as the watermark has come."""
    events = _events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    with timers.state_store(spark):
        found = st.drained(timers.silences(events, 1800, "10 minutes"), "silences")
    return found.select(F.col("key").alias("event_type"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_seen", "silent_at")])


def z10_session_anchors(spark, sf_dir):
    """Each event type's first value of a day as its anchor, and the worst loss against it, when the day has ended."""
    events = _events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    with timers.state_store(spark):
        found = st.drained(timers.sessions(events, "10 minutes"), "sessions")
    return rounded(found.withColumnRenamed("key", "event_type"), ["event_type", "day"])


#: Hours after which a type of event is stale.
STALE = {"view": 1, "click": 2, "purchase": 30}


def z5_staleness(spark, sf_dir):
    """The age of each type's last event at the time of the last of all, in hours, and whether it is beyond the type's bound (6 hours unless it has one)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.max("ts").alias("last"))
    now = e.agg(F.max("last").alias("now"))
    bound = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STALE.items() for x in kv]), F.col("event_type")), F.lit(6))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 3.6e9
    return rounded(e.join(F.broadcast(now)).select("event_type", age.alias("hours"), (age > bound).alias("stale")), ["event_type"])


def s16_paged_orders(spark, sf_dir):
    """Orders served in pages by key: those of a range of keys, two columns of them."""
    path = st.shared_folder(spark, "pages")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("d"))
    paged.write(orders, path, ["o_orderkey"])
    top = orders.agg(F.max("o_orderkey")).first()[0] or 0
    found = paged.read(spark, path, ["o_orderkey", "o_totalprice", "d"])
    return found.filter((F.col("o_orderkey") > top // 3) & (F.col("o_orderkey") <= top // 2)).select("o_orderkey", "o_totalprice", "d")


def s4_latest_bars(spark, sf_dir):
    """The last bar of each instrument, through the source registered as 'paged'."""
    from tidemark.plans.bars import day_bars

    path = st.shared_folder(spark, "bars")
    paged.write(day_bars(spark, sf_dir), path, ["instrument", "d"])
    return paged.bars_of("paged", spark, path=path).latest()


MEMORY = "id bigint, outcome string, outcome_price double, outcome_date string, lesson string, validations array<bigint>"


def _memory(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr("o_orderkey AS id", "'pending' AS outcome", "CAST(NULL AS DOUBLE) AS outcome_price", "CAST(NULL AS STRING) AS outcome_date", "CAST(NULL AS STRING) AS lesson", "CAST(NULL AS ARRAY<BIGINT>) AS validations", "o_custkey", "o_totalprice", "o_orderstatus")


def k7_patched_memory(spark, sf_dir):
    """Orders as a memory of setups: patched with outcomes, lessons of at most 600 characters and at most 50 re-checks; then those of one status are deleted, a few saved anew."""
    rows = _memory(spark, sf_dir)
    table = tables.VersionedTable(spark, st.shared_folder(spark, "memory"), MEMORY, ["id"], 16)
    table.upsert(rows.select("id", "outcome", "outcome_price", "outcome_date", "lesson", "validations"))
    patches = rows.filter("o_custkey % 4 <> 3").selectExpr(
        "id",
        "CASE WHEN o_custkey % 4 = 0 THEN 'tp_hit' END AS outcome",
        "CASE WHEN o_custkey % 4 = 0 THEN o_totalprice END AS outcome_price",
        "CASE WHEN o_custkey % 8 = 0 THEN '2024-01-31' END AS outcome_date",
        "CASE WHEN o_custkey % 4 = 1 OR o_custkey % 12 = 0 THEN repeat(CAST(id AS STRING), 150) END AS lesson",
        "CASE WHEN o_custkey % 4 = 2 THEN sequence(id, id + id % 80) END AS validations",
    )
    table.patch(*tables.memory_patch(patches, "2024-02-01"))
    table.delete(rows.filter("o_orderstatus = 'P'").select("id"))
    new = rows.filter("id % 50 = 0").selectExpr("id", "'expired' AS outcome", "CAST(id AS STRING) AS outcome_price", "'2024-03-01' AS outcome_date", "'x' AS unknown")
    table.upsert(tables.admitted(new, MEMORY, ["id", "outcome"]))
    found = table.load()
    return found.select("id", "outcome", "outcome_price", "outcome_date", "lesson", F.size(F.coalesce("validations", F.array().cast("array<bigint>"))).cast("bigint").alias("checks"))


def z11_change_feed(spark, sf_dir):
    """What a day's work changed in a table of orders: inserted, updated and deleted rows, read from the partitions that differ."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = tables.VersionedTable(spark, st.shared_folder(spark, "feed"), "o_orderkey bigint, o_orderstatus string, o_totalprice double", ["o_orderkey"], 16)
    table.upsert(o.filter("o_orderkey % 3 < 2"))
    before = table.version().n
    table.upsert(o.filter("o_orderkey % 3 > 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus"))))
    table.delete(o.filter("o_orderkey % 9 = 0").select("o_orderkey"))
    return table.changes(before)


QUERIES = {f.__name__: f for f in (z11_change_feed, z5_staleness, z6_latest_events, z8_silences, z10_session_anchors, s4_latest_bars, s16_paged_orders, k7_patched_memory)}

_LAST = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
ORACLE_SQL = {
    "z5_staleness": f"WITH e AS (SELECT event_type, max(ts) AS last FROM events GROUP BY 1), x AS (SELECT event_type, (epoch_us((SELECT max(last) FROM e)) - epoch_us(last)) / 3.6e9 AS hours FROM e) SELECT event_type, round(hours, 6) AS hours, hours > CASE event_type {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in STALE.items())} ELSE 6 END AS stale FROM x",
    "z11_change_feed": """
SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'delete' WHEN o_orderkey % 3 = 2 THEN 'insert' ELSE 'update' END AS change, o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 3 = 2 OR (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0)""",
    "z6_latest_events": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
    "z8_silences": f"WITH x AS (SELECT event_type, ts, lead(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nxt FROM events) SELECT event_type, ts AS last_seen, ts + INTERVAL 30 MINUTE AS silent_at FROM x WHERE ts + INTERVAL 30 MINUTE < date_trunc('millisecond', {_LAST}) AND (nxt IS NULL OR nxt > ts + INTERVAL 30 MINUTE)",
    "z10_session_anchors": f"WITH x AS (SELECT event_type, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS anchor, arg_max(value, (ts, event_id)) AS last, min(value) AS least FROM events WHERE value IS NOT NULL GROUP BY 1, 2) SELECT event_type, day, round(anchor, 6) AS anchor, round(last, 6) AS last, round(least, 6) AS least, round(CASE WHEN anchor > 0 THEN greatest(0, 1 - least / anchor) ELSE 0 END, 6) AS loss FROM x WHERE day + INTERVAL 1 DAY <= {_LAST}",
    "s4_latest_bars": "WITH day_bars AS (SELECT o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS d, min_by(o_totalprice, o_orderkey) AS o, max(o_totalprice) AS h, min(o_totalprice) AS l, max_by(o_totalprice, o_orderkey) AS c, CAST(count(*) AS BIGINT) AS v FROM orders GROUP BY 1, 2) SELECT * FROM day_bars QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY d DESC) = 1",
    "s16_paged_orders": "SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) // 3 FROM orders) AND o_orderkey <= (SELECT max(o_orderkey) // 2 FROM orders)",
    "k7_patched_memory": """
WITH m AS (
  SELECT o_orderkey AS id, o_custkey % 4 AS k, CASE WHEN o_custkey % 4 = 1 OR o_custkey % 12 = 0 THEN left(repeat(CAST(o_orderkey AS VARCHAR), 150), 600) END AS lesson, * FROM orders
), p AS (
  SELECT id, CASE k WHEN 0 THEN 'tp_hit' ELSE 'pending' END AS outcome, CASE k WHEN 0 THEN o_totalprice END AS outcome_price,
         CASE k WHEN 0 THEN CASE WHEN o_custkey % 8 = 0 THEN '2024-01-31' ELSE '2024-02-01' END END AS outcome_date, lesson, CASE k WHEN 2 THEN least(50, id % 80 + 1) ELSE 0 END AS checks, o_orderstatus FROM m
)
SELECT id, outcome, outcome_price, outcome_date, lesson, checks FROM p WHERE o_orderstatus <> 'P' AND id % 50 <> 0
UNION ALL
SELECT id, 'expired', CAST(id AS DOUBLE), '2024-03-01', NULL, 0 FROM p WHERE id % 50 = 0
""",
}
