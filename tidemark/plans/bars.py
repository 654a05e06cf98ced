"""Bar views built from the tick-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One open/high/low/close/volume bar per instrument and day."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_orderpriority").alias("instrument"), F.to_date("o_orderdate").alias("d")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("o"),
        F.max("o_totalprice").alias("h"),
        F.min("o_totalprice").alias("l"),
        F.max_by("o_totalprice", "o_orderkey").alias("c"),
        F.count("*").alias("v"),
    )


DAY_BARS_SQL = """
SELECT o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS d,
       min_by(o_totalprice, o_orderkey) AS o, max(o_totalprice) AS h,
       min(o_totalprice) AS l, max_by(o_totalprice, o_orderkey) AS c,
       CAST(count(*) AS BIGINT) AS v
FROM orders GROUP BY 1, 2
"""

QUERIES = {"bars_day": day_bars}
ORACLE_SQL = {"bars_day": DAY_BARS_SQL}
