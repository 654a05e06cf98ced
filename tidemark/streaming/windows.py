"""Structured Streaming over events: watermarked windows, and bars kept per key."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in local tests without one, a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def tumbling_bars(events: DataFrame, length: str, delay: str) -> DataFrame:
    """(instrument, t, o, h, l, c, v) of closed windows of a stream (instrument, ts, event_id, value); events later than delay are dropped."""
    marked = events.withWatermark("ts", delay)
    return marked.groupBy(F.window("ts", length), "instrument").agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", F.struct("ts", "event_id")).alias("c"), F.count("*").alias("v")
    ).select("instrument", F.col("window.start").alias("t"), "o", "h", "l", "c", "v")


def drained(stream: DataFrame, tag: str) -> DataFrame:
    """Runs a stream over what there is and returns what it appended, exactly once, from Parquet."""
    spark = stream.sparkSession
    out = shared_folder(spark, tag)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
