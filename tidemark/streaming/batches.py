"""Micro-batches into a versioned table, each exactly once: an upsert and the number of its batch are one version of the table.

A batch that runs again (the process ended after the table was written, before the stream took note of it) finds its number in the table and changes nothing. Late rows, and rows of one key in
several batches, win or lose by the rule ``keep``: the row that came last, the one that came first, or the one that is greatest by columns such as the event's time, whenever it came.

Defined results: of rows of one key in one batch the greatest by these columns is taken (the least, where the first stays), a null below all; equal ones may be taken either way, so the columns should end with
one that is unique. A batch without rows is marked and changes no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.tables import VersionedTable


def applied(batch: DataFrame, number: int, table: VersionedTable, name: str, keep: str, by: list[str]) -> int:
    """Upserts one batch under its number; the number of the table's newest version."""
    order = [F.asc_nulls_first(c) if keep == "first" else F.desc_nulls_last(c) for c in by]
    one = batch.withColumn("_k", F.row_number().over(Window.partitionBy(*table.keys).orderBy(*order))).filter("_k = 1").select(*table.columns)
    return table.upsert(one, keep, by, mark=(name, number))


def upserting(stream: DataFrame, table: VersionedTable, name: str, checkpoint: str, keep: str = "newest", by: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Starts a query that upserts a stream into a table: over what there is (once), or on and on. name tells streams into one table apart, and stays with its checkpoint."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: applied(batch, number, table, name, keep, by or []) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
