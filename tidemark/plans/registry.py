"""All market-analytics queries by name, with their SQL for the comparison engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import bars, desk, grading, indicators, joins, levels, models, oscillators, readings, records, reviews, scorecards, searches, sequences, series, strategies, streams, tables

FLAGSHIP = "bars_day"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (bars, desk, grading, indicators, joins, levels, models, oscillators, readings, records, reviews, scorecards, searches, sequences, series, strategies, streams, tables):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
