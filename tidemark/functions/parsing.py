"""Columns that read symbols, price texts and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_of(symbol: Column) -> Column:
    """EUR of EUR/USD, EURUSD=X and EUR-USD; the whole symbol if it isn't a pair."""
    clean = F.regexp_replace(F.upper(symbol), r"(=X|\.[A-Z]+)$", "")
    return F.when(clean.rlike("[/-]"), F.element_at(F.split(clean, "[/-]"), 1)).when(clean.rlike("^[A-Z]{6}$"), F.substring(clean, 1, 3)).otherwise(clean)


def quote_of(symbol: Column) -> Column:
    clean = F.regexp_replace(F.upper(symbol), r"(=X|\.[A-Z]+)$", "")
    return F.when(clean.rlike("[/-]"), F.element_at(F.split(clean, "[/-]"), 2)).when(clean.rlike("^[A-Z]{6}$"), F.substring(clean, 4, 3))


def numbers_in(text: Column) -> Column:
    """All numbers of a text as doubles; thousands separators are dropped."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d),(?=\d{3})", ""), F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def zone_middle(text: Column) -> Column:
    """Middle of the least and greatest number of an entry zone."""
    n = numbers_in(text)
    return F.when(F.size(n) > 0, (F.array_min(n) + F.array_max(n)) / 2)


def reward_ratio(text: Column) -> Column:
    """2.5 of "1:2.5", "2.5" and "1 : 2.5"; null without a number."""
    n = numbers_in(text)
    return F.when(text.contains(":") & (F.size(n) >= 2), F.try_divide(F.get(n, 1), F.get(n, 0))).otherwise(F.get(n, 0))


def timeframe_seconds(name: Column) -> Column:
    n = F.regexp_extract(name, r"(\d+)", 1).try_cast("long")
    unit = F.lower(F.regexp_extract(name, r"([a-zA-Z]+)", 1))
    return n * F.when(unit.isin("m", "min"), 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit.isin("w", "wk"), 604800)


def pip_size(symbol: Column) -> Column:
    return F.when(quote_of(symbol) == "JPY", 0.01).otherwise(0.0001)


def session_of(ts: Column) -> Column:
    """Label of the hour in UTC."""
    h = F.hour(ts)
    return F.when(F.weekday(ts) >= 5, "weekend").when((h >= 13) & (h < 17), "london/new york").when((h >= 8) & (h < 17), "london").when((h >= 13) & (h < 21), "new york").otherwise("asia")
