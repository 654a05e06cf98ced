"""Columns of business days and session closes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekdays_before(day: Column) -> Column:
    """Mondays to Fridays from 1900-01-01, a Monday, to before the day."""
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def business_days_between(first: Column, last: Column) -> Column:
    """Business days after the first day and before the last."""
    return weekdays_before(last) - weekdays_before(F.date_add(first, 1))


def business_days_after(day: Column, n: int) -> Column:
    """The n-th business day after a day, n from 1 to 5; of a weekend's days Monday is the first."""
    place = F.weekday(day)
    over = F.when(place >= 5, n + 6 - place).otherwise(n + F.when(place + n >= 5, 2).otherwise(0))
    return F.date_add(day, over.cast("int"))


def day_close(day: Column, pair: Column) -> Column:
    """When a day's bar is complete, in UTC without a zone: at 17:00 in New York for pairs, at the next midnight for all else."""
    local = day.cast("timestamp_ntz") + F.expr("INTERVAL 17 HOURS")
    return F.when(pair, F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), local)).otherwise(F.date_add(day, 1).cast("timestamp_ntz"))


def session_date(ts: Column, kind: Column, timeframe: Column) -> Column:
    """The session of a bar that opens at ts (UTC, without a zone), at midnight: of days and weeks the UTC day, for forex the day after New York's day of the open. Bars within a day keep their time."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts)
    day = F.when(kind == "forex", F.date_add(F.to_date(local), 1)).otherwise(F.to_date(ts)).cast("timestamp_ntz")
    return F.when(timeframe.isin("1d", "1w"), day).otherwise(ts)


def off_calendar(ts: Column, kind: Column, timeframe: Column) -> Column:
    """Whether a bar of that class lies where none can: weekends, forex weeks that don't begin on Monday, the forex weekend from Friday 22:00 to Sunday 21:00 UTC. Coins trade always."""
    day, hour = F.weekday(ts), F.hour(ts)
    forex = F.when(timeframe == "1w", day != 0).when(timeframe == "1d", day > 4).otherwise((day == 5) | (day == 6) & (hour < 21) | (day == 4) & (hour >= 22))
    return F.when(kind == "crypto", False).when(kind == "forex", forex).otherwise(day > 4)
