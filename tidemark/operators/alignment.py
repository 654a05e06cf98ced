"""Joins in time: as-of, bands of rows, intervals, nearest. None compares all pairs of a key.

An as-of join is a union and one ordered window: no side is broadcast, nothing is repeated, and the memory of a task is one row. A task
has one stretch of a key's time, not the whole key: what a stretch ends with is handed on to the later ones by a small table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType


def stretch(kind: DataType, time: Column) -> Column:
    """The month of a day, the day of a time; all of any other order is one stretch."""
    if isinstance(kind, DateType):
        return F.trunc(time, "MM")
    return F.to_date(time) if isinstance(kind, TimestampType | TimestampNTZType) else F.lit(0)


def asof(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], forward: bool = False) -> DataFrame:
    """Every row of left with the values of the last row of right of its key at or before its time (the first at or after it, if
    forward), null if there is none. Of several right rows of one time the values of the greatest count; right rows without a time or
    a key meet nothing, nor do such left rows."""
    kind = left.schema[time].dataType
    order = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    found = right.filter(F.col(time).isNotNull() & F.col(key).isNotNull()).groupBy(key, F.col(time).alias("_t")).agg(F.max(F.struct(*values)).alias("_v")).withColumn("_part", stretch(kind, F.col("_t")))
    ends = found.groupBy(key, "_part").agg((F.min_by if forward else F.max_by)("_v", "_t").alias("_end"))
    # The stretches of both sides, few rows for each key; a stretch gets what the nearest one before it ends with.
    asked = left.select(key, stretch(kind, F.col(time)).alias("_part")).distinct()
    earlier = Window.partitionBy(key).orderBy(order("_part")).rowsBetween(Window.unboundedPreceding, -1)
    handed = asked.join(ends, [key, "_part"], "full").select(key, "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")).filter(F.col("_carried").isNotNull())
    rows = left.withColumns({"_t": F.col(time), "_side": F.lit(1), "_part": stretch(kind, F.col(time)), "_v": F.lit(None).cast(found.schema["_v"].dataType)})
    both = rows.unionByName(found.withColumn("_side", F.lit(0)), allowMissingColumns=True).join(handed, [key, "_part"], "left")
    w = Window.partitionBy(key, "_part").orderBy(order("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("_at", F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_carried"))).filter("_side = 1")
    known = F.col(time).isNotNull() & F.col(key).isNotNull()
    return at.select(*left.columns, *[F.when(known, F.col("_at")[v]).alias(v) for v in values])


def aligned(bars: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, time, value): every key at every time that any has, the last value known carried forward; null before the first."""
    # Both sides are dimensions, the result is as large as what is asked for; nothing is broadcast by hint.
    spine = bars.select(time).distinct().crossJoin(bars.select(key).distinct())
    joined = spine.join(bars.select(key, time, value), [key, time], "left")
    w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(value, F.last(value, ignorenulls=True).over(w))


def active_notional(bars: DataFrame, trades: DataFrame, key: str, time: str) -> DataFrame:
    """bars (key, time) with n_open and notional of the trades (key, entry, exit, notional) open in [entry, exit).

    Each trade is two changes; a running sum counts them at each bar, so that overlaps cost nothing.
    """
    opened = trades.select(key, F.col("entry").alias("_t"), F.lit(1).alias("_n"), F.col("notional").alias("_x"), F.lit(0).alias("_side"))
    closed = trades.select(key, F.col("exit").alias("_t"), F.lit(-1).alias("_n"), (-F.col("notional")).alias("_x"), F.lit(0).alias("_side"))
    changes = opened.unionByName(closed).groupBy(key, "_t", "_side").agg(F.sum("_n").alias("_n"), F.sum("_x").alias("_x"))
    at = bars.select(key, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_x"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = changes.unionByName(at).withColumns({"n_open": F.sum("_n").over(w), "notional": F.sum("_x").over(w)})
    return both.filter("_side = 1").select(key, F.col("_t").alias(time), "n_open", "notional")


def band(events: DataFrame, bars: DataFrame, key: str, time: str, reach: int) -> DataFrame:
    """Each event (key, time, event) with the bars of its key at most reach rows away from the first bar at or after it: offset -reach to reach."""
    order = Window.partitionBy(key).orderBy(time)
    numbered = bars.withColumn("_i", F.row_number().over(order))
    placed = asof(events, numbered.select(key, time, "_i"), key, time, ["_i"], forward=True)
    spread = placed.withColumn("offset", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("_i", F.col("_i") + F.col("offset"))
    return spread.drop(time).join(numbered, [key, "_i"]).drop("_i")


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], tolerance_days: int) -> DataFrame:
    """Every row of left with the values of the row of right nearest in days, the earlier one of two; null beyond the tolerance."""
    stamped = right.withColumn("_when", F.col(time))
    names = ["_when", *values]
    before = asof(left, stamped, key, time, names).select("*", F.struct(*names).alias("_b")).drop(*names)
    both = asof(before, stamped, key, time, names, forward=True).select("*", F.struct(*names).alias("_f")).drop(*names)
    back, ahead = F.datediff(F.col(time), F.col("_b._when")), F.datediff(F.col("_f._when"), F.col(time))
    best = F.when(ahead.isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_f"))
    gap = F.when(ahead.isNull() | (back <= ahead), back).otherwise(ahead)
    return both.withColumn("_best", F.when(gap <= tolerance_days, best)).select(*left.columns, *[F.col(f"_best.{v}").alias(v) for v in values])


def nearest_level(left: DataFrame, right: DataFrame, key: str, level: str, name: str, share: float) -> DataFrame:
    """Rows of left with the name of the row of right of their key whose level is nearest, the least name of equal ones, and their gap. Rows
    without one within share of their own level are left out, as are negative and null levels.

    Levels lie in cells of their logarithms, so wide that a match is in the same cell or the next one. Within a cell the nearest level stands
    next to the row in order; the neighbouring cells give their ends, by a small table. Nothing is paired.
    """
    width = -2 * math.log1p(-share)
    # A level of 0 has no logarithm and a cell of its own.
    cell = F.coalesce(F.floor(F.log(level) / width), F.lit(-(1 << 40)))
    known = lambda df: df.filter(F.col(key).isNotNull() & (F.col(level) >= 0)).withColumn("_cell", cell)
    levels = known(right.groupBy(key, level).agg(F.min(name).alias("_name"))).select(key, "_cell", level, F.struct(F.col(level).alias("x"), F.col("_name").alias("name")).alias("_v"))
    ends = levels.groupBy(key, "_cell").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    both = known(left).withColumn("_side", F.lit(1)).unionByName(levels.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = lambda x: F.last("_v", ignorenulls=True).over(Window.partitionBy(key, "_cell").orderBy(x, "_side").rowsBetween(Window.unboundedPreceding, 0))
    at = both.withColumn("_below", w(F.col(level))).withColumn("_above", w(F.col(level).desc())).filter("_side = 1")
    at = at.join(ends.select(key, (F.col("_cell") + 1).alias("_cell"), "_hi"), [key, "_cell"], "left").join(ends.select(key, (F.col("_cell") - 1).alias("_cell"), "_lo"), [key, "_cell"], "left")
    gap = lambda v: F.abs(v["x"] - F.col(level))
    options = [F.when(gap(v) <= share * F.col(level), F.struct(gap(v).alias("gap"), v["name"].alias("name"))) for v in (F.coalesce("_below", "_hi"), F.coalesce("_above", "_lo"))]
    found = at.withColumn("_best", F.least(*options)).filter(F.col("_best").isNotNull())
    return found.select(*left.columns, F.col("_best.name").alias(name), F.col("_best.gap").alias("gap"))


def on_calendar(price: Column) -> Column:
    """Monday to Friday."""
    return F.weekday(price) < 5
