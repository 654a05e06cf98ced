"""Bars and other series from files, and a store of bars: chart JSON, CSV of candles, rates, positions and observations, JSON ledgers,
partitioned Parquet with first-wins or last-wins merges.

A store is a versioned table (see ``tables``): a merge writes the partitions of its instruments anew beside the old ones, and a small manifest names what
belongs to a version, so that readers, and tasks that are run again, always see one whole version.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import desk
from tidemark.sources.tables import Version, VersionedTable

BAR = "instrument string, d date, o double, h double, l double, c double, v bigint"
_CHART = "chart struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<bigint>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>>>>>"


def chart_json(spark: SparkSession, path: str) -> DataFrame:
    """Bars of files that hold one chart answer each; rows with a null price go, a null volume is 0, damaged files give nothing."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _CHART).alias("j"))
    result = raw.select(F.explode("j.chart.result").alias("r"))
    quote = F.get("r.indicators.quote", 0)
    zipped = F.arrays_zip(F.col("r.timestamp").alias("t"), quote["open"].alias("o"), quote["high"].alias("h"), quote["low"].alias("l"), quote["close"].alias("c"), quote["volume"].alias("v"))
    rows = result.select(F.col("r.meta.symbol").alias("instrument"), F.explode(zipped).alias("b"))
    bars = rows.select("instrument", F.to_date(F.timestamp_seconds("b.t")).alias("d"), *[F.col(f"b.{x}").alias(x) for x in "ohlc"], F.coalesce("b.v", F.lit(0)).cast("bigint").alias("v"))
    return bars.dropna(subset=["o", "h", "l", "c"])


def candles_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def rates_csv(spark: SparkSession, path: str) -> DataFrame:
    """(d, currency, rate) of a wide file effective_date, <currency>...; empty cells are left out."""
    wide = spark.read.option("header", True).csv(path)
    names = [c for c in wide.columns if c != "effective_date"]
    long = wide.select(F.to_date("effective_date").alias("d"), F.explode(F.array(*[F.struct(F.lit(c).alias("currency"), F.col(c).try_cast("double").alias("rate")) for c in names])).alias("x"))
    return long.select("d", "x.currency", "x.rate").dropna(subset=["rate"])


# Names of the columns of the public annual position files; fixed values.
POSITIONS = {
    "Market and Exchange Names": "market",
    "As of Date in Form YYYY-MM-DD": "date",
    "Noncommercial Positions-Long (All)": "noncomm_long",
    "Noncommercial Positions-Short (All)": "noncomm_short",
    "Open Interest (All)": "open_interest",
}


def positions_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(market, date, noncomm_long, noncomm_short, open_interest) of all files, one row for each market and date.

    A file without one of the columns is an error. Rows without a date or a position go; of rows of one market and date the greatest stays.
    """
    frames = []
    for path in paths:
        raw = spark.read.option("header", True).csv(path)
        missing = [c for c in POSITIONS if c not in raw.columns]
        if missing:
            raise ValueError(f"{path}: missing columns {missing}")
        frames.append(raw.select(*[F.col(f"`{c}`").alias(k) for c, k in POSITIONS.items()]))
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    numbers = [F.trim(c).try_cast("double").alias(c) for c in ("noncomm_long", "noncomm_short", "open_interest")]
    typed = rows.select(F.trim("market").alias("market"), F.trim("date").try_cast("date").alias("date"), *numbers).dropna(subset=["date", "noncomm_long", "noncomm_short"])
    return typed.groupBy("market", "date").agg(F.max(F.struct("noncomm_long", "noncomm_short", "open_interest")).alias("x")).select("market", "date", "x.*")


def newest_observation(spark: SparkSession, path: str) -> DataFrame:
    """(series, date, value): each file's last value that is there, of files date,<series>; "." and blanks are missing values."""
    raw = spark.read.option("header", False).csv(path, schema="date string, value string").select(F.input_file_name().alias("_file"), "date", "value")
    rows = raw.select(F.regexp_extract("_file", r"([^/]+?)(\.csv)?$", 1).alias("series"), F.trim("date").try_cast("date").alias("date"), F.trim("value").try_cast("double").alias("value"))
    known = rows.dropna(subset=["date", "value"])
    return known.groupBy("series").agg(F.max(F.struct("date", "value")).alias("x")).select("series", "x.date", "x.value")


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of a JSON ledger; damaged lines, such as a cut last one, and blank ones are passed over."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    read = raw.select(F.from_json("value", f"{schema}, _damaged string", {"columnNameOfCorruptRecord": "_damaged"}).alias("j"))
    return read.filter("j IS NOT NULL AND j._damaged IS NULL").select("j.*").drop("_damaged")


def checked(bars: DataFrame) -> DataFrame:
    """The bars' columns with prices as doubles. A missing column is an error at once; two bars of one series and day, or a bar without
    either, fail the job that reads the result."""
    names = [x.split()[0] for x in BAR.split(", ")]
    missing = [c for c in names if c not in bars.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    once = (F.count("*").over(Window.partitionBy("instrument", "d")) == 1) & F.col("instrument").isNotNull() & F.col("d").isNotNull()
    name = F.when(once, F.col("instrument")).otherwise(F.raise_error(F.concat(F.lit("two bars of one day, or no day or name: "), F.coalesce("instrument", F.lit("null")))))
    return bars.select(name.alias("instrument"), F.to_date("d").alias("d"), *[F.col(c).cast("double").alias(c) for c in "ohlc"], F.col("v").cast("bigint").alias("v"))


def prepared(bars: DataFrame) -> DataFrame:
    """Bars fit for a store: days without a time, the last (by o, h, l, c and v) of a day's bars, none of a weekend but those of coins, and checked."""
    day = bars.withColumn("d", F.to_date("d"))
    one = day.withColumn("_k", F.row_number().over(Window.partitionBy("instrument", "d").orderBy(*[F.desc(c) for c in "ohlcv"]))).filter("_k = 1").drop("_k")
    return checked(one.filter((F.weekday("d") < 5) | (desk.asset_class(F.col("instrument")) == "crypto")))


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new, which are the whole state: rows of old with other keys go, columns that only old has keep its values."""
    kept = [c for c in old.columns if c not in new.columns]
    return new.join(old.select(*keys, *kept), keys, "left").select(*[c for c in old.columns if c in new.columns or c in kept])


def latest(old: DataFrame | None, new: DataFrame, keys: list[str], keep: str = "last") -> DataFrame:
    """old and new with one row per key: that of new (last) or of old (first)."""
    if old is None:
        return new.dropDuplicates(keys)
    both = old.withColumn("_of", F.lit(0)).unionByName(new.withColumn("_of", F.lit(1)))
    order = F.desc("_of") if keep == "last" else F.asc("_of")
    rest = [c for c in old.columns if c not in keys]
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *rest))).filter("_k = 1").select(*old.columns)


class BarStore(VersionedTable):
    """Bars under a folder, one for each instrument and day; a merge rewrites the partitions of its own instruments, and of two at once none is lost."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64) -> None:
        super().__init__(spark, folder, BAR, ["instrument", "d"], parts, ["instrument"])

    def _committed(self, version: Version) -> bool:
        return self._taken(version.n, json.dumps({"n": version.n, "parts": version.parts, "marks": version.marks}))

    def _taken(self, n: int, text: str) -> bool:  # type: ignore[override]
        return self._created(f"versions/{n:012d}.json", text)

    def load(self, n: int | None = None) -> DataFrame | None:
        """The bars of a version, the newest unless given, None if there is none; damaged files are skipped."""
        return super().load(n) if self.version(n).n >= 0 else None

    def merge(self, bars: DataFrame, keep: str = "last") -> DataFrame:
        """Adds bars and returns all: of a day's old and new bar the new one stays (last) or the old one (first), of two new ones the lesser by o, h, l, c and v."""
        one = bars.select(*self.columns).withColumn("_k", F.row_number().over(Window.partitionBy(*self.keys).orderBy(*"ohlcv"))).filter("_k = 1").select(*self.columns)
        self.upsert(one, keep)
        return self.load()

    def save(self, bars: DataFrame) -> DataFrame:
        """Merges what of the bars is fit for the store."""
        return self.merge(prepared(bars))
