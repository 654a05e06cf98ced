"""Pages of JSON in a folder as a Spark data source: partitions of pages, filters and limits that decide which pages are opened.

The layout is that of a table served in pages: files of at most ``rows_per_page`` rows as ``{"rows": [...]}``, and one ``manifest.json`` with the schema, the files in order and
the least and greatest value of each column in each. Writing makes the pages in the tasks and the manifest last, in the commit, so that readers see all of a write or
nothing. Reading prunes: a filter that Spark pushes down (=, <=>, <, <=, >, >=, IN, IS [NOT] NULL, AND of these) closes the pages whose range can't meet it; Spark applies it
again to the rows. Pages are read in tasks, ``pages_per_task`` each.

Options: path (a folder that all machines share, as a local path or a URI that Arrow's file systems know); columns (names, comma-separated: a projection); limit (the first so many rows that
meet the pushed filters, in page order, from one task that opens no page after the last it needs).

Defined results: null and missing fields are null; a page that isn't JSON is an error, as is a folder without manifest; a table without rows has a manifest without pages. Ranges hold no NaN: a
page with one is never closed by a range of that column.
"""

from __future__ import annotations

import json
import math
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DateType, DecimalType, StructType, TimestampNTZType, TimestampType

NAME = "paged_json"
_AS_TEXT = (DateType, TimestampType, TimestampNTZType, DecimalType)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _plain(value):
    """A value as JSON has it; dates, times and decimals as text in the form that Arrow reads, arrays and structs of plain values as they are."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return value.isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat() if hasattr(value, "isoformat") else str(value)


@dataclass
class Pages(InputPartition):
    """Files that one task reads, and how many rows it may return."""

    files: tuple[str, ...]
    limit: int | None = None

    def __init__(self, files: tuple[str, ...], limit: int | None = None) -> None:
        super().__init__(files)
        self.files, self.limit = files, limit


@dataclass
class Written(WriterCommitMessage):
    pages: list[dict]


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _manifest(self) -> dict:
        system, path = _filesystem(self.options["path"])
        with system.open_input_stream(posixpath.join(path, "manifest.json")) as f:
            return json.loads(f.read())

    def schema(self) -> StructType:
        whole = StructType.fromJson(self._manifest()["schema"])
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([whole[c] for c in names]) if names else whole

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options["path"], schema, self._manifest()["pages"], int(self.options.get("pages_per_task", "16")), int(self.options["limit"]) if "limit" in self.options else None)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PagedWriter(self.options["path"], schema, int(self.options.get("rows_per_page", "1000")), overwrite)


def may_hold(page: dict, f: Filter) -> bool:
    """Whether any row of a page can meet a filter, by the page's ranges."""
    column = f.attribute[0] if len(f.attribute) == 1 else None
    if column not in page["columns"]:
        return True
    nulls, low, high = page["columns"][column]
    if isinstance(f, IsNull):
        return nulls > 0
    if isinstance(f, EqualNullSafe) and f.value is None:
        return nulls > 0
    if nulls == page["rows"]:
        return False
    if isinstance(f, IsNotNull) or low is None:
        return True
    if isinstance(f, In):
        return any(low <= v <= high for v in map(_plain, f.value) if v is not None)
    value = _plain(f.value)
    if value is None:
        return False
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return low <= value <= high
    if isinstance(f, GreaterThan):
        return high > value
    if isinstance(f, GreaterThanOrEqual):
        return high >= value
    if isinstance(f, LessThan):
        return low < value
    return low <= value


def _meets(row: dict, f: Filter) -> bool:
    value = row.get(f.attribute[0])
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == _plain(f.value)
    if value is None:
        return False
    if isinstance(f, In):
        return value in [_plain(v) for v in f.value]
    other = _plain(f.value)
    if isinstance(value, float) and math.isnan(value):  # greater than all, equal to itself
        same = isinstance(other, float) and math.isnan(other)
        return same if isinstance(f, (EqualTo, LessThanOrEqual)) else not same if isinstance(f, GreaterThan) else isinstance(f, GreaterThanOrEqual)
    return {EqualTo: value == other, GreaterThan: value > other, GreaterThanOrEqual: value >= other, LessThan: value < other, LessThanOrEqual: value <= other}[type(f)]


class PagedReader(DataSourceReader):
    KINDS = (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNull, IsNotNull)

    def __init__(self, path: str, schema: StructType, pages: list[dict], per_task: int, limit: int | None) -> None:
        self.path, self.schema, self.pages, self.per_task, self.limit = path, schema, pages, per_task, limit
        self.pushed: list[Filter] = []

    def _plain_column(self, f: Filter) -> bool:
        """Comparisons of numbers, texts and dates are those of their JSON forms; of times and decimals they needn't be."""
        kind = self.schema[f.attribute[0]].dataType if len(f.attribute) == 1 and f.attribute[0] in self.schema.names else None
        return kind is not None and (not isinstance(kind, (TimestampType, TimestampNTZType, DecimalType, StructType)) or isinstance(f, (IsNull, IsNotNull)))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, self.KINDS) and self._plain_column(f):
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> list[Pages]:
        files = [p["file"] for p in self.pages if p["rows"] and all(may_hold(p, f) for f in self.pushed)]
        if self.limit is not None:
            return [Pages(tuple(files), self.limit)]
        return [Pages(tuple(files[i : i + self.per_task])) for i in range(0, len(files), self.per_task)] or [Pages(())]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(self.path)
        kinds, left = to_arrow_schema(self.schema), partition.limit
        for file in partition.files:
            if left is not None and left <= 0:
                return
            with system.open_input_stream(posixpath.join(path, file)) as f:
                rows = json.loads(f.read())["rows"]
            rows = [r for r in rows if all(_meets(r, f) for f in self.pushed)][:left]
            left = None if left is None else left - len(rows)
            columns = []
            for field, of in zip(kinds, self.schema, strict=True):
                values = [r.get(field.name) for r in rows]
                columns.append(pa.array(values, pa.string()).cast(field.type) if isinstance(of.dataType, _AS_TEXT) else pa.array(values, field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)


class PagedWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, per_page: int, overwrite: bool) -> None:
        self.path, self.schema, self.per_page, self.overwrite = path, schema, per_page, overwrite

    def _page(self, rows: list[dict]) -> dict:
        system, path = _filesystem(self.path)
        name = f"page-{uuid.uuid4().hex}.json"
        system.create_dir(path, recursive=True)
        with system.open_output_stream(posixpath.join(path, name)) as f:
            f.write(json.dumps({"rows": rows}).encode())
        columns = {}
        for field in self.schema:
            values = [r[field.name] for r in rows]
            known = [v for v in values if v is not None]
            plain = known and not isinstance(known[0], (list, dict)) and not any(isinstance(v, float) and math.isnan(v) for v in known)
            columns[field.name] = [len(values) - len(known), *((min(known), max(known)) if plain else (None, None))]
        return {"file": name, "rows": len(rows), "columns": columns}

    def write(self, iterator: Iterator) -> Written:
        pages, rows = [], []
        for row in iterator:
            rows.append({c: _plain(v) for c, v in zip(self.schema.names, row, strict=True)})
            if len(rows) == self.per_page:
                pages.append(self._page(rows))
                rows = []
        return Written(pages + ([self._page(rows)] if rows else []))

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _filesystem(self.path)
        target = posixpath.join(path, "manifest.json")
        system.create_dir(path, recursive=True)
        old: list[dict] = []
        if not self.overwrite and system.get_file_info(target).type == pafs.FileType.File:
            with system.open_input_stream(target) as f:
                old = json.loads(f.read())["pages"]
        pages = old + [p for m in messages if m for p in m.pages]
        new = f"{target}.{uuid.uuid4().hex}"
        with system.open_output_stream(new) as f:
            f.write(json.dumps({"schema": self.schema.jsonValue(), "pages": pages}).encode())
        system.move(new, target)

    def abort(self, messages: list[Written | None]) -> None:
        """Pages without a manifest that names them are never read."""


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down to it."""
    spark.dataSource.register(PagedJson)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None, pages_per_task: int = 16) -> DataFrame:
    register(spark)
    reader = spark.read.format(NAME).option("path", path).option("pages_per_task", pages_per_task)
    reader = reader.option("columns", ",".join(columns)) if columns else reader
    return (reader.option("limit", limit) if limit is not None else reader).load()


def write(rows: DataFrame, path: str, order: list[str], rows_per_page: int = 1000, mode: str = "overwrite") -> None:
    """rows in pages in the order of some columns, so that the pages' ranges of the first don't overlap."""
    register(rows.sparkSession)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.format(NAME).mode(mode).option("path", path).option("rows_per_page", rows_per_page).save()


# Adapters ----------------------------------------------------------------------------------------

_ADAPTERS: dict[str, type] = {}


def adapter(name: str):
    """Registers a source of bars under a name, whatever its case."""

    def register_(kind: type) -> type:
        _ADAPTERS[name.lower()] = kind
        return kind

    return register_


def bars_of(name: str, spark: SparkSession, **options) -> BarSource:
    """The source of that name; KeyError, with the names that there are, for others."""
    if name.lower() not in _ADAPTERS:
        raise KeyError(f"unknown source {name}; there are {', '.join(sorted(_ADAPTERS))}")
    return _ADAPTERS[name.lower()](spark, **options)


class BarSource:
    """Bars (instrument, d, o, h, l, c, v) of many instruments; what it gives meets the contract of ``store.checked``."""

    def __init__(self, spark: SparkSession, **options) -> None:
        self.spark, self.options = spark, options

    def bars(self) -> DataFrame:
        raise NotImplementedError

    def history(self, instruments: list[str] | None, start, end) -> DataFrame:
        """The bars of some instruments (all: None) from start to end, both included."""
        rows = self.bars().filter(f"d >= DATE '{start}' AND d <= DATE '{end}'")
        return rows.filter(rows["instrument"].isin(instruments)) if instruments is not None else rows

    def latest(self) -> DataFrame:
        """The last bar of each instrument."""
        return self.bars().groupBy("instrument").agg(F.max_by(F.struct("d", "o", "h", "l", "c", "v"), "d").alias("b")).select("instrument", "b.*")


@adapter("paged")
class PagedBars(BarSource):
    def bars(self) -> DataFrame:
        return read(self.spark, self.options["path"])


@adapter("store")
class StoreBars(BarSource):
    def bars(self) -> DataFrame:
        from tidemark.sources.store import BAR, BarStore

        found = BarStore(self.spark, self.options["path"]).load()
        return found if found is not None else self.spark.createDataFrame([], BAR)


@adapter("chart")
class ChartBars(BarSource):
    def bars(self) -> DataFrame:
        from tidemark.sources.store import chart_json

        return chart_json(self.spark, self.options["path"])


@adapter("candles")
class CandleBars(BarSource):
    def bars(self) -> DataFrame:
        from tidemark.sources.store import candles_csv

        return candles_csv(self.spark, self.options["path"])
