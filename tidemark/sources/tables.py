"""Tables of immutable versions with row-level changes: upsert, patch and delete rewrite only the partitions that they touch.

A row lies in the partition of its key's hash, of ``parts`` in all. A version is a small manifest that names the folder of each partition; a change
reads and writes the partitions of the keys that it names, and its manifest takes over the folders of all others as they are. Readers, and tasks that run
again, see whole versions. The number of a version is taken by creating its file, which must not exist; who comes second makes the change again on what the first has made, so that no
change is lost where a file system creates files exclusively. A partition is small if ``parts`` fits the table; it's chosen once, when the table is made.

The change itself (rows by key) may be of any size: it is joined, never collected. The driver sees the numbers of the partitions that it touches.

Defined results: keys may hold nulls, which are equal to each other. A change that names a key twice is an error in upsert and patch (which of the two to take is the caller's to say), and
nothing in delete. A change without rows makes no version, but with a mark. Columns that the table doesn't have are an error; ``admitted`` drops them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Version:
    """A number, the folder of each partition that has rows, and by name the last number of the changes that were marked."""

    n: int
    parts: dict[int, str]
    marks: dict[str, int]


class VersionedTable:
    """Rows with unique keys under a folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], parts: int = 64, by: list[str] | None = None) -> None:
        """by: the keys whose hash says the partition, all unless given."""
        self.spark, self.folder, self.schema, self.keys, self.parts = spark, folder.rstrip("/"), schema, keys, parts
        self.by = by or keys
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]

    # Versions ----------------------------------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> DataFrame | None:
        path, fs = self._path("versions")
        return self.spark.read.schema("n bigint, parts map<string,string>, marks map<string,bigint>").json(f"{self.folder}/versions").filter("parts IS NOT NULL") if fs.exists(path) else None

    def version(self, n: int | None = None) -> Version:
        """The version of that number, or the newest; one without rows, of number -1, before the first."""
        rows = self._versions()
        row = None if rows is None else rows.orderBy(F.desc("n")).first() if n is None else rows.filter(F.col("n") == n).first()
        if row is None and n is not None and n >= 0:
            raise ValueError(f"no version {n}")
        return Version(-1, {}, {}) if row is None else Version(row["n"], {int(p): x for p, x in row["parts"].items()}, dict(row["marks"] or {}))

    def _committed(self, version: Version) -> bool:
        return self._taken(version)

    def _taken(self, version: Version) -> bool:
        return self._created(f"versions/{version.n:012d}.json", json.dumps({"n": version.n, "parts": version.parts, "marks": version.marks}))

    def _created(self, name: str, text: str) -> bool:
        """Creates a file that must not exist; False if it does."""
        path, fs = self._path(name)
        try:
            out = fs.create(path, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception):
                return False
            raise
        out.write(bytearray(text, "utf-8"))
        out.close()
        return True

    def part(self) -> Column:
        return F.pmod(F.hash(*self.by), F.lit(self.parts))

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("ignoreCorruptFiles", True).parquet(*[f"{self.folder}/{x}" for x in sorted(folders)])

    def load(self, n: int | None = None) -> DataFrame:
        """All rows of a version, the newest unless given; damaged files are skipped."""
        return self._read(list(self.version(n).parts.values()))

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """What changed between two versions: change (insert, update, delete) and the row, the new one of an update. Only partitions that changed are read."""
        old, new = self.version(since).parts, self.version(until).parts
        differ = [p for p in old.keys() | new.keys() if old.get(p) != new.get(p)]
        before, after = (self._read([x[p] for p in differ if p in x]) for x in (old, new))
        gone = self._matched(before, after, "left_anti").withColumn("change", F.lit("delete"))
        added = self._matched(after, before, "left_anti").withColumn("change", F.lit("insert"))
        same = F.lit(True)
        for c in self.columns:
            same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        both = self._matched(after, before, "inner").filter(~same).select("a.*").withColumn("change", F.lit("update"))
        return added.unionByName(both).unionByName(gone).select("change", *self.columns)

    # Changes -----------------------------------------------------------------------------------------

    def _unique(self, rows: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*self.keys))
        return rows.withColumn(self.columns[0], F.when(n == 1, F.col(self.columns[0])).otherwise(F.raise_error(F.lit("two rows of one key in a change"))))

    def _change(self, change: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], mark: tuple[str, int] | None = None) -> int:
        """Applies merged(old, change) to the partitions that change touches, until its version is taken; the number of the newest version.

        mark: a name and a number that rises; a change whose number the table has already seen under that name does nothing. It is written with the version, so a change and its mark are there both or not at all."""
        touched = sorted(r[0] for r in change.select(self.part()).distinct().collect())
        while True:
            old = self.version()
            if (mark and old.marks.get(mark[0], -1) >= mark[1]) or (not touched and not mark):
                return old.n
            parts = {p: x for p, x in old.parts.items() if p not in touched}
            if touched:
                rows = merged(self._read([old.parts[p] for p in touched if p in old.parts]), change).select(*self.columns)
                name = f"data-{uuid.uuid4().hex}"
                rows.withColumn("_part", self.part()).repartition(min(len(touched), self.parts), "_part").write.partitionBy("_part").parquet(f"{self.folder}/{name}")
                parts |= {p: f"{name}/_part={p}" for p in touched if self._there(f"{name}/_part={p}")}
            if self._committed(Version(old.n + 1, parts, old.marks | ({mark[0]: mark[1]} if mark else {}))):
                return old.n + 1

    def _there(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def _matched(self, old: DataFrame, change: DataFrame, how: str) -> DataFrame:
        a, b = old.alias("a"), change.alias("b")
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
        return a.join(b, on, how)

    def upsert(self, rows: DataFrame, keep: str = "last", by: list[str] | None = None, mark: tuple[str, int] | None = None) -> int:
        """Adds rows; of a key that is there already the new row stays (last), the old one (first), or the one that is greater by some columns, the old one if neither is (newest)."""
        rows = self._unique(rows.select(*self.columns))

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            if keep == "last":
                return self._matched(old, new, "left_anti").unionByName(new)
            if keep == "first":
                return old.unionByName(self._matched(new, old, "left_anti"))
            both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            order = Window.partitionBy(*self.keys).orderBy(*[F.desc_nulls_last(c) for c in by or []], "_new")
            return both.withColumn("_k", F.row_number().over(order)).filter("_k = 1")

        return self._change(rows, merged, mark)

    def patch(self, values: DataFrame, given: dict[str, str] | None = None) -> int:
        """Sets the columns of values, by key, in rows that are there; other keys are ignored. given: by column, the boolean column of values that says whether it is set (always, unless named)."""
        given = given or {}
        sets = [c for c in values.columns if c not in self.keys and c not in given.values()]
        unknown = [c for c in sets if c not in self.columns]
        if unknown:
            raise ValueError(f"unknown columns {unknown}")
        n = F.count("*").over(Window.partitionBy(*self.keys))
        change = values.withColumn("_there", F.when(n == 1, True).otherwise(F.raise_error(F.lit("two rows of one key in a change")).cast("boolean")))

        def merged(old: DataFrame, change: DataFrame) -> DataFrame:
            on = lambda c: F.coalesce(F.col("b._there"), F.lit(False)) & (F.coalesce(F.col(f"b.{given[c]}"), F.lit(False)) if c in given else F.lit(True))
            return self._matched(old, change, "left").select(*[F.when(on(c), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) if c in sets else F.col(f"a.{c}") for c in self.columns])

        return self._change(change, merged)

    def delete(self, keys: DataFrame) -> int:
        """Deletes the rows of these keys."""
        return self._change(keys.select(*self.keys).distinct(), lambda old, gone: self._matched(old, gone, "left_anti"))

    def delete_where(self, condition: Column | str) -> int:
        """Deletes the rows that meet a condition; only partitions that hold any are rewritten."""
        return self.delete(VersionedTable.load(self).filter(condition).select(*self.keys))


def admitted(rows: DataFrame, schema: str, required: list[str], added_later: tuple[str, ...] = (), of: list[str] | None = None) -> DataFrame:
    """Rows fit for a table: its columns only, cast (null where that fails), null where rows lack one; none without all the required values, where an empty text is none.

    of: the columns that the table really has; those added later are left out where it has them not, any other that it lacks is an error."""
    kinds = {f.name: f.dataType for f in rows.sparkSession.createDataFrame([], schema).schema}
    lacking = [c for c in kinds if of is not None and c not in of]
    if unknown := [c for c in lacking if c not in added_later]:
        raise ValueError(f"the table lacks {unknown}")
    there = {f.name: f.dataType for f in rows.schema}
    cast = [(F.col(c) if there[c] == k else F.col(c).try_cast(k)).alias(c) if c in there else F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in lacking]
    some = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in required]
    out = rows.select(*cast)
    for x in some:
        out = out.filter(x)
    return out


# Patches of a research memory --------------------------------------------------------------------

#: Longest texts, and most re-checks of a row, fixed values.
LESSON, CHECKS = 600, 50


def memory_patch(patches: DataFrame, today: str) -> tuple[DataFrame, dict[str, str]]:
    """What patches (id, outcome, outcome_price, outcome_date, lesson, validations) set, for ``VersionedTable.patch``: values and which of them are set.

    A lesson without outcome sets the lesson alone, else validations without outcome set these alone, else the outcome is set ('expired' if none is given), its price and its date
    (today if none), and the lesson if there is one. A lesson keeps LESSON characters, validations the first CHECKS."""
    only_lesson = F.col("lesson").isNotNull() & F.col("outcome").isNull()
    only_checks = ~only_lesson & F.col("validations").isNotNull() & F.col("outcome").isNull()
    result = ~only_lesson & ~only_checks
    values = patches.select(
        "id",
        F.coalesce(F.nullif("outcome", F.lit("")), F.lit("expired")).alias("outcome"),
        "outcome_price",
        F.coalesce(F.nullif("outcome_date", F.lit("")), F.lit(today)).alias("outcome_date"),
        F.substring("lesson", 1, LESSON).alias("lesson"),
        F.slice("validations", 1, CHECKS).alias("validations"),
        result.alias("_result"),
        F.col("lesson").isNotNull().alias("_lesson"),
        only_checks.alias("_checks"),
    )
    return values, {"outcome": "_result", "outcome_price": "_result", "outcome_date": "_result", "lesson": "_lesson", "validations": "_checks"}
