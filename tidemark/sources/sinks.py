"""Small sinks: a state in JSON, a ledger of JSON lines, a report of a few tables.

* ``JsonState`` keeps every state as a file of its own that must not exist when it is made, so a process that ends while it writes leaves the state before it; ``load`` takes the newest that can be read.
* ``append_ledger`` adds the rows that a ledger doesn't have yet, by key, in one commit: a run that is repeated adds nothing.
* ``report`` writes tables that are small by what they are (at most ``MOST`` rows, else an error) as one JSON and one Markdown file.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import VersionedTable

#: Most rows of a table in a report.
MOST = 1000


class JsonState:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.files = spark, VersionedTable(spark, folder, "n bigint", ["n"])

    def _all(self) -> list[tuple[int, str]]:
        path, fs = self.files._path("states")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(n.removesuffix(".json")), n) for n in names if n.endswith(".json"))

    def save(self, state: dict) -> int:
        """The number of the new state; of two writers at once each gets its own."""
        text, n = json.dumps(state, default=str), max([n for n, _ in self._all()], default=-1) + 1
        while not self.files._created(f"states/{n:012d}.json", text):
            n += 1
        return n

    def load(self) -> dict | None:
        """The newest state that is whole, None without one."""
        for _, name in reversed(self._all()):
            text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.files.folder}/states/{name}").collect())
            try:
                return json.loads(text)
            except ValueError:
                continue
        return None


def append_ledger(rows: DataFrame, path: str, keys: list[str], source: str, reason: str = "") -> int:
    """Appends rows as {recorded_at, source, reason, row}, those whose keys the ledger has already left out; rows of one key that come together are one (any). How many it added."""
    spark = rows.sparkSession
    shape = f"recorded_at timestamp, source string, reason string, row struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in rows.schema.fields)}>"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = rows.dropDuplicates(keys).alias("a")
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        old = spark.read.schema(shape).option("mode", "DROPMALFORMED").json(path).select(*[F.col(f"row.{k}").alias(k) for k in keys]).alias("b")
        same = F.lit(True)
        for k in keys:
            same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        new = new.join(old, same, "left_anti")
    counted = Observation()
    out = new.select(F.current_timestamp().alias("recorded_at"), F.lit(source).alias("source"), F.lit(reason).alias("reason"), F.struct("a.*").alias("row"))
    out.observe(counted, F.count("*").alias("n")).write.mode("append").json(path)
    return int(counted.get["n"])


def report(tables: dict[str, DataFrame], title: str) -> tuple[str, str]:
    """(JSON, Markdown) of small tables under their names, in the order of their columns and rows."""
    found: dict[str, list[dict]] = {}
    for name, frame in tables.items():
        rows = frame.limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"{name} has more than {MOST} rows")
        found[name] = [r.asDict(recursive=True) for r in rows]
    lines = [f"# {title}", ""]
    for i, (name, rows) in enumerate(found.items(), 1):
        columns = tables[name].columns
        lines += [f"## {i}. {name}", "", *([f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}", *[f"| {' | '.join('' if r[c] is None else str(r[c]).replace('|', chr(92) + '|') for c in columns)} |" for r in rows]] if rows else ["none"]), ""]
    return json.dumps({"title": title, "tables": found}, default=str, indent=2), "\n".join(lines)
