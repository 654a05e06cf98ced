"""Versioned tables, pages, idempotent batches and timers against plain loops."""

from __future__ import annotations

import datetime as dt
import json
import math
from decimal import Decimal
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.sources import paged, tables
from tidemark.streaming import batches, timers, windows as st

ROW = "k bigint, g string, v double, ts bigint"


def _table(spark, tmp_path, parts=8) -> tables.VersionedTable:
    return tables.VersionedTable(spark, f"file://{tmp_path}/t", ROW, ["k", "g"], parts)


def _rows(table) -> dict:
    return {(r["k"], r["g"]): r["v"] for r in table.load().collect()}


def test_changes_rewrite_only_the_partitions_they_touch(spark, tmp_path):
    table = _table(spark, tmp_path)
    assert table.load().count() == 0 and table.version().n == -1
    table.upsert(spark.range(100).selectExpr("id AS k", "'a' AS g", "CAST(id AS DOUBLE) AS v", "0L AS ts"))
    want = {(i, "a"): float(i) for i in range(100)}
    assert _rows(table) == want
    first = table.version().parts
    for change, update in (
        (lambda: table.upsert(spark.createDataFrame([(5, "a", -5.0, 1), (None, None, 7.0, 1)], ROW)), {(5, "a"): -5.0, (None, None): 7.0}),
        (lambda: table.patch(spark.createDataFrame([(None, None, 8.0), (9, "none", 1.0)], "k bigint, g string, v double")), {(None, None): 8.0}),
        (lambda: table.upsert(spark.createDataFrame([(5, "a", 5.5, 2), (200, "b", 2.0, 2)], ROW), "first"), {(200, "b"): 2.0}),
        (lambda: table.upsert(spark.createDataFrame([(5, "a", 6.5, 0), (200, "b", 3.0, 3)], ROW), "newest", ["ts"]), {(200, "b"): 3.0}),
        (lambda: table.delete(spark.createDataFrame([(None, None), (77, "a"), (77, "a"), (1000, "x")], "k bigint, g string")), {(None, None): None, (77, "a"): None}),
        (lambda: table.delete_where("k >= 98"), {(98, "a"): None, (99, "a"): None, (200, "b"): None}),
    ):
        before, n = table.version(), table.version().n
        assert change() == n + 1
        want = {k: v for k, v in (want | update).items() if v is not None}
        assert _rows(table) == want
        touched = {spark.createDataFrame([k], "k bigint, g string").select(table.part()).first()[0] for k in [*update, (5, "a"), (9, "none"), (77, "a"), (1000, "x")]}
        assert all(table.version().parts.get(p) == x for p, x in before.parts.items() if p not in touched)
    assert any(first[p] == table.version().parts.get(p) for p in first)
    # What lies between two versions.
    found = {(r["change"], r["k"], r["g"]) for r in table.changes(0).collect()}
    assert found == {("update", 5, "a"), ("delete", 77, "a"), ("delete", 98, "a"), ("delete", 99, "a")}
    assert table.changes(table.version().n).count() == 0 and table.load(0).count() == 100
    n = table.version().n
    assert table.delete_where("k < 0") == n and table.upsert(spark.createDataFrame([], ROW)) == n
    with pytest.raises(Exception, match="two rows of one key"):
        table.upsert(spark.createDataFrame([(1, "a", 1.0, 1), (1, "a", 2.0, 1)], ROW))
    with pytest.raises(ValueError, match="unknown columns"):
        table.patch(spark.createDataFrame([(1, "a", 1)], "k bigint, g string, other int"))


def test_a_change_that_comes_second_is_made_again(spark, tmp_path, monkeypatch):
    table, other = _table(spark, tmp_path, 1), _table(spark, tmp_path, 1)
    table.upsert(spark.createDataFrame([(1, "a", 1.0, 0)], ROW))
    taken, raced = tables.VersionedTable._taken, []

    def late(self, version):
        if self is table and not raced:
            raced.append(1)
            other.upsert(spark.createDataFrame([(2, "a", 2.0, 0)], ROW))
        return taken(self, version)

    monkeypatch.setattr(tables.VersionedTable, "_taken", late)
    table.upsert(spark.createDataFrame([(3, "a", 3.0, 0)], ROW))
    assert _rows(table) == {(1, "a"): 1.0, (2, "a"): 2.0, (3, "a"): 3.0} and table.version().n == 2


@pytest.mark.parametrize(("keep", "want"), [("newest", {(1, "a"): 30.0, (2, "a"): 5.0}), ("last", {(1, "a"): 20.0, (2, "a"): 5.0}), ("first", {(1, "a"): 10.0, (2, "a"): 5.0})])
def test_batches_that_end_between_two_writes_and_run_again(spark, tmp_path, monkeypatch, keep, want):
    table = _table(spark, tmp_path, 4)
    parts = [[(1, "a", 10.0, 1)], [(1, "a", 30.0, 9), (1, "a", 29.0, 8)] if keep == "newest" else [(1, "a", 30.0, 9)], [(1, "a", 20.0, 5), (2, "a", 5.0, 1)], []]
    taken = tables.VersionedTable._taken
    for number, rows in enumerate(parts):
        batch = spark.createDataFrame(rows, ROW)

        def stopped(self, version):
            raise RuntimeError("stopped")

        monkeypatch.setattr(tables.VersionedTable, "_taken", stopped)  # after the data, before the version
        with pytest.raises(RuntimeError):
            batches.applied(batch, number, table, "s", keep, ["ts"])
        monkeypatch.setattr(tables.VersionedTable, "_taken", taken)
        for _ in range(2):  # after the version, before the stream's own note
            assert batches.applied(batch, number, table, "s", keep, ["ts"]) == number
    assert _rows(table) == want and table.version().marks == {"s": 3}
    assert batches.applied(spark.createDataFrame([(7, "a", 1.0, 1)], ROW), 0, table, "other", keep, ["ts"]) == 4


def test_a_stream_upserts_once(spark, tmp_path):
    schema = "k bigint, g string, v double, ts bigint"
    for i in range(3):
        spark.createDataFrame([(j % 4, "a", float(10 * i + j), 10 - i) for j in range(8)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = _table(spark, tmp_path)
    for _ in range(2):  # the second run finds nothing new
        batches.upserting(stream, table, "s", f"file://{tmp_path}/c", "newest", ["ts", "v"]).awaitTermination()
        assert _rows(table) == {(k, "a"): float(k + 4) for k in range(4)}
    assert table.version().marks["s"] == 2


def test_admitted_rows_and_patches(spark):
    rows = spark.createDataFrame([("1", "x", "2.5", "z"), ("2", "", "1", "z"), (None, "y", "1", "z"), ("no", "y", "1", "z"), ("4", "w", "no", "z")], "id string, name string, v string, other string")
    got = tables.admitted(rows, "id bigint, name string, v double, later int", ["id", "name"])
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "x", 2.5, None), (4, "w", None, None)]
    assert tables.admitted(rows, "id bigint, later int", ["id"], ("later",), ["id"]).columns == ["id"]
    with pytest.raises(ValueError):
        tables.admitted(rows, "id bigint, later int", ["id"], (), ["id"])
    patches = spark.createDataFrame([(1, None, None, None, "l" * 900, [1]), (2, None, None, None, None, list(range(70))), (3, "tp_hit", 1.5, "d", "x", [1]), (4, "", None, "", None, None)], "id bigint, outcome string, outcome_price double, outcome_date string, lesson string, validations array<bigint>")
    values, given = tables.memory_patch(patches, "today")
    of = {r["id"]: {c: r[c] for c, flag in given.items() if r[flag]} for r in values.collect()}
    assert of == {1: {"lesson": "l" * 600}, 2: {"validations": list(range(50))}, 3: {"outcome": "tp_hit", "outcome_price": 1.5, "outcome_date": "d", "lesson": "x"}, 4: {"outcome": "expired", "outcome_price": None, "outcome_date": "today"}}


# Pages -------------------------------------------------------------------------------------------


def _pages(spark, path: str):
    rows = [(i, None if i % 7 == 0 else f"n{i:04d}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float("nan") if i == 55 else i / 3, Decimal(i) / 4, dt.datetime(2024, 1, 1, 0, 0, 0, 250) + dt.timedelta(hours=i), [i, i + 1]) for i in range(200)]
    frame = spark.createDataFrame(rows, "id bigint, name string, d date, x double, price decimal(12,2), ts timestamp_ntz, xs array<bigint>")
    paged.write(frame, path, ["id"], rows_per_page=10)
    return frame


def test_pages_hold_what_was_written(spark, tmp_path):
    frame = _pages(spark, str(tmp_path))
    got = paged.read(spark, f"file://{tmp_path}")
    assert got.schema == frame.schema and got.exceptAll(frame).count() == 0 and got.count() == 200
    assert paged.read(spark, str(tmp_path), ["x", "id"]).columns == ["x", "id"]
    _pages(spark, str(tmp_path))  # overwritten, not added to
    assert paged.read(spark, str(tmp_path)).count() == 200
    paged.write(frame.limit(5), str(tmp_path), ["id"], mode="append")
    assert paged.read(spark, str(tmp_path)).count() == 205
    empty = tmp_path / "empty"
    paged.write(frame.limit(0), str(empty), ["id"])
    assert paged.read(spark, str(empty)).count() == 0


CONDITIONS = ["id = 57", "id > 187", "id <= 12", "id IN (3, 150, 999)", "d = DATE'2024-02-01'", "d >= DATE'2024-07-01' AND id < 185", "name IS NULL AND id < 20", "name >= 'n0190'", "name <=> 'n0101'", "id = 57 AND name IS NULL", "x > 60", "x = 19.0", "price > 49", "ts > TIMESTAMP_NTZ'2024-01-09 00:00:00'", "id < 0", "id = 3 OR id = 190"]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_filters_close_pages(spark, tmp_path, condition):
    """Pages that no row of the answer lies in are taken away: reading would fail if one were opened."""
    frame = _pages(spark, str(tmp_path))
    want = frame.filter(condition)
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    pushed = not any(x in condition for x in ("OR", "price", "ts >"))
    if pushed:
        ids = {r["id"] for r in want.collect()}
        for page in manifest["pages"]:
            _, low, high = page["columns"]["id"]
            if not ids & set(range(low, high + 1)) and not (condition.startswith("x ") and page["columns"]["x"][1] is None) and not (condition == "id = 57 AND name IS NULL"):
                (tmp_path / page["file"]).unlink()
    got = paged.read(spark, str(tmp_path)).filter(condition)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_the_plan_shows_the_filter_and_a_limit_opens_no_later_page(spark, tmp_path):
    _pages(spark, str(tmp_path))
    plan = paged.read(spark, str(tmp_path)).filter("id > 187 AND name IS NOT NULL")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Filter (" not in plan and "Scan" in plan, plan
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    for page in manifest["pages"]:
        if page["columns"]["id"][1] >= 120:
            (tmp_path / page["file"]).unlink()
    assert [r["id"] for r in paged.read(spark, str(tmp_path), limit=15).filter("id >= 101").collect()] == list(range(101, 116))


def test_adapters(spark, tmp_path):
    bars = spark.createDataFrame([("A", dt.date(2024, 1, i), 1.0, 2.0, 0.5, float(i), 1) for i in range(1, 9)] + [("B", dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 9.0, 1)], "instrument string, d date, o double, h double, l double, c double, v bigint")
    paged.write(bars, str(tmp_path), ["instrument", "d"], 3)
    source = paged.bars_of("PAGED", spark, path=str(tmp_path))
    assert source.history(["A"], "2024-01-03", "2024-01-05").count() == 3 and source.history(None, "2024-01-02", "2024-01-02").count() == 2
    assert {(r["instrument"], r["c"]) for r in source.latest().collect()} == {("A", 8.0), ("B", 9.0)}
    with pytest.raises(KeyError, match="paged"):
        paged.bars_of("nothing", spark)


# Timers ------------------------------------------------------------------------------------------


def _stream(spark, tmp_path, frames: list[pd.DataFrame], schema: str):
    """A stream of one file a micro-batch, in order."""
    for i, f in enumerate(frames):
        spark.createDataFrame(f, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for p in Path(f"{tmp_path}/in/{i}").glob("*.parquet"):
            import os

            os.utime(p, (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def _events(seed: int, n: int, keys: str, spread: float):
    rng = np.random.default_rng(seed)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, int(spread), n)), unit="ms")
    rows = pd.DataFrame({"key": rng.choice(list(keys), n), "ts": ts, "event_id": np.arange(n), "value": rng.normal(10, 4, n).round(2)})
    late = rng.random(n) < 0.3  # up to two minutes late, which the delay allows
    at = rows["ts"] + pd.to_timedelta(np.where(late, rng.integers(0, 120_000, n), 0), unit="ms")
    return rows.iloc[np.argsort(at, kind="stable")]


def test_silences_of_late_events_are_those_of_the_gaps(spark, tmp_path):
    rows = _events(3, 300, "ABC", 4 * 3600 * 1000)
    frames = [rows.iloc[i : i + 60] for i in range(0, 300, 60)]
    frames[0] = pd.concat([frames[0], pd.DataFrame({"key": [None, "D"], "ts": [pd.Timestamp("2024-01-01"), pd.Timestamp("2024-01-01")], "event_id": [900, 901], "value": [1.0, 1.0]})])
    stream = _stream(spark, tmp_path, frames, "key string, ts timestamp, event_id bigint, value double")
    with timers.state_store(spark):
        got = {tuple(r) for r in st.drained(timers.silences(stream.select("key", "ts"), 300, "3 minutes"), "silences").collect()}
    passed = (rows["ts"].max() - pd.Timedelta(minutes=3)).floor("ms")
    want, gap = set(), pd.Timedelta(seconds=300)
    for key, part in [*rows.groupby("key"), ("D", frames[0].tail(1))]:
        times = sorted(part["ts"])
        want |= {(key, a, a + gap) for a, b in zip(times, [*times[1:], pd.Timestamp.max], strict=True) if b - a > gap and a + gap < passed}
    assert len(want) > 20 and {(k, pd.Timestamp(a), pd.Timestamp(b)) for k, a, b in got} == want


def test_sessions_end_with_their_day_and_leave_no_state(spark, tmp_path):
    rows = _events(4, 400, "AB", 4.5 * 86_400_000)
    rows.loc[rows["event_id"] == 3, "value"] = None
    frames = [rows.iloc[i : i + 80] for i in range(0, 400, 80)]
    stream = _stream(spark, tmp_path, frames, "key string, ts timestamp, event_id bigint, value double")
    with timers.state_store(spark):
        found = timers.sessions(stream, "3 minutes")
        out, state = f"file://{tmp_path}/out", f"file://{tmp_path}/state"
        found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        got = {(r["key"], r["day"]): tuple(r)[2:] for r in spark.read.parquet(out).collect()}
        held = spark.read.format("statestore").option("stateVarName", "day").load(state).select("key.*").collect()
    known = rows.dropna(subset=["value"])
    passed, want = known["ts"].max() - pd.Timedelta(minutes=3), {}
    for (key, day), part in known.assign(day=known["ts"].dt.date).groupby(["key", "day"]):
        if pd.Timestamp(day) + pd.Timedelta(days=1) <= passed:
            v = part.sort_values(["ts", "event_id"])["value"]
            want[key, day] = (v.iloc[0], v.iloc[-1], v.min(), max(0.0, 1 - v.min() / v.iloc[0]) if v.iloc[0] > 0 else 0.0)
    assert len(want) == 8 and got.keys() == want.keys() and all(math.isclose(a, b) for k in want for a, b in zip(got[k], want[k], strict=True))
    assert {(r["key"], r["day"]) for r in held} == {(k, dt.date(2024, 1, 5)) for k in "AB"}


# Sinks -------------------------------------------------------------------------------------------


def test_states_ledgers_and_reports(spark, tmp_path):
    from tidemark.sources import sinks

    state = sinks.JsonState(spark, f"file://{tmp_path}/s")
    assert state.load() is None and [state.save({"n": i, "d": dt.date(2024, 1, 1)}) for i in range(3)] == [0, 1, 2]
    (tmp_path / "s/states/000000000003.json").write_text('{"n": 3, "cut')
    assert state.load() == {"n": 2, "d": "2024-01-01"} and state.save({"n": 4}) == 4 and state.load() == {"n": 4}
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "id int, v string")
    path = f"file://{tmp_path}/ledger"
    assert [sinks.append_ledger(rows, path, ["id"], "local"), sinks.append_ledger(rows, path, ["id"], "local"), sinks.append_ledger(rows.limit(0), path, ["id"], "local")] == [3, 0, 0]
    assert sinks.append_ledger(spark.createDataFrame([(3, "c"), (2, "x")], "id int, v string"), path, ["id"], "local", "why") == 1
    kept = {(r["row"]["id"], r["row"]["v"], r["reason"]) for r in spark.read.schema("source string, reason string, row struct<id:int,v:string>").json(path).collect()}
    assert kept == {(1, "a", ""), (None, "b", ""), (2, None, ""), (3, "c", "why")}
    text, page = sinks.report({"rows": rows.orderBy("id", "v"), "empty": rows.limit(0)}, "Night")
    assert json.loads(text)["tables"]["rows"][0] == {"id": None, "v": "b"} and "| 2 |  |" in page and page.startswith("# Night\n") and "## 2. empty\n\nnone" in page
    with pytest.raises(ValueError, match="more than"):
        sinks.report({"x": spark.range(1001)}, "t")
