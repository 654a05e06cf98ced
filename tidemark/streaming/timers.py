"""State with timers: keys that fall silent, and anchors of a session that end with it.

Both keep little and give back a row when the watermark passes the time that a timer was set for; they need a state store with column families, which ``started`` sets for the query alone.

* ``silences``: a row for each time that a key had no event for longer than the timeout. The state of a key is the last event that the watermark has passed and the runs of
  events after it (first and last time; events no further apart than the timeout are one run), so a late event, not beyond the watermark's delay, still closes a gap.
* ``sessions``: a row for each key and UTC day when the day has ended: its first value as anchor, the last one, the worst loss against the anchor. The state of a day goes with its row.

Defined results: events with a null time or key are left out; of events at one time the one with the least id is first and that with the greatest id last. Events later than the delay are dropped by the stream. A session whose
anchor isn't positive has loss 0. A null value counts as no event of a session.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in a store with column families and timers; afterwards the setting is as before."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def _us(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


def joined_runs(runs: list[tuple[int, int]], timeout: int) -> list[tuple[int, int]]:
    """Runs (first, last) in order; what is no further apart than timeout is one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a - out[-1][1] <= timeout:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Silence(StatefulProcessor):
    """last: the newest event that the watermark has passed; told: whether its silence has been given; first, until: the runs after it."""

    def __init__(self, timeout_us: int) -> None:
        self.timeout = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", "last bigint, told boolean, first array<bigint>, until array<bigint>")

    def _stepped(self, key: tuple, more: list[tuple[int, int]], watermark: int) -> Iterator[pd.DataFrame]:
        """Takes up further runs and moves on to the watermark (microseconds); the silences that have become certain."""
        last, told, first, until = self.state.get() if self.state.exists() else (None, True, [], [])
        runs, out = joined_runs(list(zip(first, until, strict=True)) + more, self.timeout), []
        while True:
            if not told:
                if runs and runs[0][0] - last <= self.timeout:
                    runs[0], last, told = (last, runs[0][1]), None, True
                elif watermark > last + self.timeout:
                    out.append((*key, last, last + self.timeout))
                    told = True
                else:
                    break
            # While the watermark lies before a run's end, a late event may still follow that end.
            if not runs or runs[0][1] > watermark:
                break
            last, told = runs.pop(0)[1], False
        self.state.update((last, told, [a for a, _ in runs], [b for _, b in runs]))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = runs[0][1] if told and runs else None if told else last + self.timeout
        if due is not None:
            self.handle.registerTimer(max(due, watermark) // 1000 + 1)
        if out:
            yield pd.DataFrame({"key": [r[0] for r in out]} | {c: pd.to_datetime(pd.Series([r[i] for r in out], dtype="int64"), unit="us") for i, c in ((1, "last_seen"), (2, "silent_at"))})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs: list[tuple[int, int]] = []
        for frame in rows:
            runs = joined_runs(runs + [(t, t) for t in _us(frame["ts"]).tolist()], self.timeout)
        yield from self._stepped(key, runs, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._stepped(key, [], timerValues.getCurrentWatermarkInMs() * 1000)


def silences(events: DataFrame, timeout_s: int, delay: str) -> DataFrame:
    """(key, last_seen, silent_at) of a stream (key, ts): keys without an event for more than timeout_s seconds, given once the watermark is beyond silent_at."""
    kind = events.schema["key"].dataType.simpleString()
    marked = events.filter("key IS NOT NULL AND ts IS NOT NULL").select("key", "ts").withWatermark("ts", delay)
    return marked.groupBy("key").transformWithStateInPandas(Silence(timeout_s * 1_000_000), f"key {kind}, last_seen timestamp, silent_at timestamp", "append", "EventTime")


class Session(StatefulProcessor):
    """The first and last value of a key's day and the least value since, until the day ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("day", "times array<bigint>, ids array<bigint>, values array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had = self.state.get() if self.state.exists() else ([], [], [])
        held = pd.DataFrame({"t": list(had[0]), "id": list(had[1]), "value": list(had[2])})
        for frame in rows:
            new = pd.DataFrame({"t": _us(frame["ts"]), "id": frame["event_id"], "value": frame["value"]})
            held = pd.concat([held, new]) if len(held) else new
            held = self._needed(held)
        self.state.update((held["t"].astype(int).tolist(), held["id"].astype(int).tolist(), held["value"].astype(float).tolist()))
        if not list(self.handle.listTimers()):
            end = (pd.Timestamp(key[1]) + pd.Timedelta(days=1)).value // 1_000_000
            self.handle.registerTimer(int(end))
        yield from ()

    @staticmethod
    def _needed(rows: pd.DataFrame) -> pd.DataFrame:
        """The first and last event and the least value; nothing else of a day can matter."""
        rows = rows.sort_values(["t", "id"], kind="stable").reset_index(drop=True)
        return rows.iloc[sorted({0, len(rows) - 1, int(rows["value"].argmin())})]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, values = self.state.get()
        self.state.clear()
        anchor, least = values[0], min(values)
        yield pd.DataFrame({"key": [key[0]], "day": [key[1]], "anchor": [anchor], "last": [values[-1]], "least": [least], "loss": [max(0.0, 1 - least / anchor) if anchor > 0 else 0.0]})


def sessions(events: DataFrame, delay: str) -> DataFrame:
    """(key, day, anchor, last, least, loss) of each ended UTC day of a stream (key, ts, event_id, value)."""
    kind = events.schema["key"].dataType.simpleString()
    kept = events.filter("key IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL").select("key", "ts", "event_id", "value").withWatermark("ts", delay)
    by_day = kept.withColumn("day", F.to_date(F.to_utc_timestamp("ts", F.current_timezone())))
    return by_day.groupBy("key", "day").transformWithStateInPandas(Session(), f"key {kind}, day date, anchor double, last double, least double, loss double", "append", "EventTime")
