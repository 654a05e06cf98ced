"""Fading averages, accounts and labels on small inputs."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import desk, scores
from tidemark.operators import recurrences


def test_fading_averages_are_those_of_a_walk(spark):
    rng = np.random.default_rng(1)
    rows = []
    for name, n, step in (("A", 400, 1), ("B", 1, 1), ("C", 30, 45)):  # C has months without a row
        rows += [(name, dt.date(2020, 1, 1) + dt.timedelta(days=i * step), None if name == "A" and i in (0, 7, 60) else float(rng.normal(100, 20))) for i in range(n)]
    spans = {"fast": 0.2, "mid": 1 - 2 / 13, "slow": 0.99, "same": 0.0}
    got = recurrences.faded(spark.createDataFrame(rows, "instrument string, d date, c double").repartition(3), "c", spans).toPandas().sort_values(["instrument", "d"])
    for name in "ABC":
        want = pd.Series([r[2] for r in rows if r[0] == name and r[2] is not None])
        part = got[got.instrument == name]
        assert len(part) == len(want)
        for s, q in spans.items():
            assert np.allclose(part[s], want.ewm(alpha=1 - q, adjust=False).mean(), rtol=1e-10), (name, s)
    assert recurrences.faded(spark.createDataFrame([], "instrument string, d date, c double"), "c", spans).count() == 0


ACCOUNT = "struct<net_income:double,cash_flow:double,assets:double,debt:double,current_assets:double,current_liabilities:double,shares:double,gross_profit:double,revenue:double,receivables:double,plant:double,depreciation:double,overhead:double>"


@pytest.mark.parametrize(
    ("now", "before", "score", "m"),
    [
        ((10, 20, 100, 5, 30, 10, 100, 40, 80, 8, 20, 4, 6), (5, 6, 90, 6, 20, 10, 100, 30, 70, 7, 20, 4, 6), 9, True),
        ((-1, -2, 100, 9, 20, 10, 110, 20, 60, 8, 20, 4, 6), (5, 6, 90, 6, 30, 10, 100, 30, 70, 7, 20, 4, 6), 0, True),
        # Equal years: leverage, liquidity, shares, margin and turnover don't fall.
        ((1, 1, 10, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1), (1, 1, 10, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1), 7, True),
        (tuple([None] * 13), tuple([None] * 13), 5, False),
        ((1, 1, 10, 1, 1, 1, 102, 1, 1, 1, 1, 0, 1), (1, 1, 10, 1, 1, 1, 100, 1, 1, 1, 1, 1, 1), 7, False),
    ],
)
def test_accounts(spark, now, before, score, m):
    cast = lambda t: tuple(None if x is None else float(x) for x in t)
    row = spark.createDataFrame([(cast(now), cast(before))], f"now {ACCOUNT}, before {ACCOUNT}").select(scores.strength("now", "before").alias("s"), scores.manipulation("now", "before").alias("m")).first()
    assert row["s"] == score and (row["m"] is not None) == m
    if now == before and m:
        assert abs(row["m"] - (-4.84 + 0.92 + 0.528 + 0.404 + 0.892 + 0.115 - 0.172 - 0.327)) < 1e-12


def test_labels_are_corrected_by_their_own_coins(spark):
    rows = [("LTC/USD", "x", "Forex"), ("BTC/USD", "x", "Crypto"), ("ARB/USDT", "x", "Crypto"), ("spy", "Equity", "ETF"), ("AAPL", "Equity", "Stock"), ("AAPL", "Odd", "Odd")]
    got = spark.createDataFrame(rows, "symbol string, label string, want string").select("want", desk.taxonomy(F.col("symbol"), F.col("label")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_entries_of_a_few_series(spark):
    """Short, flat and null-free series: nothing before a series has its bars, and a flat one has no crossing."""
    from tidemark.operators import entries

    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("long", 260), ("short", 9), ("flat", 120)):
        c = np.full(n, 50.0) if name == "flat" else 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        rows += [(name, dt.date(2022, 1, 3) + dt.timedelta(days=i), float(x), float(x * (1 if name == "flat" else 1.01)), float(x * (1 if name == "flat" else 0.99)), float(x), int(rng.integers(1, 9))) for i, x in enumerate(c)]
    bars = spark.createDataFrame(rows, "instrument string, d date, o double, h double, l double, c double, v bigint")
    found = entries.entries(bars, bars.select("instrument", "d", F.lit("up/low").alias("regime"))).toPandas()
    assert set(found.instrument) == {"long"} and found.strategy.nunique() > 15
    c = pd.Series([r[2] for r in rows if r[0] == "long"])
    start = pd.Timestamp("2022-01-03")
    at = lambda s: {((pd.Timestamp(d) - start).days, side) for d, side in zip(s.d, s.side, strict=True)}

    def crossings(fast, slow):
        return {(i, 1 if fast[i] > slow[i] else -1) for i in range(1, len(c)) if not np.isnan(slow[i - 1]) and ((fast[i - 1] <= slow[i - 1] and fast[i] > slow[i]) or (fast[i - 1] >= slow[i - 1] and fast[i] < slow[i]))}

    def ema(p):
        out = np.full(len(c), np.nan)
        out[p - 1] = c[:p].mean()
        for i in range(p, len(c)):
            out[i] = out[i - 1] + 2 / (p + 1) * (c[i] - out[i - 1])
        return out

    assert at(found[found.strategy == "sma_10_50"]) == crossings(c.rolling(10).mean().to_numpy(), c.rolling(50).mean().to_numpy())
    assert at(found[found.strategy == "ema_10_50"]) == crossings(ema(10), ema(50)) and at(found[found.strategy == "px_ema50"]) == crossings(c.to_numpy(), ema(50))
    assert (found[found.strategy == "sma_10_50"].twin).all() and not found[found.strategy == "bb_revert"].twin.any()
    b = found[found.strategy == "bb_revert"]
    mid = c.rolling(20).mean()
    assert len(b) and all(abs(t - mid[(pd.Timestamp(d) - start).days]) < 1e-9 for d, t in zip(b.d, b.target, strict=True))


def test_sessions_by_class_and_weekends(spark):
    from tidemark.functions import calendars

    rows = [
        ("2024-01-07 22:00:00", "forex", "1d", "2024-01-08 00:00:00", True),  # Sunday 17:00 in New York: Monday's session, whose own date is no weekend
        ("2024-01-08 00:00:00", "forex", "1d", "2024-01-08 00:00:00", False),  # already a session
        ("2024-07-05 20:59:00", "forex", "1d", "2024-07-06 00:00:00", False),
        ("2024-01-06 10:00:00", "equity", "1d", "2024-01-06 00:00:00", True),
        ("2024-01-05 22:30:00", "forex", "1h", "2024-01-05 22:30:00", True),
        ("2024-01-07 20:59:00", "forex", "15m", "2024-01-07 20:59:00", True),
        ("2024-01-07 21:00:00", "forex", "15m", "2024-01-07 21:00:00", False),
        ("2024-01-09 00:00:00", "forex", "1w", "2024-01-09 00:00:00", True),
        ("2024-01-09 00:00:00", "equity", "1w", "2024-01-09 00:00:00", False),
        ("2024-01-06 10:00:00", "crypto", "1h", "2024-01-06 10:00:00", False),
    ]
    df = spark.createDataFrame(rows, "t string, kind string, frame string, want string, off boolean").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = df.select("want", "off", calendars.session_date(F.col("t"), F.col("kind"), F.col("frame")).cast("string").alias("session"), calendars.off_calendar(F.col("t"), F.col("kind"), F.col("frame")).alias("is_off")).collect()
    assert all(r["session"] == r["want"] and r["off"] == r["is_off"] for r in got), got


@pytest.mark.parametrize("h", [1, 3])
def test_diebold_mariano_of_every_pair(spark, h):
    from tidemark.operators import pairs

    rng = np.random.default_rng(2)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), None if rng.random() < 0.1 else float(rng.normal(0, s))) for k, s in (("A", 1.0), ("B", 1.2), ("C", 0.0)) for i in range(80)]
    rows += [("D", dt.date(2030, 1, 1), 1.0)]
    both = pairs.aligned(spark.createDataFrame(rows, "instrument string, d date, r double"))
    got = {(r["a"], r["b"]): (r["n"], r["dm"]) for r in pairs.diebold_mariano_pairs(both, h).collect()}
    assert set(got) == {("A", "B"), ("A", "C"), ("B", "C")}
    of = {k: {d: r for i, d, r in rows if i == k and r is not None} for k in "ABC"}
    for (a, b), (n, dm) in got.items():
        days = sorted(of[a].keys() & of[b].keys())
        e = np.array([of[b][d] ** 2 - of[a][d] ** 2 for d in days])
        c = e - e.mean()
        v = (c * c).mean() + 2 * sum((1 - k / h) * (c[k:] * c[:-k]).mean() for k in range(1, h))
        want = e.mean() / np.sqrt(v / len(e)) if v > 0 else 0.0
        assert n == len(days) and abs(dm - want * np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)) < 1e-9


def test_printed_numbers_round_the_exact_value(spark):
    """Halves that a double holds exactly go to the even digit, as in C; those that it doesn't go by its value, not by its shortest digits."""
    x = [100.125, 100.375, 0.00005, 1.00005, 10000.125, 12345678.375, 0.03125, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").select("i", desk.price_text(F.col("v"), F.lit("Stock")).alias("p"), desk.price_text(F.col("v"), F.lit("Forex")).alias("f"), desk.percent_text(F.col("v")).alias("c"), desk.volume_text(F.col("v") * 2000).alias("n"))
    got = {r["i"]: r for r in df.collect()}
    assert [got[i]["p"] for i in range(7)] == ["100.12", "100.38", f"{0.00005:.4f}", f"{1.00005:.4f}", "10,000.12", "12,345,678.38", "0.0312"]
    assert [got[i]["f"] for i in range(7)] == [f"{v:.5f}" for v in x[:7]] and [got[i]["c"] for i in range(7)] == [f"+{v:.2f}%" for v in x[:7]]
    assert [got[i]["n"] for i in (0, 1, 2, 3, 6, 7)] == ["200.2K", "200.8K", "0", "2.0K", "63", None]
    assert got[7]["p"] is got[7]["f"] is got[7]["c"] is None and got[8]["p"] == "nan"
