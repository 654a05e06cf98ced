"""Readings, scores, the store of bars, and books, on literals."""

from __future__ import annotations

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import oscillators, parsing, scores
from tidemark.operators import grading, portfolio
from tidemark.plans import strategies
from tidemark.sources import store


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(("symbol", "base", "quote"), [("EUR/USD", "EUR", "USD"), ("gbpjpy=X", "GBP", "JPY"), ("BTC-USD", "BTC", "USD"), ("AAPL", "AAPL", None), (None, None, None)])
def test_symbols(spark, symbol, base, quote):
    s = F.lit(symbol).cast("string")
    got = _one(spark, b=parsing.base_of(s), q=parsing.quote_of(s), pip=parsing.pip_size(s))
    assert (got["b"], got["q"]) == (base, quote) and got["pip"] == (0.01 if quote == "JPY" else 0.0001)


@pytest.mark.parametrize(("text", "middle", "ratio"), [("1,250.5 - 1,260.5", 1255.5, 1250.5), ("1:2.5", 1.75, 2.5), ("2.5", 2.5, 2.5), ("none", None, None), ("", None, None), (None, None, None)])
def test_price_texts(spark, text, middle, ratio):
    t = F.lit(text).cast("string")
    got = _one(spark, m=parsing.zone_middle(t), r=parsing.reward_ratio(t))
    assert got["m"] == middle and got["r"] == ratio


def test_timeframes(spark):
    got = _one(spark, **{f"a{i}": parsing.timeframe_seconds(F.lit(x)) for i, x in enumerate(("15m", "4h", "1d", "1wk", "x"))})
    assert list(got) == [900, 14400, 86400, 604800, None]


def test_scores(spark):
    kind = "struct<net_income:double,cash_flow:double,assets:double,debt:double,current_ratio:double,shares:double,gross_margin:double,turnover:double>"
    df = spark.createDataFrame([((10.0, 12.0, 100.0, 20.0, 2.0, 5.0, 0.5, 1.1), (5.0, 4.0, 100.0, 30.0, 1.5, 5.0, 0.4, 1.0)), ((-1.0, None, 100.0, 20.0, 2.0, 6.0, 0.5, 1.1), None)], f"now {kind}, before {kind}")
    assert [r[0] for r in df.select(scores.f_score("now", "before")).collect()] == [9, 0]
    one = [F.lit(1.0)] * 8
    got = _one(spark, m=scores.m_score(*one[:6], F.lit(0.0), one[7]), n=scores.m_score(*one[:7], F.lit(None).cast("double")), z=scores.z_zone(F.lit(3.0)), k=scores.kelly(F.lit(0.6), F.lit(1.0)), c=scores.crowding(F.lit(9.0), F.lit(1.0)), e=scores.crowding(F.lit(0.0), F.lit(0.0)))
    assert math.isclose(got["m"], -2.48, abs_tol=1e-9) and got["n"] is None and got["z"] == "safe" and math.isclose(got["k"], 0.2) and got["c"] == "crowded long" and got["e"] is None


def test_chart_files(spark, tmp_path):
    quote = {"open": [1.0, None], "high": [2.0, 2.0], "low": [0.5, 1.0], "close": [1.5, 1.0], "volume": [None, 7]}
    (tmp_path / "a.json").write_text(json.dumps({"chart": {"result": [{"meta": {"symbol": "A"}, "timestamp": [86400, 172800], "indicators": {"quote": [quote]}}]}}))
    (tmp_path / "b.json").write_text("{damaged")
    assert [tuple(r) for r in store.chart_json(spark, str(tmp_path)).collect()] == [("A", pd.Timestamp("1970-01-02").date(), 1.0, 2.0, 0.5, 1.5, 0)]


def test_rates(spark, tmp_path):
    (tmp_path / "r.csv").write_text("effective_date,USD,EUR\n2024-01-01,0.05,\n2024-02-01,0.04,0.03\n")
    assert sorted(r["currency"] + str(r["rate"]) for r in store.rates_csv(spark, str(tmp_path)).collect()) == ["EUR0.03", "USD0.04", "USD0.05"]


def test_store_merges_versions(spark, tmp_path):
    bars = store.BarStore(spark, f"file://{tmp_path}/s")
    assert bars.load() is None
    day = pd.Timestamp("2024-01-01").date()
    row = lambda name, c: (name, day, 1.0, 1.0, 1.0, c, 1)
    bars.merge(spark.createDataFrame([row("A", 1.0), row("B", 1.0)], store.BAR))
    bars.merge(spark.createDataFrame([row("A", 2.0), row("C", 2.0)], store.BAR))
    assert {r["instrument"]: r["c"] for r in bars.load().collect()} == {"A": 2.0, "B": 1.0, "C": 2.0}
    kept = bars.merge(spark.createDataFrame([row("A", 3.0)], store.BAR), keep="first")
    assert {r["instrument"]: r["c"] for r in kept.collect()} == {"A": 2.0, "B": 1.0, "C": 2.0}


def test_a_second_writer_merges_again(spark, tmp_path):
    bars = store.BarStore(spark, f"file://{tmp_path}/s")
    day = pd.Timestamp("2024-01-01").date()
    frame = lambda name: spark.createDataFrame([(name, day, 1.0, 1.0, 1.0, 1.0, 1)], store.BAR)
    bars.merge(frame("A"))
    other, late = store.BarStore(spark, f"file://{tmp_path}/s"), bars._taken

    def overtaken(n, name):
        bars._taken = late
        other.merge(frame("B"))
        return late(n, name)

    bars._taken = overtaken
    bars.merge(frame("C"))
    assert {r["instrument"] for r in other.load().collect()} == {"A", "B", "C"}


def test_only_fit_bars_are_saved(spark, tmp_path):
    rows = [(n, pd.Timestamp(d).date(), c, c, c, c, 1) for n, d, c in (("EUR/USD", "2024-01-05", 1.0), ("EUR/USD", "2024-01-05", 2.0), ("EUR/USD", "2024-01-06", 1.0), ("BTC/USD", "2024-01-06", 5.0))]
    df = spark.createDataFrame(rows, store.BAR)
    saved = store.BarStore(spark, f"file://{tmp_path}/s").save(df)
    assert sorted((r["instrument"], str(r["d"]), r["c"]) for r in saved.collect()) == [("BTC/USD", "2024-01-06", 5.0), ("EUR/USD", "2024-01-05", 2.0)]
    with pytest.raises(Exception, match="two bars of one day"):
        store.checked(df).collect()
    with pytest.raises(ValueError, match="missing columns"):
        store.checked(df.drop("v"))
    assert store.checked(df.limit(0)).count() == 0


def test_positions_of_several_files(spark, tmp_path):
    head = ",".join(store.POSITIONS)
    (tmp_path / "a.csv").write_text(f"{head}\n EURO FX ,2024-01-02,10,5,100\nEURO FX,bad,1,1,1\nGOLD,2024-01-02,x,5,1\n")
    (tmp_path / "b.csv").write_text(f"{head}\nEURO FX,2024-01-02,10,5,100\nGOLD,2024-01-09,7,8,.\n")
    got = store.positions_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert sorted(tuple(map(str, r)) for r in got) == [("EURO FX", "2024-01-02", "10.0", "5.0", "100.0"), ("GOLD", "2024-01-09", "7.0", "8.0", "None")]
    (tmp_path / "c.csv").write_text("market,date\n")
    with pytest.raises(ValueError, match="missing columns"):
        store.positions_csv(spark, [str(tmp_path / "c.csv")])


def test_newest_observations_and_ledgers(spark, tmp_path):
    (tmp_path / "DGS10.csv").write_text("DATE,DGS10\n2024-01-01,4.1\n2024-01-02,4.2\n2024-01-03,.\n")
    assert [tuple(map(str, r)) for r in store.newest_observation(spark, str(tmp_path / "DGS10.csv")).collect()] == [("DGS10", "2024-01-02", "4.2")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2\n{"a": null}\n')
    assert [r["a"] for r in store.ledger(spark, str(tmp_path / "l.jsonl"), "a int").collect()] == [1, None]


def test_a_replaced_set_keeps_what_only_the_old_rows_know(spark):
    old = spark.createDataFrame([("A", 1, "x"), ("B", 2, "y")], "k string, n int, note string")
    got = store.replaced(old, spark.createDataFrame([("A", 5), ("C", 6)], "k string, n int"), ["k"])
    assert sorted(map(tuple, got.collect()), key=str) == [("A", 5, "x"), ("C", 6, None)]


def test_graded_setups_on_a_few_bars(spark):
    day = lambda x: pd.Timestamp(f"2024-01-{x:02d}").date()
    bars = spark.createDataFrame([("A", day(i), h, low) for i, h, low in ((2, 11.0, 9.0), (3, 12.0, 10.0), (4, 20.0, 5.0))], "instrument string, d date, h double, l double")
    rows = [
        ("older than its series", day(1), None, None, 12.0, 1.0, "long"),
        ("both in a bar", day(3), 9.0, 11.0, 15.0, 8.0, "long"),
        ("short", day(2), None, None, 10.0, 30.0, "short"),
        ("never met", day(1), 90.0, 99.0, 100.0, 80.0, "long"),
        ("no side", day(1), None, None, 12.0, 1.0, "neutral"),
        ("nothing after", day(4), None, None, 12.0, 1.0, "long"),
    ]
    setups = spark.createDataFrame([(n, "A", d, lo, hi, 50.0, t, s, side) for n, d, lo, hi, t, s, side in rows], "id string, instrument string, d date, lo double, hi double, scan double, target double, stop double, side string")
    got = {r["id"]: (r["outcome"], r["resolved"]) for r in grading.graded(setups, bars, 10).collect()}
    assert got == {"older than its series": ("tp_hit", day(3)), "both in a bar": ("ambiguous", day(4)), "short": ("tp_hit", day(3)), "never met": (None, None), "no side": (None, None), "nothing after": (None, None)}
    assert grading.graded(setups.limit(0), bars, 10).count() == 0


def test_trend_step_passes_over_bars_without_prices():
    state, plain = {}, {}
    bars = [(10.0 + i % 5, 8.0 + i % 3, 9.0 + i % 4) for i in range(60)]
    want = [oscillators.trend_step(plain, b) for b in bars]
    assert oscillators.trend_step(state, (None, 1.0, 1.0)) == (None, None, None, None)
    assert [oscillators.trend_step(state, b) for b in bars] == want and want[28][3] is None and want[29][3] is not None
    assert oscillators.strength([0.0] * 42) == (100, 50) and oscillators.strength([]) == (None, None)


def _book(**changes):
    return portfolio.Book(**{"risk": 0.01, "slots": 1, "max_gross": 1.0, "stop": 0.1, "target": 0.1, "halt": 0.05} | changes)


def test_book_fills_at_the_next_open_and_stops_first():
    book = _book()
    assert book.day([("A", 100, 100, 100, 100, 1, 1.0), ("B", 100, 100, 100, 100, 1, 0.5)])[2] == 0
    equity, gross, n_open, *_ = book.day([("A", 100, 105, 99, 105, 0, 0), ("B", 100, 100, 100, 100, 0, 0)])
    assert n_open == 1 and math.isclose(gross, 0.1) and math.isclose(equity, 1.005)
    equity, _, n_open, closed, realised, _ = book.day([("A", 100, 120, 80, 100, 0, 0)])
    assert (n_open, closed) == (0, 1) and math.isclose(realised, -0.01) and math.isclose(equity, 0.99)


def test_book_halts():
    book = _book(risk=0.1, max_gross=1.0)
    book.day([("A", 100, 100, 100, 100, 1, 1.0)])
    assert book.day([("A", 100, 100, 91, 91, 1, 1.0)])[5] == "HALTED"
    book.day([("A", 80, 80, 80, 80, 1, 1.0)])
    assert book.day([("A", 80, 80, 80, 80, 1, 1.0)])[2] == 0


def test_books_don_t_depend_on_batches(spark, sf_dir):
    plain = strategies.t10_portfolio(spark, sf_dir).toPandas().sort_values(["book", "d"], ignore_index=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        assert plain.equals(strategies.t10_portfolio(spark, sf_dir).toPandas().sort_values(["book", "d"], ignore_index=True))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ordered_setups_carry_no_bars(spark, monkeypatch):
    """What follows a bar is joined to its day, not sorted with the setups."""
    import datetime as dt

    from tidemark.operators import grading

    handed, plain = [], grading.asof
    monkeypatch.setattr(grading, "asof", lambda left, right, *rest: handed.append(right.dtypes) or plain(left, right, *rest))
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    bars = spark.createDataFrame([("A", day(40 * i), 10.0 + i, 9.0 + i) for i in range(6)], "instrument string, d date, h double, l double")
    setups = spark.createDataFrame([(i, k, day(n) if n is not None else None, None, None, 1.0, 13.0, 8.0, "long") for i, (k, n) in enumerate([("A", -5), ("A", 0), ("A", 41), ("A", 300), ("B", 0), ("A", None)])], "id int, instrument string, d date, lo double, hi double, scan double, target double, stop double, side string")
    got = {r["id"]: (r["outcome"], r["resolved"]) for r in grading.graded(setups, bars, 2).collect()}
    assert got == {0: (None, None), 1: (None, None), 2: ("tp_hit", day(120)), 3: (None, None), 4: (None, None), 5: (None, None)}
    assert handed and not any(kind.startswith("array") for _, kind in handed[0])
