"""Every query of the market-analytics library against its SQL, and those without SQL against plain loops."""

from __future__ import annotations

import math
import tracemalloc
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import normalised
from tidemark.operators import alignment, bars, outcomes, validation
from tidemark.plans import registry
from tidemark.streaming import lifecycle


def _sql(sf_dir: str, sql: str) -> pd.DataFrame:
    with duckdb.connect() as con:
        for p in Path(sf_dir).glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        return con.sql(sql).df()


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert normalised(registry.QUERIES[name](spark, sf_dir).toPandas()) == normalised(_sql(sf_dir, registry.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs_alike_twice(spark, sf_dir, name):
    first = normalised(registry.QUERIES[name](spark, sf_dir).toPandas())
    assert first[1] and first == normalised(registry.QUERIES[name](spark, sf_dir).toPandas())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _series(spark, closes, highs=None, lows=None, opens=None):
    n = len(closes)
    rows = [("A", pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i), float((opens or closes)[i]), float((highs or closes)[i]), float((lows or closes)[i]), float(closes[i])) for i in range(n)]
    return spark.createDataFrame(rows, "instrument string, d date, o double, h double, l double, c double")


def test_recursive_indicators_are_those_of_pandas(spark):
    c = 100 + np.cumsum(np.random.default_rng(42).normal(0, 1, 300))
    got = outcomes.walked(_series(spark, c.tolist()), ["h", "l", "c"], "e12 double, macd double, sig double, rsi double, atr double, vol double", dict, outcomes.recursive_step).toPandas().sort_values("d")
    s = pd.Series(c)
    e12, e26 = (s.ewm(span=n, adjust=False).mean() for n in (12, 26))
    assert np.allclose(got.e12, e12) and np.allclose(got.macd, e12 - e26)
    assert np.allclose(got.sig, (e12 - e26).ewm(span=9, adjust=False).mean())
    moves = np.diff(c)
    up, down = np.maximum(moves, 0)[:14].mean(), np.maximum(-moves, 0)[:14].mean()
    want = []
    for i in range(14, 300):
        if i > 14:
            up, down = (up * 13 + max(moves[i - 1], 0)) / 14, (down * 13 + max(-moves[i - 1], 0)) / 14
        want.append(100 * up / (up + down))
    assert np.allclose(got.rsi.to_numpy()[14:].astype(float), want) and got.rsi[:14].isna().all()


def test_a_series_longer_than_a_batch_keeps_its_state(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = outcomes.walked(_series(spark, [float(i) for i in range(100)]), ["c"], "n int", dict, lambda s, r: (s.setdefault("k", []).append(1) or len(s["k"]),)).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got.n) == list(range(1, 101))


@pytest.mark.parametrize(
    ("bars_", "want"),
    [
        # Filled at the next open, both levels in one bar: the stop counts.
        (([100, 100, 100], [100, 120, 100], [100, 80, 100], [100, 100, 100], [1, 0, 0]), (-0.1, "stop")),
        # Target only.
        (([100, 100, 100], [100, 112, 100], [100, 99, 100], [100, 100, 100], [1, 0, 0]), (0.1, "target")),
        # A gap beyond the stop is filled at the open.
        (([100, 100, 70], [100, 101, 75], [100, 99, 60], [100, 100, 70], [1, 0, 0]), (-0.3, "stop")),
        # Short side.
        (([100, 100, 100], [100, 101, 100], [100, 88, 100], [100, 100, 100], [-1, 0, 0]), (0.1, "target")),
    ],
)
def test_simulator_on_a_few_bars(spark, bars_, want):
    o, h, low, c, signal = bars_
    state: dict = {}
    step = outcomes.simulator(0.1, 0.1, 0.0)
    out = [step(state, row) for row in zip(o, h, low, c, signal, strict=True)]
    (result, reason), *_ = [(r, why) for _, r, why in out if r is not None]
    assert math.isclose(result, want[0], abs_tol=1e-9) and reason == want[1]


def test_barriers_stop_first_and_too_few_bars(spark):
    df = outcomes.triple_barrier(_series(spark, [100, 100, 100, 100], highs=[100, 130, 100, 100], lows=[100, 70, 100, 100]), *[x * __import__("pyspark").sql.functions.col("c") for x in (1.2, 0.8)], 2).orderBy("d").toPandas()
    assert df.label[0] == 0 and pd.isna(df.label[1]) and pd.isna(df.label[3])


def test_fifo_with_flips(spark):
    fills = [("A", 1, 1, 10.0, 100.0), ("A", 2, -1, 15.0, 110.0), ("A", 3, 1, 5.0, 90.0), ("A", 4, 1, 1.0, 1.0), ("B", 5, 1, 1.0, 1.0)]
    got = outcomes.fifo(spark.createDataFrame(fills, "instrument string, fill_id int, side int, qty double, price double"), ["fill_id"]).toPandas().sort_values("buy_id")
    assert got[["buy_id", "sell_id", "qty", "pnl"]].values.tolist() == [[1, 2, 10.0, 100.0], [3, 2, 5.0, 100.0]]


def test_asof_ties_nulls_and_no_match(spark):
    left = spark.createDataFrame([("A", 5, 1), ("A", 1, 2), ("B", 9, 3), (None, 5, 4)], "k string, t int, x int")
    right = spark.createDataFrame([("A", 5, 1.0), ("A", 5, 2.0), ("A", 3, 0.5)], "k string, t int, v double")
    got = {r["x"]: r["v"] for r in alignment.asof(left, right, "k", "t", ["v"]).collect()}
    assert got == {1: 2.0, 2: None, 3: None, 4: None}
    assert {r["x"]: r["v"] for r in alignment.asof(left, right, "k", "t", ["v"], forward=True).collect()} == {1: 2.0, 2: 0.5, 3: None, 4: None}


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("kind", ["date", "timestamp", "double"])
def test_asof_across_stretches_equals_a_loop(spark, forward, kind):
    rng = np.random.default_rng(7)
    start = pd.Timestamp("2023-11-20")
    rows = lambda n: [(str(k), int(t), i) for i, (k, t) in enumerate(zip(rng.choice(["hot", "hot", "hot", "cold", "left only"], n), rng.integers(0, 150, n), strict=True))]
    left, right = rows(200), [r for r in rows(60) if r[0] != "left only" and not 60 < r[1] < 110]
    when = {"date": lambda t: (start + pd.Timedelta(days=t)).date(), "timestamp": lambda t: (start + pd.Timedelta(hours=7 * t)).to_pydatetime(), "double": float}[kind]
    frame = lambda of, name: spark.createDataFrame([(k, when(t), i) for k, t, i in of] + [(None, when(3), -1), ("hot", None, -2)], f"k string, t {kind}, {name} int")

    def best(k, t):
        found = [(r[1], r[2]) for r in right if r[0] == k and (r[1] >= t if forward else r[1] <= t)]
        edge = (min if forward else max)((x[0] for x in found), default=None)
        return max((i for x, i in found if x == edge), default=None)

    got = {r["x"]: r["v"] for r in alignment.asof(frame(left, "x"), frame(right, "v"), "k", "t", ["v"], forward).collect()}
    assert got == {i: best(k, t) for k, t, i in left} | {-1: None, -2: None}


def test_clean_repairs_the_envelope(spark):
    raw = spark.createDataFrame([("A", 1, 1, 10.0, 9.0, 11.0, 12.0, None), ("A", 1, 0, 1.0, 1.0, 1.0, 1.0, 1), ("A", 2, 2, -1.0, 1.0, 1.0, 1.0, 1)], "instrument string, t int, n int, o double, h double, l double, c double, v bigint")
    assert [tuple(r) for r in bars.cleaned(raw, "t", "n").collect()] == [("A", 1, 10.0, 12.0, 9.0, 12.0, 0)]


def test_overfitting_of_noise_and_of_skill(spark):
    rng = np.random.default_rng(42)
    noise = [(f"s{k}", int(b), float(r)) for k in range(8) for b in range(8) for r in rng.normal(0, 1, 20)]
    skill = [*noise, *[("good", b, float(r)) for b in range(8) for r in rng.normal(2, 1, 20)]]
    schema = "strategy string, block int, r double"
    assert validation.overfitting(spark.createDataFrame(skill, schema)).first()["pbo"] == 0.0
    assert validation.overfitting(spark.createDataFrame(noise, schema)).first()["pbo"] > 0.2


def test_bootstrap_keeps_length_and_mean(spark):
    r = spark.createDataFrame([(i, float(i % 5)) for i in range(103)], "i bigint, r double")
    got = validation.block_bootstrap(r, 200, 10).toPandas()
    assert len(got) == 200 and np.allclose(got.total, got["mean"] * 103) and abs(got["mean"].mean() - np.mean([i % 5 for i in range(103)])) < 0.05


def test_paired_bootstrap_draws_both_series_from_the_same_places(spark):
    rows = [(i, float((i * 7) % 11 - 4), 2.0 * ((i * 7) % 11 - 4)) for i in range(50)]
    got = validation.paired_bootstrap(spark.createDataFrame(rows, "i bigint, a double, b double"), 100, 6, 12).toPandas()
    assert len(got) == 100 and np.allclose(got.delta, 0) and got.sharpe_a.std() > 0


def test_drawdown_paths(spark):
    def paths(*results):
        return validation.drawdown_paths(spark.createDataFrame(list(enumerate(results)), "i bigint, r double"), 50).toPandas()

    got = paths(-0.1, -0.1, -0.1)
    assert np.allclose(got.drawdown, 1 - 0.9**3) and np.allclose(got.total, 0.9**3 - 1)
    assert np.allclose(paths(0.1, 0.2).drawdown, 0) and (paths(-1.0, -1.0).drawdown == 1).all()


@pytest.mark.parametrize("first", ["1980-03-02", "2010-01-01"])
def test_blocks_follow_the_dates(spark, sf_dir, tmp_path, first):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = (pd.Timestamp(first) - pd.Timestamp("1995-01-01")).days
    orders.withColumn("o_orderdate", F.expr(f"o_orderdate + INTERVAL {days} DAYS")).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("v4_overfitting", "v5_purged_splits"):
        query = registry.QUERIES[name]
        assert normalised(query(spark, str(tmp_path)).toPandas()) == normalised(query(spark, sf_dir).toPandas())


def test_bands_are_of_drawdowns_of_all_instruments(spark, sf_dir):
    got = registry.QUERIES["v12_drawdown_bands"](spark, sf_dir).first()
    assert 0 <= got["drawdown_p05"] <= got["drawdown_p50"] <= got["drawdown_p95"] <= got["drawdown_worst"] <= 1
    draws = registry.QUERIES["v8_bootstrap"](spark, sf_dir).toPandas()
    assert len(draws) == 500 and np.allclose(draws.delta, draws.sharpe_b - draws.sharpe_a, atol=2e-6)


def test_few_messages_of_an_order_are_held():
    rows = pd.DataFrame({"order_id": 1, "message_id": range(10000), "ts": pd.Timestamp("2020-01-01"), "rank": [i % 5 for i in range(10000)]})
    assert lifecycle.earliest(rows.sample(frac=1, random_state=1)).message_id.tolist() == [0, 1, 2, 3, 4]


def test_nearest_ties_follow_the_final_order(spark, tmp_path):
    """Distances of more than 16 vectors that differ only beyond the fifth digit: the least ids are the nearest."""
    rows = [(0, [0.0, 0.0], 0)] + [(i, [1.0 + (40 - i) * 1e-8, 0.0], 0) for i in range(1, 41)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["r12_nearest_setups"](spark, str(tmp_path)).orderBy("k").toPandas()
    assert got.vec_id.tolist() == list(range(1, 16))


def test_deflated_sharpe():
    assert validation.expected_max_sharpe(1, 1.0) == 0 and validation.expected_max_sharpe(1000, 1.0) > validation.expected_max_sharpe(10, 1.0) > 1
    assert math.isclose(validation.deflated_sharpe(0.1, 250, 0, 3, 1, 0), 0.9424, abs_tol=2e-3)
    assert validation.deflated_sharpe(0.1, 250, 0, 3, 100, 0.01) < 0.1


def _against_sql(spark, folder, name: str, **tables) -> tuple:
    """(names, rows) of a query and of its SQL over small tables."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return normalised(registry.QUERIES[name](spark, str(folder)).toPandas()), normalised(con.execute(registry.ORACLE_SQL[name]).df())


def test_breach_days_round_as_their_sql(spark, tmp_path):
    """Results of half a cent, which the product of value and hundred decides, at the limits of a day and of a fall."""
    results = [(c / 100, d, c / 100 * (d - 0.05)) for c in range(100_010, 140_000, 10) for d in (0.0, 0.01, 0.02, 0.03)]
    by_product = lambda v: math.floor(-v * 100 + 0.5)
    ties = [(price, d, by_product(v)) for price, d, v in results if int((Decimal(repr(-v)) * 100).quantize(Decimal(1), ROUND_HALF_UP)) > by_product(v)][:60]
    # The second day takes the fall to 8000 exactly, which a cent more would exceed.
    rows = [(2 * s + k, s, 1, p, d, f"1995-01-0{k + 1}") for s, (price, disc, cents) in enumerate(ties) for k, (p, d) in enumerate([(price, disc), ((800_000 - cents) / 5, 0.0)])]
    # Fills of one day in another order than that of their keys.
    rows += [(10_000 + i, 1000, 1, 25.25 + i, d, "1995-01-03") for i, d in enumerate((0.03, 0.07, 0.1))][::-1]
    li = spark.createDataFrame(rows, "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_discount double, day string").select("*", F.col("day").cast("timestamp_ntz").alias("l_shipdate")).drop("day").coalesce(1)
    got, want = _against_sql(spark, tmp_path, "a35_breach_days", lineitem=li)
    assert len(ties) > 20 and len(got[1]) == len(ties) + 1 and got == want


def test_links_are_the_nearest_prices(spark, tmp_path):
    """Ties, equal prices, the ends of the tolerance, 0, and many alike: one row a pending order, of all filled ones the nearest."""
    rng = np.random.default_rng(3)
    prices = [0.0, 100.0, 98.0, 102.0, 97.99, 1.0, 0.98, 1.02, -5.0, *np.exp(rng.uniform(0, 3, 300)).round(2), *np.round(500 + rng.integers(0, 5, 200), 2)]
    rows = [(i, ("A", "B", None)[int(rng.integers(0, 20)) // 9], "FFP"[int(rng.integers(0, 3))], float(p)) for i, p in enumerate(prices)]
    rows += [(9000, "C", "P", 100.0), (9001, "C", "F", 98.0), (9002, "D", "P", 50.0), (9003, "D", "F", 51.01), (9004, "E", "P", 0.0), (9005, "E", "F", 0.0), (9006, "G", "P", 10.0), (9008, "G", "F", 9.9), (9007, "G", "F", 10.1)]
    # A match of 2 per cent less may lie two cells of 2 per cent below.
    rows += [(9100 + 2 * k + s, f"H{k}", "PF"[s], (1, 0.9801)[s] * (np.exp(0.02 * (k + 1)) + 1e-9)) for k in range(9) for s in (0, 1)]
    orders = spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows], "o_orderkey bigint, o_orderpriority string, o_orderstatus string, o_totalprice double").repartition(3)
    got, want = _against_sql(spark, tmp_path, "j15_signature_link", orders=orders)
    assert len(got[1]) > 100 and got == want


def test_nearest_vectors_are_held_in_blocks():
    """Memory is that of a block of distances, whatever a frame has; a task gives k rows a query, the nearest of all its frames."""
    from tidemark.plans import sequences

    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (6000, 8)).astype(float)
    frames = [pd.DataFrame({"vec_id": ids, "embedding": list(x[ids]), "label": 1}) for ids in np.array_split(rng.permutation(6000), 2)]
    ids = np.arange(0, 6000, 6)
    tracemalloc.start()
    (got,) = sequences.nearest_of(frames, ids, x[ids])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and len(got) == 16 * len(ids)
    for i in ids[::50]:
        dist = np.sqrt(((x - x[i]) ** 2).sum(1)).round(5)
        dist[i] = np.inf
        assert got[got["query"] == i].vec_id.tolist() == np.lexsort((np.arange(6000), dist))[:16].tolist()
