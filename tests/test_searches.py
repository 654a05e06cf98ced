"""Similar setups, entries at random and learned strategies against plain loops."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learned, nulls, similar

SETUP = "id bigint, rsi double, adx double, vol double, confluence double, px_vs_ma double, asset string, trend int, regime string, style string, split boolean, win boolean, lesson string"


def _distance(a: tuple, b: tuple) -> float:
    both = [(x, y) for x, y in zip(a[1:6], b[1:6], strict=True) if x is not None and y is not None and math.isfinite(x) and math.isfinite(y)]
    if not both or None not in (a[10], b[10]) and a[10] != b[10]:
        return math.inf
    d = math.sqrt(sum((x - y) ** 2 for x, y in both) / len(both))
    for i, p in ((6, 0.15), (8, 0.15), (9, 0.10)):
        d += p * (a[i] is not None and b[i] is not None and a[i] != b[i])
    return d + 0.15 * (a[7] != b[7])


def _setups(n: int, seed: int, spread: float = 1.0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    pick = lambda *v: v[rng.integers(0, len(v))]
    rows = []
    for i in range(n):
        centre = rng.integers(0, 4) / 4
        numbers = [None if rng.random() < 0.05 else float("nan") if rng.random() < 0.01 else float(np.clip(centre + rng.normal(0, 0.08 * spread), 0, 1)) for _ in range(5)]
        rows.append((i, *numbers, pick("Crypto", "Forex", None), pick(1, -1, None), pick("up", "down", None), pick("swing", None), pick(None, True, False), bool(rng.random() < 0.6), pick("l", " ", None, "x")))
    return rows + [(10_000 + i, *rows[3][1:11], i % 2 == 0, f"same {i}") for i in range(n)] + [(3, *rows[3][1:])]  # half of all rows one setup, and a row that repeats


def _order(d: float) -> float:
    return round(d, 12)


@pytest.mark.parametrize(("k", "radius"), [(3, 0.55), (15, 0.45), (5, 0.02)])
def test_the_nearest_setups_are_those_of_all_distances(spark, k, radius):
    rows = _setups(250, 1)
    asked = rows[::40] + [(20_000, *[None] * 5, "Forex", 1, "up", "swing", None, True, "q"), (None, *rows[0][1:])]
    data = spark.createDataFrame(rows, SETUP).repartition(4)
    got: dict = {}
    for r in similar.nearest(spark.createDataFrame(asked, SETUP), data, similar.SETUP, k, radius, ["lesson"], pivots=5, ring=0.1).collect():
        got.setdefault(r["query"], []).append((r["k"], _order(r["d"]), r["id"]))
    for q in asked:
        all_ = sorted((_order(_distance(q, r)), r[0]) for r in rows if r[0] != q[0] and _distance(q, r) <= radius) if q[0] is not None else []
        assert sorted(got.get(q[0], [])) == [(i, *x) for i, x in enumerate(all_[:k], 1)], q


def test_most_pairs_are_never_compared(spark):
    rows = _setups(1500, 2, 0.3)[:1500]
    data = spark.createDataFrame(rows, SETUP)
    asked = data.filter("id % 100 = 0")
    compared = similar.candidates(asked, data, similar.SETUP, 3, 0.55, ["lesson"]).count()
    assert compared < 0.25 * 15 * 1500, compared


def test_meta_labels_and_empty_sides(spark):
    rows = _setups(250, 3)
    data = spark.createDataFrame(rows, SETUP)
    asked = data.filter("id < 200 AND id % 20 = 0")
    got = {r["id"]: (r["p_correct"], r["n"], r["wins"], r["base"]) for r in similar.meta_label(asked, data).collect()}
    rate = np.mean([r[11] for r in rows])
    for q in rows[:200:20]:
        near = sorted((_order(_distance(q, r)), r[0], r[11]) for r in rows if r[0] != q[0] and _distance(q, r) <= 0.45)[:15]
        n, wins = len(near), sum(x[2] for x in near)
        w = n / (n + 8)
        assert got.get(q[0]) == ((math.floor((w * wins / n + (1 - w) * rate) * 100 + 0.5) if n >= 10 else None, n, wins, math.floor(rate * 100 + 0.5)) if n else None)
    assert similar.lessons(asked.limit(0), data).count() == 0 and similar.lessons(asked, data.limit(0)).count() == 0
    assert all(r["lesson"].strip() for r in similar.lessons(asked, data).collect())


# Entries at random -------------------------------------------------------------------------------


def test_random_entries_are_those_of_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = []
    for name, n in (("A", 120), ("B", 60), ("few", 40)):
        for i in range(n):
            rows.append((name, dt.date(2024, 1, 1) + dt.timedelta(days=i), int(rng.choice([1, -1])) if rng.random() < 0.3 else None, None if i >= n - 5 else round(float(rng.normal(0, 0.02)), 9)))
    rows += [("none", dt.date(2024, 1, 1) + dt.timedelta(days=i), None, 0.01) for i in range(80)]
    got = {r["instrument"]: r for r in nulls.percentiles(spark.createDataFrame(rows, "instrument string, d date, side int, ahead double").repartition(3), runs=40).collect()}
    assert set(got) == {"A", "B"}
    for name in got:
        kept = [r for r in rows if r[0] == name and r[3] is not None]
        trades = [r for r in kept if r[2] is not None]
        p, long = min(0.9, len(trades) / len(kept)), sum(r[2] > 0 for r in trades) / len(trades)
        runs = []
        for run in range(1, 41):
            total = 0.0
            for _, d, _, ahead in kept:
                h = hashlib.md5(f"null:{run}:{name}:{d}".encode()).hexdigest()
                if int(h[:8], 16) < p * 2**32:
                    total += ahead if int(h[8:16], 16) < long * 2**32 else -ahead
            runs.append(round(total, 9))
        earned = round(sum(r[2] * r[3] for r in trades), 9)
        r = got[name]
        assert r["trades"] == len(trades) and math.isclose(r["earned"], earned, abs_tol=2e-9) and math.isclose(r["median"], sorted(runs)[20], abs_tol=2e-9) and math.isclose(r["best"], max(runs), abs_tol=2e-9)
        assert r["percentile"] == math.floor(sum(e < earned for e in runs) * 100 / 40 + 0.5)


# Learned strategies ------------------------------------------------------------------------------


@pytest.mark.parametrize("model", ["gbt", "logistic"])
def test_no_row_is_scored_by_a_model_that_knows_its_label(spark, tmp_path, model):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        x, y = rng.normal(0, 1, 2)
        day = dt.date(2023, 1, 1) + dt.timedelta(days=i // 2)
        label = None if i % 50 == 0 else int(x * y > 0 if model == "gbt" else x + 0.3 * rng.normal() > 0)
        rows.append((i, day, day + dt.timedelta(days=10), label, float(x), None if i % 60 == 7 else float(y)))
    spark.createDataFrame(rows, "id int, d date, until date, label int, x double, y double").write.parquet(f"{tmp_path}/rows")
    data = spark.read.parquet(f"{tmp_path}/rows")
    run = lambda: learned.walk_forward(data, ["x", "y"], model, folds=3, keep=["id", "label"], trees=15).orderBy("id").collect()
    found = run()
    assert found == run()
    assert all(r["learnt_until"] < r["d"] - dt.timedelta(days=5) for r in found if r["p"] is not None)
    assert {r["fold"] for r in found} == {0, 1, 2} and not any(r["id"] % 60 == 7 for r in found) and len({r["id"] for r in found}) == len(found)
    late = [r for r in found if r["fold"] == 2 and r["label"] is not None]
    right = np.mean([(r["p"] > 0.5) == (r["label"] == 1) for r in late])
    assert len(late) > 80 and right > 0.8, right
    # A fold whose past is too short, of one label only, or empty, has no model.
    one = learned.walk_forward(data.withColumn("label", F.lit(1)), ["x", "y"], model, folds=2, keep=["id"])
    assert one.filter("p IS NOT NULL").count() == 0 and one.count() > 100
    assert learned.walk_forward(data.limit(0), ["x", "y"], model, keep=["id"]).count() == 0
