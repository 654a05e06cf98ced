"""Fitted models and permits against brute force: likelihood grids, enumerated paths, dense matrices, plain loops."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import concentration, permits, regimes, volatility

BAR = "instrument string, d date, c double"


def _bars(spark, **closes):
    rows = [(k, (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).date(), None if v is None else float(v)) for k, c in closes.items() for i, v in enumerate(c)]
    return spark.createDataFrame(rows, BAR)


# Volatility --------------------------------------------------------------------------------------


def _garch(n: int, w: float, a: float, b: float, nu: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    v, out = w / (1 - a - b), []
    for _ in range(n):
        out.append(math.sqrt(v) * rng.standard_t(nu) * math.sqrt((nu - 2) / nu))
        v = w + a * out[-1] ** 2 + b * v
    return np.array(out)


def _likelihood(x: np.ndarray, w, a, b, nu) -> np.ndarray:
    """Mean log likelihood at many parameters at once, term by term from the density."""
    v, total = np.full(np.shape(w), 1.0), 0.0
    gamma = np.vectorize(math.lgamma)
    for y in x:
        total = total + gamma((nu + 1) / 2) - gamma(nu / 2) - 0.5 * np.log(math.pi * (nu - 2) * v) - (nu + 1) / 2 * np.log(1 + y * y / (v * (nu - 2)))
        v = w + a * y * y + b * v
    return total / len(x)


def test_garch_parameters_are_those_of_a_grid_search():
    x = _garch(500, 0.05, 0.12, 0.80, 6.0, 3) * 0.02
    scale = math.sqrt((x**2).mean())
    (found,), (ok,) = volatility.fit(x[None], np.ones((1, len(x)), bool))
    assert ok
    best, width = np.array([0.1, 0.1, 0.8, 6.0]), np.array([0.1, 0.1, 0.15, 3.0])
    for _ in range(26):
        axes = [b + s * np.linspace(-1, 1, 7) for b, s in zip(best, width, strict=True)]
        w, a, b, nu = (g.ravel() for g in np.meshgrid(*axes))
        inside = (w > 1e-6) & (a >= 0) & (b >= 0) & (a + b < volatility.MOST) & (nu > volatility.FEWEST)
        k = np.flatnonzero(inside)[_likelihood(x / scale, w[inside], a[inside], b[inside], nu[inside]).argmax()]
        moved = np.abs(np.array([w[k], a[k], b[k], nu[k]]) - best) > 0.5 * width
        best = np.array([w[k], a[k], b[k], nu[k]])
        width = np.where(moved, width, width * 0.6)
    assert abs(found[0] / scale**2 - best[0]) < 1e-3 and abs(found[1] - best[1]) < 1e-3 and abs(found[2] - best[2]) < 1e-3 and abs(found[3] - best[3]) < 1e-2


def test_garch_gradient_and_padded_windows():
    rng = np.random.default_rng(1)
    x2, used = rng.standard_t(5, (4, 60)) ** 2, np.ones((4, 60), bool)
    used[2, :20] = False
    x2 = x2 * used
    theta = rng.normal(0, 1, (4, 4))
    _, g = volatility.loss(theta, x2, used)
    for i in range(4):
        h = np.eye(4)[i] * 1e-6
        assert np.allclose((volatility.loss(theta + h, x2, used)[0] - volatility.loss(theta - h, x2, used)[0]) / 2e-6, g[:, i], atol=1e-6)
    alone = volatility.loss(theta[2:3], x2[2:3, 20:], used[2:3, 20:])
    assert np.allclose(alone[0], volatility.loss(theta, x2, used)[0][2]) and np.allclose(alone[1], g[2])


def _forecast(close: np.ndarray, window: int, least: int, every: int, horizon: int, fallback: str) -> list:
    """What garch forecasts bar by bar, one window after the other."""
    r, out, params, age = np.diff(np.log(close)), [], None, 0
    for i in range(len(close)):
        x = r[max(0, i - window) : i]
        if i % every == 0:
            params = None
            if len(x) >= least:
                (p,), (ok,) = volatility.fit(x[None], np.ones((1, len(x)), bool))
                params = p if ok else None
        if len(x) < 2:
            out.append((None, False))
        elif params is not None:
            w, a, b, _ = params
            v = w / (1 - a - b)
            for y in x:
                v = w + a * y * y + b * v
            path = [v]
            for _ in range(horizon - 1):
                path.append(w + (a + b) * path[-1])
            out.append((math.sqrt(np.mean(path)), True))
        elif fallback == "realized":
            out.append((x.std(ddof=1), False))
        else:
            v = x.var(ddof=1)
            for y in x:
                v = 0.94 * v + 0.06 * y * y
            out.append((math.sqrt(v), False))
    return out


@pytest.mark.parametrize(("horizon", "fallback"), [(1, "realized"), (5, "ewma")])
def test_garch_forecasts_across_stretches_are_those_of_a_loop(spark, monkeypatch, horizon, fallback):
    monkeypatch.setattr(volatility, "STRETCH", 70)
    a, b = 100 * np.exp(np.cumsum(_garch(400, 0.05, 0.15, 0.75, 6, 5) * 0.01)), np.full(90, 7.0)
    got = volatility.forecasts(_bars(spark, A=a, B=b, C=[1.0], E=[None, 0.0, -1.0]), "garch", window=60, least=50, every=10, horizon=horizon, fallback=fallback)
    rows = got.toPandas().sort_values(["instrument", "d"])
    assert sorted(rows.instrument.unique()) == ["A", "B", "C"] and len(rows) == 491
    for name, c in (("A", a), ("B", b), ("C", np.ones(1))):
        for g, (want, ok) in zip(rows[rows.instrument == name].itertuples(), _forecast(c, 60, 50, 10, horizon, fallback), strict=True):
            assert g.converged == ok and (pd.isna(g.per_bar) if want is None else abs(g.per_bar - want) < 1e-7), (name, g, want)
            assert g.method == ("garch(1,1)-t" if ok else f"garch->{fallback}_fallback")
    assert rows[rows.instrument == "A"].converged.sum() > 300


def test_volatility_dispatch(spark):
    with pytest.raises(ValueError):
        volatility.forecasts(_bars(spark, A=[1.0]), "nothing")
    assert volatility.forecasts(_bars(spark, A=[1.0]).limit(0), "ewma").count() == 0
    row = volatility.forecasts(_bars(spark, A=[1.0, 2.0, 4.0, 2.0]), "realized").orderBy(F.desc("d")).first()
    assert row["method"] == "realized_21" and math.isclose(row["per_bar"], np.std([math.log(2), math.log(2), -math.log(2)], ddof=1)) and row["horizon"] == 1


# Hidden regimes ----------------------------------------------------------------------------------


def _states(k: int, p: int, seed: int) -> regimes.States:
    rng = np.random.default_rng(seed)
    move = rng.dirichlet(np.ones(k), k)
    root = rng.normal(0, 0.3, (k, p, p)) + np.eye(p)
    return regimes.States(rng.dirichlet(np.ones(k)), move, rng.normal(0, 1, (k, p)), root @ root.transpose(0, 2, 1))


def test_posteriors_are_those_of_all_paths():
    states = _states(3, 2, 4)
    x = np.random.default_rng(5).normal(0, 1, (8, 2))
    density = np.exp(states.log_density(x))
    for k in range(3):
        d = x - states.mean[k]
        want = np.exp(-0.5 * np.einsum("ti,ij,tj->t", d, np.linalg.inv(states.cov[k]), d)) / (2 * math.pi * math.sqrt(np.linalg.det(states.cov[k])))
        assert np.allclose(density[:, k], want)
    total, post, moves, best = 0.0, np.zeros((8, 3)), np.zeros((3, 3)), (0.0, None)
    for path in itertools.product(range(3), repeat=8):
        p = states.start[path[0]] * math.prod(density[t, s] for t, s in enumerate(path)) * math.prod(states.move[a, b] for a, b in itertools.pairwise(path))
        total += p
        for t, s in enumerate(path):
            post[t, s] += p
        for a, b in itertools.pairwise(path):
            moves[a, b] += p
        best = max(best, (p, path), key=lambda v: v[0])
    log, forward, smooth, found = states.passes(x)
    assert math.isclose(log, math.log(total)) and np.allclose(smooth, post / total) and np.allclose(found, moves / total)
    assert tuple(states.best_path(x)) == best[1] and np.allclose(forward[-1], smooth[-1])


def _sequences(spark, n: int, length: int):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        state, xs = 0, []
        for _ in range(length):
            state = state if rng.random() < 0.95 else 1 - state
            xs.append([float(v) for v in rng.normal([(-1.0, 0.3), (1.0, 1.5)][state], [0.4, 0.2])])
        rows.append(("m", i, xs))
    rows += [("few", 0, [[0.1, 0.2]] * 5), ("none", 0, [])]
    return spark.createDataFrame(rows, "model string, sequence int, xs array<array<double>>").repartition(3)


def test_likelihood_never_falls_and_states_are_found(spark):
    found = regimes.learnt(_sequences(spark, 6, 120), states=2, rounds=12, tolerance=0.0, least=50)
    assert set(found) == {"m"}
    model = found["m"]
    assert len(model.likelihood) > 3 and all(b >= a - 1e-7 for a, b in itertools.pairwise(model.likelihood))
    mean = model.states.mean * model.spread + model.middle
    assert np.allclose(mean, [(-1.0, 0.3), (1.0, 1.5)], atol=0.15) and model.states.mean[0, 0] < model.states.mean[1, 0] and np.allclose(np.diag(model.states.move), 0.95, atol=0.03)
    rows = regimes.decoded(_sequences(spark, 6, 120), found).toPandas()
    assert len(rows) == 725 and rows[rows.model == "few"].state.isna().all() and rows[rows.model == "m"].confidence.between(0, 1).all()


def test_regimes_of_bars(spark):
    rng = np.random.default_rng(7)
    moves = np.concatenate([rng.normal(0.02, 0.004, 150), rng.normal(-0.03, 0.05, 150)])
    bars = _bars(spark, A=100 * np.exp(np.cumsum(moves)), B=np.linspace(1, 2, 40), C=[None, 1.0])
    rule = bars.select("instrument", "d", F.lit("up").alias("trend"), F.lit("low").alias("vol"), F.lit(0.5).alias("confidence"))
    got = regimes.hidden_regimes(bars, rule, states=2, rounds=15, least=100).toPandas().sort_values(["instrument", "d"])
    a = got[got.instrument == "A"]
    assert set(a.method) == {"hmm"} and list(a[["trend", "vol"]].iloc[20]) == ["up", "low"] and list(a[["trend", "vol"]].iloc[-1]) == ["down", "high"]
    b = got[got.instrument == "B"]
    assert len(b) == 19 and set(b.method) == {"hmm->rule_fallback"} and set(b.confidence) == {0.4} and not (got.instrument == "C").any()
    assert regimes.hidden_regimes(bars.limit(0), rule).count() == 0


# Concentration -----------------------------------------------------------------------------------


def _returns(spark, n: int, days: int, seed: int):
    rng = np.random.default_rng(seed)
    common = rng.normal(0, 1, (3, days))
    wide = np.stack([common[i % 3] * 0.8 + rng.normal(0, 1, days) for i in range(n)]) * (rng.random((n, days)) < 0.8)
    rows = [(f"s{i:02d}", int(j), float(wide[i, j])) for i in range(n) for j in range(days) if wide[i, j]]
    more = [("few", 1, 1.0), ("few", 2, 2.0), ("flat", 1, 0.0), ("flat", 2, 0.0), ("flat", 3, None), (None, 1, 5.0), (None, 2, 1.0), (None, 3, 1.0)]
    return spark.createDataFrame(rows + more, "instrument string, d int, r double"), wide


def test_components_and_clusters_are_those_of_the_filled_matrix(spark):
    streams, wide = _returns(spark, 12, 80, 8)
    matrix = concentration.matrix(streams)
    c = np.corrcoef(wide)
    got = {(r["a"], r["b"]): r["corr"] for r in matrix.collect()}
    assert len(got) == 78 and all(abs(got[f"s{i:02d}", f"s{j:02d}"] - c[i, j]) < 1e-9 for i in range(12) for j in range(i, 12))
    z = (wide - wide.mean(axis=1, keepdims=True)) / wide.std(axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(z.T, full_matrices=False)
    rows = concentration.components(matrix).toPandas()
    for k in (1, 2, 3):
        part = rows[rows.component == k].sort_values("instrument")
        want = vt[k - 1] * (1 if vt[k - 1].sum() >= 0 else -1)
        assert np.allclose(part.loading, want, atol=1e-8) and np.allclose(part.share, s[k - 1] ** 2 / (s**2).sum())
    found = {r["instrument"]: (r["cluster"], r["size"]) for r in concentration.clusters(matrix, 0.2).collect()}
    groups = _linkage(1 - np.abs(c), 0.8)
    assert len(groups) > 1 and found == {f"s{i:02d}": (f"s{g[0]:02d}", len(g)) for g in groups for i in g}


def _linkage(dist: np.ndarray, cut: float) -> list[list[int]]:
    groups = [[i] for i in range(len(dist))]
    while len(groups) > 1:
        far = {(a, b): max(dist[i, j] for i in groups[a] for j in groups[b]) for a in range(len(groups)) for b in range(a + 1, len(groups))}
        (a, b), d = min(far.items(), key=lambda x: (x[1], x[0]))
        if d > cut:
            break
        groups[a] = groups[a] + groups.pop(b)
    return [sorted(g) for g in groups]


@pytest.mark.parametrize("seed", range(6))
def test_complete_linkage_with_ties(seed):
    rng = np.random.default_rng(seed)
    d = rng.integers(1, 5, (9, 9)) / 4.0
    d = np.minimum(d, d.T)
    got = concentration.linked(d, 0.75)
    assert sorted(tuple(np.flatnonzero(got == g)) for g in set(got)) == sorted(tuple(g) for g in _linkage(d, 0.75))


def test_concentration_of_one_stream_and_none(spark):
    one = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "instrument string, d int, r double")
    matrix = concentration.matrix(one)
    assert [tuple(r) for r in concentration.components(matrix).collect()] == [(1, 1.0, "a", 1.0)] and [tuple(r) for r in concentration.clusters(matrix).collect()] == [("a", "a", 1)]
    none = concentration.matrix(one.limit(0))
    assert not concentration.components(none).count() and not concentration.clusters(none).count()


# Permits -----------------------------------------------------------------------------------------

CANDIDATE = "at int, id bigint, score double, instrument string, side int, sleeve string, bucket string, price double, stop double, rate double, ann_vol double, p double, payoff double, news boolean, regime double, tail double, corr map<string,double>"
ACCOUNT = f"at int, equity double, drawdown double, daily_loss double, scalar double, positions {permits.POSITION}"


def _permit(c: dict, account: dict | None, held: list[dict], x: permits.Limits) -> tuple[str | None, float, str]:
    """The permit of one candidate, check by check."""
    one = lambda v, other: other if v is None else v
    if account is None:
        return "no_account", 0.0, ""
    equity, caps = account["equity"], []
    if not c["side"]:
        return "flat_signal", 0.0, ""
    if x.daily_loss and account["daily_loss"] >= x.daily_loss:
        return "daily_loss_stop", 0.0, ""
    if account["drawdown"] >= x.breaker:
        return "drawdown_breaker", 0.0, ""
    if c["news"]:
        return "news_veto", 0.0, ""
    sleeve, bucket = one(c["sleeve"], ""), one(c["bucket"], "swing")
    if sleeve in x.sleeves:
        if sum(h["sleeve"] == sleeve for h in held) >= x.sleeves[sleeve]:
            return "sleeve_full", 0.0, ""
    elif sum(h["sleeve"] == "" and h["bucket"] == bucket for h in held) >= x.buckets.get(bucket, x.other_bucket):
        return "bucket_full", 0.0, ""
    if len(held) >= x.slots:
        return "all_slots_full", 0.0, ""
    rate = one(c["rate"], 1.0)
    if c["price"] is None or c["stop"] is None or c["price"] * rate <= 0 or abs(c["stop"]) * rate <= 0:
        return "invalid_stop", 0.0, ""
    price, stop = c["price"] * rate, abs(c["stop"]) * rate
    kelly = x.kelly * (c["p"] - (1 - c["p"]) / c["payoff"]) if x.kelly else x.risk_of_trade
    if kelly <= 0:
        return "no_edge", 0.0, ""
    risk = kelly
    if risk > x.risk_of_trade:
        risk = x.risk_of_trade
        caps.append("risk_of_trade")
    if account["drawdown"] >= x.reducing:
        risk *= (x.breaker - account["drawdown"]) / (x.breaker - x.reducing)
    for name, by in (("vol_scalar_zero", one(account["scalar"], 1.0)), ("regime_zero", one(c["regime"], 1.0))):
        if by <= 0:
            return name, 0.0, ""
        risk *= by
    room = x.book_risk - sum(h["risk"] for h in held) / equity
    if room <= 0:
        return "book_risk_full", 0.0, ""
    if risk > room:
        risk = room
        caps.append("book_risk")
    tail = min(max(one(c["tail"], 1.0), x.tail[0]), x.tail[1])
    notional = equity * risk / (stop * tail) * price
    near = sum(h["notional"] for h in held if h["instrument"] == c["instrument"] or abs((c["corr"] or {}).get(h["instrument"], 0.0)) >= x.correlation)
    at_vol = equity * x.vol_target / (c["ann_vol"] * tail) if c["ann_vol"] and c["ann_vol"] > 0 else 0.0
    for name, cap in (("vol_target", at_vol), ("gross_exposure", max(0.0, x.gross * equity - sum(h["notional"] for h in held))), ("correlated_exposure", max(0.0, x.correlated * equity - near)), ("position_size", x.position * equity if x.position else math.inf)):
        if cap < notional:
            notional = cap
            caps.append(name)
    if notional <= x.least:
        return "below_least", 0.0, ""
    held.append({"instrument": c["instrument"], "sleeve": sleeve, "bucket": bucket, "notional": notional, "risk": notional / price * stop})
    return None, notional, ",".join(caps)


@pytest.mark.parametrize("limits", [permits.Limits(), permits.Limits(kelly=0.25, book_risk=0.02, gross=0.6, correlated=0.3, daily_loss=0.03, slots=5, position=0.2, least=100.0, buckets={"swing": 2, "intraday": 1, "scalp": 1}, other_bucket=1, sleeves={"trend": 2})])
def test_permits_are_those_of_a_loop(spark, limits):
    rng = np.random.default_rng(9)
    pick = lambda *v: v[rng.integers(0, len(v))]
    names, accounts, rows, want = list("ABCDE"), [], [], {}
    for at in range(60):
        held = [{"instrument": str(pick(*names)), "sleeve": pick("", "trend", None), "bucket": pick("swing", "intraday", None), "notional": 9000.0, "risk": float(pick(0.0, 300.0, 1200.0))} for _ in range(rng.integers(0, 4))]
        account = {"equity": 100000.0, "drawdown": float(pick(0.0, 0.0, 0.12, 0.199, 0.2)), "daily_loss": float(pick(0.0, 0.0, 0.04)), "scalar": pick(None, 1.0, 0.5, 0.0), "positions": held or None}
        if at != 7:
            accounts.append((at, *[account[k] for k in ("equity", "drawdown", "daily_loss", "scalar", "positions")]))
        cs = []
        for i in range(rng.integers(1, 14)):
            cs.append({"at": at, "id": at * 100 + i, "score": pick(None, 1.0, 2.0, 3.0), "instrument": pick(*names), "side": int(pick(1, 1, -1, -1, 0)), "sleeve": pick(None, "", "trend", "other"), "bucket": pick(None, "swing", "intraday", "scalp", "odd"), "price": pick(10.0, 20.0, 50.0, None), "stop": pick(1.0, -2.0, 5.0, 0.0), "rate": pick(None, 1.0, 1.3), "ann_vol": pick(0.1, 0.4, 0.0, None), "p": float(rng.uniform(0.3, 0.7)), "payoff": 1.5, "news": pick(None, False, False, True), "regime": pick(None, 1.0, 0.5, 0.0), "tail": pick(None, 0.5, 1.4, 9.0), "corr": pick(None, {"A": 0.7, "B": -0.9}, {"C": 0.59})})
        rows += cs
        open_ = [h | {"sleeve": h["sleeve"] or "", "bucket": h["bucket"] or "swing"} for h in held]
        for c in sorted(cs, key=lambda c: (math.inf if c["score"] is None else -c["score"], c["id"])):
            want[c["id"]] = _permit(c, None if at == 7 else account, open_, limits)
    found = permits.permits(spark.createDataFrame([tuple(r.values()) for r in rows], CANDIDATE).repartition(3), spark.createDataFrame(accounts, ACCOUNT), limits).collect()
    assert len(found) == len(rows)
    for r in found:
        reason, notional, caps = want[r["id"]]
        assert r["reason"] == reason and r["permitted"] == (reason is None) and abs(r["notional"] - notional) < 1e-6 and r["caps"] == caps, (r, want[r["id"]])
    assert len({v[0] for v in want.values()}) > 8
    assert permits.permits(spark.createDataFrame([], CANDIDATE), spark.createDataFrame(accounts, ACCOUNT), limits).count() == 0


def test_candidates_don_t_carry_the_positions_of_their_moment(spark):
    """Thousands of candidates and positions of one moment: each is judged, by a fold that keeps what it permits alone."""
    n, limits = 3000, permits.Limits(slots=3005, buckets={"swing": 4000}, gross=1e9, correlated=1e9, book_risk=1e9)
    held = [{"instrument": "AB"[i % 2], "sleeve": None, "bucket": "swing", "notional": 1.0, "risk": 1.0} for i in range(n)]
    rows = [(1, i, float(n - i), "A", 1, None, "swing", 10.0, 1.0, None, 1e-9, 0.5, 1.5, False, None, None, None) for i in range(n)]
    got = permits.permits(spark.createDataFrame(rows, CANDIDATE), spark.createDataFrame([(1, 1e5, 0.0, 0.0, None, held)], ACCOUNT), limits)
    assert [r["id"] for r in got.filter("permitted").orderBy("id").collect()] == [0, 1, 2, 3, 4] and got.filter("reason = 'all_slots_full'").count() == n - 5
    # The grouped rows hold no array of positions.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "positions" not in next(line for line in plan.splitlines() if "collect_list" in line)


def test_streams_in_blocks_make_the_same_matrix(spark, monkeypatch):
    """Many streams of few days, copies among them: blocks give the filled matrix, products of days its components, and copies join first; no products by day are shuffled."""
    rng = np.random.default_rng(2)
    wide = rng.normal(0, 1, (560, 14)) + np.outer(rng.normal(0, 1, 560), rng.normal(0, 1, 14)) * 0.7
    wide[300:] = wide[:260]
    rows = [(i, j, float(wide[i, j])) for i in range(560) for j in range(14)]
    streams = spark.createDataFrame(rows, "instrument bigint, d int, r double")
    monkeypatch.setattr(concentration, "OUT_ROWS", 500)
    matrix = concentration.matrix(streams)
    got, c = matrix.toPandas(), np.corrcoef(wide)
    assert len(got) == 560 * 561 // 2 == len(got.drop_duplicates(["a", "b"])) and (got.a <= got.b).all() and np.allclose(got["corr"], c[got.a, got.b], atol=1e-12)
    assert "sum((_a" not in matrix._jdf.queryExecution().optimizedPlan().toString() and "* _b" not in matrix._jdf.queryExecution().optimizedPlan().toString()
    values, vectors = np.linalg.eigh(c)
    monkeypatch.setattr(concentration, "MOST", 300)  # fewer than there are streams
    rows = concentration.components_of(streams).toPandas()
    for k in (1, 2, 3):
        part, want = rows[rows.component == k].sort_values("instrument"), vectors[:, -k] * (1 if vectors[:, -k].sum() >= 0 else -1)
        assert len(part) == 560 and np.allclose(part.loading, want, atol=1e-7) and np.allclose(part.share, values[-k] / 560)
    found = concentration.clusters_of(streams, 0.6).toPandas().set_index("instrument")
    groups = [np.flatnonzero(concentration.linked(1 - np.abs(c[:300, :300]), 0.4) == i) for i in range(300)]
    want = {i: (g[0], len(g) + sum(g < 260)) for g in groups if len(g) for i in [*g, *(g[g < 260] + 300)]}
    assert {i: tuple(r) for i, r in zip(found.index, found[["cluster", "size"]].to_numpy(), strict=True)} == want


@pytest.mark.parametrize("seed", range(6))
def test_nearest_pairs_join_as_all_do(seed):
    """Pairs alone, those within the cut, give complete linkage with its ties."""
    rng = np.random.default_rng(seed)
    d = rng.integers(1, 7, (40, 40)) / 8.0
    d = np.minimum(d, d.T)
    a, b = np.nonzero(np.triu(d <= 0.625, 1))
    of = np.arange(40)
    old, new = concentration.joins(a, b, d[a, b])
    of[old] = new
    assert len(old) > 10 and list(of) == list(concentration.linked(d, 0.625))


@pytest.mark.parametrize("nearest", [1500, 1 << 22])
def test_clusters_of_more_streams_than_a_matrix_may_have(spark, monkeypatch, nearest):
    """Different streams beyond MOST, clusters larger than a block's share among them: those of the whole matrix, however few pairs a task may join at a time."""
    rng = np.random.default_rng(5)
    wide = rng.normal(0, 1, (600, 12))
    wide[:150] = rng.normal(0, 1, 12) + 0.15 * wide[:150]
    wide[150:200] = wide[150:200].round()  # ties
    names = [f"s{i:03d}" for i in rng.permutation(600)]
    streams = spark.createDataFrame([(names[i], j, float(wide[i, j])) for i in range(600) for j in range(12)], "instrument string, d int, r double")
    rounds, dealt = [], concentration._dealt
    monkeypatch.setattr(concentration, "MOST", 300)
    monkeypatch.setattr(concentration, "NEAREST", nearest)
    monkeypatch.setattr(concentration, "_dealt", lambda *x: rounds.append(x) or dealt(*x))
    found = {r["instrument"]: (r["cluster"], r["size"]) for r in concentration.clusters_of(streams, 0.7).collect()}
    order = np.argsort(names)
    of = concentration.linked(np.round(1 - np.abs(np.corrcoef(wide[order])), 12), 0.3)
    size, named = np.bincount(of), [names[i] for i in order]
    assert size.max() > 100 and len(size[size > 0]) > 50
    assert found == {named[i]: (named[g], size[g]) for i, g in enumerate(of)}
    assert (len(rounds) == 1) == (nearest == 1 << 22)


def test_matrix_is_dealt_out_evenly_and_rounded_where_it_is_made(spark):
    """A result with a row for every two streams: tasks have like shares of it, and digits cost no further expression a row."""
    rng = np.random.default_rng(3)
    wide = rng.normal(0, 1, (600, 9))
    streams = spark.createDataFrame([(i, j, float(wide[i, j])) for i in range(600) for j in range(9)], "instrument bigint, d int, r double")
    matrix = concentration.matrix(streams, digits=6)
    got, c = matrix.withColumn("task", F.spark_partition_id()).toPandas(), np.corrcoef(wide)
    assert len(got) == 600 * 601 // 2 == len(got.drop_duplicates(["a", "b"])) and np.allclose(got["corr"], c[got.a, got.b], atol=5.0001e-7, rtol=0)
    assert (got["corr"] == got["corr"].round(6)).all() and not np.signbit(got.loc[got["corr"] == 0, "corr"]).any() and (got.loc[got.a == got.b, "corr"] == 1).all()
    shares = got.groupby("task").size()
    assert len(shares) >= 30 and shares.max() < 3 * shares.mean()
    assert "round(" not in matrix._jdf.queryExecution().optimizedPlan().toString()
