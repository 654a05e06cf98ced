"""Volatility forecasts of bars: equal weights, exponential weights, and GARCH(1,1) with Student errors by maximum likelihood.

Bars are numbered per instrument, by months that hand on their counts, and cut into stretches that overlap by what a forecast looks back on. A stretch is a row, so
one long series is worked on by many tasks, and all windows of a stretch are computed at once: the recursion runs over the bars of the window,
each step for all windows.

* GARCH: v_t = w + a x_{t-1}^2 + b v_{t-1}, fitted on each ``every``-th bar to its last ``window`` log returns; the bars up to the next fit carry the parameters forward and run the
  recursion from w / (1 - a - b) over their own window. Fits are made in units of the window's root mean square, in which the likelihood's variance begins at 1.
* A window shorter than ``least`` or a fit that doesn't converge falls back to exponential weights (``fallback="ewma"``) or equal ones ("realized") until the next fit, and says so.
* Exponential weights begin with the sample variance of the window.

Defined results: bars whose close isn't positive are left out; of bars of one instrument and day any order gives the same rows only if their closes agree, so ``d`` should be unique; a bar with fewer than two
returns has null forecasts and converged false; a window whose returns are all 0 has forecast 0 by weights and never a fit. An empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANNUAL = 252
DECAY = 0.94
#: Bars of a stretch, about, and most iterations of a fit.
STRETCH, STEPS = 1024, 200
#: Bounds of the parameters: persistence below MOST, degrees of freedom above FEWEST; of the unbounded ones that the search moves, so that none runs off where the likelihood is flat.
MOST, FEWEST = 0.9999, 2.05
LOW, HIGH = np.array([-9.0, -9.0, -6.0, -6.0]), np.array([9.0, 9.0, 6.0, 6.2])

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def numbered(bars: DataFrame, key: str = "instrument", time: str = "d") -> DataFrame:
    """bars with _i, their number in the time order of their key from 0; no task has more than a month of a key."""
    month = F.trunc(time, "month")
    counts = bars.groupBy(key, month.alias("_month")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_month", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(key, "_month").orderBy(time)) - 1
    return bars.withColumn("_month", month).join(starts, [key, "_month"]).withColumn("_i", F.col("_start") + inside).drop("_month", "_start")


def stretches(bars: DataFrame, back: int, step: int) -> DataFrame:
    """(instrument, first, bars): arrays of bars (_i, d, c) of each stretch of step bars and the back bars before it; first: the number of the first that isn't of those before."""
    last, own = F.floor(F.col("_i") / step), F.greatest(F.floor((F.col("_i") - back) / step), F.lit(0))
    placed = numbered(bars).select("instrument", F.explode(F.sequence(own, last)).alias("_s"), F.struct("_i", "d", "c").alias("_bar"))
    found = placed.groupBy("instrument", "_s").agg(F.array_sort(F.collect_list("_bar")).alias("bars"))
    # Stretch 0 also has the first back bars, which no stretch has as its own; one that has only bars before it has no row.
    first = F.when(F.col("_s") == 0, F.lit(0)).otherwise(F.col("_s") * step + back)
    return found.select("instrument", first.cast("bigint").alias("first"), "bars").filter(F.get("bars", F.size("bars") - 1)["_i"] >= F.col("first"))


# The fit -----------------------------------------------------------------------------------------


def _natural(theta: np.ndarray) -> tuple[np.ndarray, ...]:
    """w, a, b, nu and what the chain rule needs, of unbounded parameters: persistence, a's share of it, log of the long-run variance, log of nu above its bound."""
    s, share = 1 / (1 + np.exp(-theta[:, 0])), 1 / (1 + np.exp(-theta[:, 1]))
    stays, level, free = MOST * s, np.exp(theta[:, 2]), np.exp(theta[:, 3])
    return level * (1 - stays), stays * share, stays * (1 - share), FEWEST + free, s, share, stays, level, free


def _constant(nu: np.ndarray) -> np.ndarray:
    return _lgamma((nu + 1) / 2) - _lgamma(nu / 2) - 0.5 * np.log(math.pi * (nu - 2))


def loss(theta: np.ndarray, x2: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean negative log likelihood of each window (rows of squared returns, of which used count) and its gradient."""
    w, a, b, nu, s, share, stays, level, free = _natural(theta)
    n = used.sum(axis=1)
    v, dw, da, db = np.ones(len(w)), np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(w))
    total, gw, ga, gb, gn = (np.zeros(len(w)) for _ in range(5))
    for t in range(x2.shape[1]):
        on, x = used[:, t], x2[:, t]
        tail = x / (v * (nu - 2))
        logs = np.log1p(tail)
        total += np.where(on, -0.5 * np.log(v) - (nu + 1) / 2 * logs, 0.0)
        by_v = np.where(on, -0.5 / v + (nu + 1) / 2 * tail / (1 + tail) / v, 0.0)
        gw, ga, gb = gw + by_v * dw, ga + by_v * da, gb + by_v * db
        gn += np.where(on, -0.5 * logs + (nu + 1) / 2 * tail / (1 + tail) / (nu - 2), 0.0)
        dw, da, db, v = np.where(on, 1 + b * dw, dw), np.where(on, x + b * da, da), np.where(on, v + b * db, db), np.where(on, w + a * x + b * v, v)
    h = 1e-5 * nu
    gn = gn + n * (_constant(nu + h) - _constant(nu - h)) / (2 * h)
    d_stays = -level * gw + share * ga + (1 - share) * gb
    out = np.stack([d_stays * MOST * s * (1 - s), stays * share * (1 - share) * (ga - gb), level * (1 - stays) * gw, free * gn], axis=1)
    return -(total / n + _constant(nu)), -out / n[:, None]


def fit(windows: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(w, a, b, nu) of each window of returns and whether the search converged: quasi-Newton steps with backtracking, for all windows at once."""
    count = used.sum(axis=1)
    scale = np.sqrt((windows**2 * used).sum(axis=1) / np.maximum(count, 1))
    good = (scale > 0) & (count > 1)
    out, converged = np.full((len(windows), 4), np.nan), np.zeros(len(windows), bool)
    at = np.flatnonzero(good)
    if not len(at):
        return out, converged
    x2, used = (windows[at] / scale[at, None]) ** 2 * used[at], used[at]
    theta = np.tile([math.log(0.95 / 0.05), math.log(0.08 / 0.92), 0.0, math.log(6.0)], (len(at), 1))
    f, g = loss(theta, x2, used)
    inverse, flat = np.tile(np.eye(4), (len(at), 1, 1)), np.zeros(len(at), np.int64)
    live, done = np.arange(len(at)), np.zeros(len(at), bool)
    for _ in range(STEPS):
        # A parameter at its bound that the likelihood pulls beyond it stays there.
        free = ~((theta[live] <= LOW) & (g[live] > 0)) & ~((theta[live] >= HIGH) & (g[live] < 0))
        pull = g[live] * free
        done[live] = (np.abs(pull).max(axis=1) < 1e-6) | (flat[live] >= 3)
        keep = ~done[live]
        live, free, pull = live[keep], free[keep], pull[keep]
        if not len(live):
            break
        step = -np.einsum("bij,bj->bi", inverse[live], pull) * free
        slope = (step * pull).sum(axis=1)
        bad = ~(slope < 0)
        step[bad], inverse[live[bad]] = -pull[bad], np.eye(4)
        slope[bad] = -(pull[bad] ** 2).sum(axis=1)
        length = np.minimum(1.0, 2.0 / np.maximum(np.abs(step).max(axis=1), 1e-300))
        new, new_f, new_g, open_ = theta[live].copy(), f[live].copy(), g[live].copy(), np.arange(len(live))
        for _ in range(12):
            tried = np.clip(theta[live[open_]] + length[open_, None] * step[open_], LOW, HIGH)
            tf, tg = loss(tried, x2[live[open_]], used[live[open_]])
            ok = tf <= f[live[open_]] + 1e-4 * length[open_] * slope[open_]
            new[open_[ok]], new_f[open_[ok]], new_g[open_[ok]] = tried[ok], tf[ok], tg[ok]
            open_ = open_[~ok]
            if not len(open_):
                break
            length[open_] /= 4
        inverse[live[open_]] = np.eye(4)  # no step helped: the next one goes straight down
        # Three rounds that gain next to nothing end a search, as the likelihood is flat there.
        flat[live] = np.where(f[live] - new_f < 1e-9, flat[live] + 1, 0)
        moved, y = new - theta[live], new_g - g[live]
        sy = (moved * y).sum(axis=1)
        bent = np.flatnonzero(sy > 1e-14)
        if len(bent):
            left = np.eye(4) - moved[bent, :, None] * y[bent, None, :] / sy[bent, None, None]
            inverse[live[bent]] = left @ inverse[live[bent]] @ left.transpose(0, 2, 1) + moved[bent, :, None] * moved[bent, None, :] / sy[bent, None, None]
        theta[live], f[live], g[live] = new, new_f, new_g
    w, a, b, nu, *_ = _natural(theta)
    out[at] = np.stack([w * scale[at] ** 2, a, b, nu], axis=1)
    converged[at] = done & np.isfinite(out[at]).all(axis=1)
    return out, converged


# Forecasts ---------------------------------------------------------------------------------------


def _windows(r: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The last n returns before each end, the missing ones 0, and which there are."""
    at = ends[:, None] - n + np.arange(n)[None]
    used = at >= 0
    return np.where(used, r[np.maximum(at, 0)] if len(r) else 0.0, 0.0), used


def weighted(x: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Variance by exponential weights, begun with the sample variance."""
    n = used.sum(axis=1)
    mean = x.sum(axis=1) / n
    v = (((x - mean[:, None]) ** 2) * used).sum(axis=1) / (n - 1)
    for t in range(x.shape[1]):
        v = np.where(used[:, t], DECAY * v + (1 - DECAY) * x[:, t] ** 2, v)
    return v


def sample_variance(x: np.ndarray, used: np.ndarray) -> np.ndarray:
    n = used.sum(axis=1)
    mean = x.sum(axis=1) / n
    return (((x - mean[:, None]) ** 2) * used).sum(axis=1) / (n - 1)


def carried(x: np.ndarray, used: np.ndarray, params: np.ndarray, horizon: int) -> np.ndarray:
    """Mean variance of the next bars, from fixed parameters run over each window."""
    w, a, b = params[:, 0], params[:, 1], params[:, 2]
    stays = a + b
    v = w / (1 - stays)
    for t in range(x.shape[1]):
        v = np.where(used[:, t], w + a * x[:, t] ** 2 + b * v, v)
    total, ahead = v.copy(), v
    for _ in range(horizon - 1):
        ahead = w + stays * ahead
        total = total + ahead
    return total / horizon


def forecasts(bars: DataFrame, method: str = "ewma", window: int = 503, least: int = 250, every: int = 21, horizon: int = 5, fallback: str = "ewma", short: int = 21) -> DataFrame:
    """instrument, d, per_bar, annualized, horizon, method, converged of each bar of bars (instrument, d, c), known at that bar; GARCH also w, a, b, nu and age (bars since the fit).

    window, least: returns that a forecast looks back on, and that GARCH needs; short: those of equal weights."""
    if method not in ("ewma", "realized", "garch"):
        raise ValueError(f"unknown volatility method: {method}")
    back = window + every if method == "garch" else max(window, short)
    step = every * -(-max(STRETCH, back) // every)
    name = {"garch": "garch(1,1)-t", "ewma": "ewma", "realized": f"realized_{short}"}[method]
    second = {"ewma": "garch->ewma_fallback", "realized": "garch->realized_fallback"}[fallback]
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema.fields}

    def of(close: np.ndarray, number: np.ndarray, first: int) -> dict[str, np.ndarray]:
        r, own = np.diff(np.log(close)), number >= first
        ends = np.flatnonzero(own)  # bar k ends the returns before k in r
        x, used = _windows(r, ends, short if method == "realized" else window)
        with np.errstate(invalid="ignore", divide="ignore"):
            var = sample_variance(x, used) if method == "realized" else weighted(x, used)
        params, ok, age = np.full((len(ends), 4), np.nan), used.sum(axis=1) > 1, np.zeros(len(ends), np.int64)
        if method == "garch":
            if fallback == "realized":
                with np.errstate(invalid="ignore", divide="ignore"):
                    var = sample_variance(x, used)
            # Fits stand where the number of the bar is a multiple of every; the first that a bar may use is its own stretch's or lies in the bars before it.
            fits = ends - number[ends] % every
            some, slot = np.unique(fits[fits >= 0], return_inverse=True)
            fx, fused = _windows(r, some, window)
            enough = fused.sum(axis=1) >= least
            found, good = np.full((len(some), 4), np.nan), np.zeros(len(some), bool)
            if enough.any():
                found[enough], good[enough] = fit(fx[enough], fused[enough])
            here = fits >= 0
            params[here], age, ok = found[slot], number[ends] % every, np.zeros(len(ends), bool)
            ok[here] = good[slot]
            if ok.any():
                var[ok] = carried(x[ok], used[ok], params[ok], horizon)
                ok &= np.isfinite(var) & (var > 0)
            params[~ok] = np.nan
        return {"place": ends, "var": var, "ok": ok, "params": params, "age": age}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column("bars")[k].values
                found = of(rows.field("c").to_numpy(zero_copy_only=False), rows.field("_i").to_numpy(zero_copy_only=False), batch.column("first")[k].as_py())
                n = len(found["place"])
                per_bar = np.sqrt(found["var"])
                no_fit = method == "garch"
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("instrument")[k].as_py()] * n, batch.column("instrument").type), rows.field("d").take(pa.array(found["place"])),
                        *[pa.array(v, from_pandas=True) for v in (per_bar, per_bar * math.sqrt(ANNUAL))], pa.array(np.full(n, horizon if no_fit else 1, np.int32)),
                        pa.array(np.where(found["ok"], name, second) if no_fit else np.full(n, name)).cast(pa.string()), pa.array(found["ok"]), *[pa.array(found["params"][:, i], from_pandas=True) for i in range(4)], pa.array(found["age"]),
                    ],
                    ["instrument", "d", "per_bar", "annualized", "horizon", "method", "converged", "w", "a", "b", "nu", "age"],
                )

    kept = bars.filter("c > 0").select("instrument", "d", F.col("c").cast("double").alias("c"))
    out = stretches(kept, back, step).mapInArrow(run, f"instrument {kinds['instrument']}, d {kinds['d']}, per_bar double, annualized double, horizon int, method string, converged boolean, w double, a double, b double, nu double, age bigint")
    return out if method == "garch" else out.drop("w", "a", "b", "nu", "age")
