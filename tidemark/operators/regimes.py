"""Hidden Markov regimes: Gaussian states over vectors of bars, learnt by expectation-maximisation from many sequences at once.

A model is learnt from all sequences of its key. In each round the tasks run forward and backward over their sequences and add up what the states explain (first
states, moves, weights, sums and squares of the vectors); Spark adds up the sequences of each model, and the driver gets one row for each model: parameters, never bars.
A sequence is a row (at most ``lookback`` bars where ``of_bars`` makes it), so work spreads over sequences.

Vectors are standardised per model first. Round 0 starts from the vectors cut at quantiles of the last component. A round that raises no model's likelihood by more than ``tolerance`` a bar is the last.
States are numbered by the mean of the first component.

Defined results: bars with a null, NaN or infinite component are left out; a component that never changes counts as 0; a model with fewer bars than ``least`` is not learnt
and its bars have no state; equal vectors share one posterior in equal surroundings. An empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w

#: Least variance of a state along any direction, in standard units.
FLOOR = 1e-3


@dataclass
class States:
    """start (k), move (k x k), mean (k x p) and covariance (k x p x p) of the states of one model."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.mean)))
        for k, (m, c) in enumerate(zip(self.mean, self.cov, strict=True)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out[:, k] = -0.5 * (z**2).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
        return out

    def passes(self, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood, filtered and smoothed posteriors of each bar, and the expected moves."""
        logs = self.log_density(x)
        top = logs.max(axis=1, keepdims=True)
        dense, n = np.exp(logs - top), len(x)
        forward, scale = np.empty_like(dense), np.empty(n)
        for t in range(n):
            a = (self.start if t == 0 else forward[t - 1] @ self.move) * dense[t]
            scale[t] = max(a.sum(), 1e-300)
            forward[t] = a / scale[t]
        after, moves = np.ones(len(self.mean)), np.zeros_like(self.move)
        smooth = np.empty_like(dense)
        smooth[-1] = forward[-1]
        for t in range(n - 1, 0, -1):
            ahead = dense[t] * after / scale[t]
            moves += forward[t - 1][:, None] * self.move * ahead[None]
            after = self.move @ ahead
            smooth[t - 1] = forward[t - 1] * after
        return float(np.log(scale).sum() + top.sum()), forward, smooth / smooth.sum(axis=1, keepdims=True), moves

    def best_path(self, x: np.ndarray) -> np.ndarray:
        """The likeliest sequence of states; ties to the smaller state."""
        with np.errstate(divide="ignore"):
            move, score = np.log(self.move), np.log(self.start)
        logs, back = self.log_density(x), np.zeros((len(x), len(self.mean)), np.int64)
        score = score + logs[0]
        for t in range(1, len(x)):
            each = score[:, None] + move
            back[t] = each.argmax(axis=0)
            score = each.max(axis=0) + logs[t]
        path = np.empty(len(x), np.int64)
        path[-1] = score.argmax()
        for t in range(len(x) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def ordered(self) -> States:
        o = np.argsort(self.mean[:, 0], kind="stable")
        return States(self.start[o], self.move[np.ix_(o, o)], self.mean[o], self.cov[o])


@dataclass
class Learnt:
    """A model's states, the middle and spread of its components, and the log likelihood after each round."""

    states: States
    middle: np.ndarray
    spread: np.ndarray
    likelihood: list[float]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) / self.spread


def _positive(cov: np.ndarray) -> np.ndarray:
    """cov with no variance below FLOOR; as it is where it has none."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return cov if values[0] >= FLOOR else (vectors * np.maximum(values, FLOOR)) @ vectors.T


def maximised(stats: np.ndarray, k: int, p: int) -> States:
    """The states that the sums of one round (start, moves, weights, sums, squares; flat) are best explained by."""
    start, moves, weight, sums, squares = np.split(stats, np.cumsum([k, k * k, k, k * p]))
    weight = np.maximum(weight, 1e-9)
    mean = sums.reshape(k, p) / weight[:, None]
    cov = squares.reshape(k, p, p) / weight[:, None, None] - mean[:, :, None] * mean[:, None, :]
    moves = moves.reshape(k, k) + 1e-12
    return States(start / max(start.sum(), 1e-300), moves / moves.sum(axis=1, keepdims=True), mean, np.stack([_positive(c) for c in cov]))


def _vectors(row: pa.ListScalar) -> np.ndarray:
    values = row.values
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(values), -1)


def _sums(sequences: DataFrame, models: dict, k: int, p: int) -> dict:
    """(log likelihood, stats) of each model in one round."""
    shared, size = sequences.sparkSession.sparkContext.broadcast(models), k + k * k + k + k * p + k * p * p
    kind = sequences.schema["model"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, logs, stats = [], [], []
            for key, row in zip(batch.column("model").to_pylist(), batch.column("xs"), strict=True):
                if key not in shared.value or not len(row.values):
                    continue
                model = shared.value[key]
                x = model.standard(_vectors(row))
                log, _, smooth, moves = model.states.passes(x)
                squares = np.einsum("tk,ti,tj->kij", smooth, x, x)
                keys.append(key)
                logs.append(log)
                stats.append(np.concatenate([smooth[0], moves.ravel(), smooth.sum(axis=0), (smooth.T @ x).ravel(), squares.ravel()]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column("model").type), pa.array(logs, pa.float64()), pa.array(stats, pa.list_(pa.float64()))], ["model", "log", "stats"])

    each = sequences.select("model", "xs").mapInArrow(run, f"model {kind}, log double, stats array<double>")
    rows = each.groupBy("model").agg(F.sum("log").alias("log"), *[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(size)]).collect()
    shared.unpersist()
    return {r["model"]: (r["log"], np.array([r[f"s{i}"] for i in range(size)])) for r in rows}


def learnt(sequences: DataFrame, states: int = 3, rounds: int = 200, tolerance: float = 1e-5, least: int = 250) -> dict:
    """Learnt by model, of sequences (model, xs: array of vectors), at most rounds rounds."""
    bars = sequences.select("model", F.explode("xs").alias("x"))
    p = len(bars.select("x").first()["x"]) if not bars.isEmpty() else 0
    each = [F.col("x")[i] for i in range(p)]
    rows = bars.groupBy("model").agg(F.count("*").alias("n"), *[f(x).alias(f"{name}{i}") for i, x in enumerate(each) for name, f in (("m", F.avg), ("s", F.stddev_pop))], F.percentile(each[-1], [j / states for j in range(1, states)]).alias("cuts")).filter(F.col("n") >= least).collect() if p else []
    models: dict = {}
    for r in rows:
        spread = np.array([r[f"s{i}"] or 1.0 for i in range(p)])
        models[r["model"]] = Learnt(None, np.array([r[f"m{i}"] for i in range(p)]), spread, [])  # type: ignore[arg-type]
    if not models:
        return models
    # Round 0: moments of the vectors between the quantiles of the last component.
    cuts = F.broadcast(sequences.sparkSession.createDataFrame([(r["model"], [float(c) for c in r["cuts"]]) for r in rows], f"model {sequences.schema['model'].dataType.simpleString()}, cuts array<double>"))
    state = F.size(F.filter("cuts", lambda c: each[-1] > c)).alias("state")
    parts = bars.join(cuts, "model").select("model", state, *[x.alias(f"x{i}") for i, x in enumerate(each)])
    moments = parts.groupBy("model", "state").agg(F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i in range(p) for j in range(p)]).collect()
    for key, model in models.items():
        mean, cov = np.zeros((states, p)), np.tile(np.eye(p), (states, 1, 1))
        for r in (r for r in moments if r["model"] == key):
            raw = np.array([r[f"m{i}"] for i in range(p)])
            mean[r["state"]] = model.standard(raw)
            second = np.array([[r[f"c{i}_{j}"] for j in range(p)] for i in range(p)]) - np.outer(raw, raw)
            cov[r["state"]] = _positive(second / np.outer(model.spread, model.spread))
        model.states = States(np.full(states, 1 / states), np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1)), mean, cov)
    live = dict(models)
    sizes = {r["model"]: r["n"] for r in rows}
    for _ in range(rounds):
        for key, (log, stats) in _sums(sequences, live, states, p).items():
            model = live[key]
            model.likelihood.append(log)
            if len(model.likelihood) > 1 and log - model.likelihood[-2] <= tolerance * sizes[key]:
                del live[key]
            else:
                model.states = maximised(stats, states, p)
        if not live:
            break
    for model in models.values():
        model.states = model.states.ordered()
    return models


def decoded(sequences: DataFrame, models: dict) -> DataFrame:
    """model, sequence, place, state (of the likeliest path), confidence (its posterior) and filtered (its posterior without later bars), a row for each bar."""
    shared = sequences.sparkSession.sparkContext.broadcast(models)
    kinds = {f.name: f.dataType.simpleString() for f in sequences.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, name, row in zip(batch.column("model").to_pylist(), batch.column("sequence").to_pylist(), batch.column("xs"), strict=True):
                n = len(row.values) if row.is_valid else 0
                state, confidence, before = [None] * n, [None] * n, [None] * n
                if key in shared.value and n:
                    model = shared.value[key]
                    x = model.standard(_vectors(row))
                    _, forward, smooth, _ = model.states.passes(x)
                    path = model.states.best_path(x)
                    state, confidence, before = (a.tolist() for a in (path, smooth[np.arange(n), path], forward[np.arange(n), path]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, batch.column("model").type), pa.array([name] * n, batch.column("sequence").type), pa.array(range(n), pa.int32()), pa.array(state, pa.int32()), pa.array(confidence, pa.float64()), pa.array(before, pa.float64())],
                    ["model", "sequence", "place", "state", "confidence", "filtered"],
                )

    return sequences.select("model", "sequence", "xs").mapInArrow(run, f"model {kinds['model']}, sequence {kinds['sequence']}, place int, state int, confidence double, filtered double")


# Regimes of bars ---------------------------------------------------------------------------------


def of_bars(bars: DataFrame, span: int = 21, lookback: int = 756) -> DataFrame:
    """(model, sequence, ds, xs): for each instrument its last lookback bars (d, c), as vectors of log return and its deviation over span bars."""
    kept = bars.filter("c > 0").select("instrument", "d", F.col("c").cast("double").alias("c"))
    recent = kept.withColumn("_k", F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("d")))).filter(F.col("_k") <= lookback)
    r = recent.withColumn("r", w.log_return()).withColumn("vol", w.sd("r", span)).filter("r IS NOT NULL AND vol IS NOT NULL")
    found = r.groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("d", F.array("r", "vol").alias("x")))).alias("rows"))
    return found.select(F.col("instrument").alias("model"), F.lit(0).alias("sequence"), F.col("rows.d").alias("ds"), F.col("rows.x").alias("xs"))


def hidden_regimes(bars: DataFrame, fallback: DataFrame, states: int = 3, rounds: int = 200, least: int = 250, span: int = 21, lookback: int = 756) -> DataFrame:
    """instrument, d, state, trend, vol, confidence, method of the last lookback bars of each instrument.

    trend: whether the mean return of the state's bars is beyond a tenth of the deviation of all; vol: the rank of the state's mean deviation. fallback (instrument, d,
    trend, vol, confidence) stands for instruments with fewer than least vectors, at four fifths of its confidence."""
    sequences = of_bars(bars, span, lookback)
    kept = sequences.persist(StorageLevel.DISK_ONLY)
    models = learnt(kept, states, rounds, least=least)
    kept.unpersist()
    rows = decoded(sequences, models)
    each = sequences.select("model", "sequence", F.posexplode(F.arrays_zip("ds", "xs")).alias("place", "bar")).join(rows, ["model", "sequence", "place"])
    each = each.select(F.col("model").alias("instrument"), F.col("bar.ds").alias("d"), F.col("bar.xs")[0].alias("r"), F.col("bar.xs")[1].alias("dev"), "state", "confidence")
    per_state = each.filter("state IS NOT NULL").groupBy("instrument", "state").agg(F.avg("r").alias("_r"), F.avg("dev").alias("_dev"))
    by_dev = Window.partitionBy("instrument").orderBy("_dev", "state")
    per_state = per_state.withColumns({"_rank": F.row_number().over(by_dev), "_of": F.count("*").over(Window.partitionBy("instrument"))})
    eps = each.groupBy("instrument").agg((0.1 * F.stddev_pop("r")).alias("_eps"))
    labels = per_state.join(eps, "instrument").select(
        "instrument",
        "state",
        F.when(F.col("_r") > F.col("_eps"), "up").when(F.col("_r") < -F.col("_eps"), "down").otherwise("ranging").alias("trend"),
        F.when(F.col("_rank") == 1, "low").when(F.col("_rank") == F.col("_of"), "high").otherwise("normal").alias("vol"),
    )
    by_model = each.filter("state IS NOT NULL").join(labels, ["instrument", "state"]).select("instrument", "d", "state", "trend", "vol", "confidence", F.lit("hmm").alias("method"))
    by_rule = each.filter("state IS NULL").select("instrument", "d").join(fallback, ["instrument", "d"], "left")
    return by_model.unionByName(by_rule.select("instrument", "d", F.lit(None).cast("int").alias("state"), "trend", "vol", (0.8 * F.col("confidence")).alias("confidence"), F.lit("hmm->rule_fallback").alias("method")))
