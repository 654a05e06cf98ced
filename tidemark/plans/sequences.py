"""Queries of outcomes, simulation, validation, risk and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.operators import outcomes as oc, validation as va
from tidemark.plans.bars import day_bars
from tidemark.plans.indicators import rounded
from tidemark.plans.joins import BARS
from tidemark.streaming import lifecycle, windows as st


def t1_triple_barrier(spark, sf_dir):
    b = oc.triple_barrier(day_bars(spark, sf_dir), F.col("c") * 1.4, F.col("c") * 0.6, 10)
    return b.select("instrument", "d", "label", "bars_held")


def t5_excursions(spark, sf_dir):
    return rounded(day_bars(spark, sf_dir).withColumns(oc.excursions(20)).select("instrument", "d", "mfe", "mae"), ["instrument", "d"])


def t21_fifo(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fills = li.select(F.col("l_suppkey").alias("instrument"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fill_id"), F.when(F.col("l_returnflag") == "N", 1).otherwise(-1).alias("side"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), "l_shipdate")
    return rounded(oc.fifo(fills, ["l_shipdate", "fill_id"]).withColumn("pnl", F.round("pnl", 4)), ["instrument", "buy_id", "sell_id"])


def t28_runs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("instrument"), F.col("o_orderkey").alias("d"), F.col("o_orderstatus").alias("status"))
    return oc.runs(e, "status")


def f33_sign_streak(spark, sf_dir):
    b = day_bars(spark, sf_dir).withColumn("sign", F.signum(F.col("c") - F.lag("c").over(w.ordered())).cast("int")).filter("sign IS NOT NULL")
    return oc.runs(b, "sign").select("instrument", F.col("run").alias("run"), "sign", "n")


def w24_recursive(spark, sf_dir):
    return rounded(oc.walked(day_bars(spark, sf_dir), ["h", "l", "c"], "ema12 double, macd double, macd_signal double, rsi double, atr_wilder double, ewma_vol double", dict, oc.recursive_step), ["instrument", "d"])


def t6_simulator(spark, sf_dir):
    b = day_bars(spark, sf_dir).withColumns({"hi": w.prior_high("h", 20), "lo": w.prior_low("l", 20)}).withColumn("signal", F.when(F.col("c") > F.col("hi"), 1).when(F.col("c") < F.col("lo"), -1).otherwise(0))
    found = oc.walked(b, ["o", "h", "l", "c", "signal"], "side int, result double, reason string", dict, oc.simulator(0.3, 0.5, 0.001))
    return rounded(found.filter("result IS NOT NULL"), ["instrument", "d"])


def _strategies(spark, sf_dir) -> DataFrame:
    """(strategy, instrument, d, r): returns per bar of momentum strategies of several lookbacks."""
    b = day_bars(spark, sf_dir).withColumn("r", w.log_return() / 100).withColumn("next", F.lead("r").over(w.ordered()))
    lengths = (5, 10, 21, 42, 63)
    b = b.withColumns({f"m{n}": F.signum(F.sum("r").over(w.trailing(n))) for n in lengths})
    looks = F.array(*[F.struct(F.lit(f"m{n}").alias("strategy"), F.col(f"m{n}").alias("side")) for n in lengths])
    return b.select("instrument", "d", "next", F.explode(looks).alias("s")).select("s.strategy", "instrument", "d", (F.col("s.side") * F.col("next")).alias("r")).filter("r IS NOT NULL")


def _blocks(returns: DataFrame, bars: DataFrame) -> DataFrame:
    """returns with their block, 0 to 7, of the days from the first bar to the last.

    A block has an eighth of the days, rounded up to tens of days (310 in the test tables, which the SQL has as a constant); ranges too short
    for that to leave each block days are cut evenly.
    """
    ends = bars.agg(F.min("d").alias("_first"), (F.datediff(F.max("d"), F.min("d")) + 1).alias("_days"))
    length = F.when(F.col("_days") >= 640, F.ceil(F.col("_days") / 80) * 10).otherwise(F.col("_days") / 8)
    block = F.least(F.floor(F.datediff("d", "_first") / length), F.lit(7)).cast("int")
    return returns.crossJoin(F.broadcast(ends)).withColumn("block", block).drop("_first", "_days")


def v4_overfitting(spark, sf_dir):
    return rounded(va.overfitting(_blocks(_strategies(spark, sf_dir), day_bars(spark, sf_dir))), [])


def v5_purged_splits(spark, sf_dir):
    days = day_bars(spark, sf_dir).agg(F.datediff(F.max("d"), F.min("d")).cast("long").alias("n"))
    # Whole days as rows: every day of the calendar from the first bar to the last has a place.
    return va.purged_splits(days.select(F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("i"), "n").select("i", F.floor(F.col("i") * 6 / (F.col("n") + 1)).cast("int").alias("g")), 6, 2, 5, 10)


def v8_bootstrap(spark, sf_dir):
    """Sharpe ratios of two momentum strategies (5 and 21 bars) in each draw of blocks of months; a strategy's return of a day is the mean over all instruments."""
    days = _strategies(spark, sf_dir).filter("strategy IN ('m5', 'm21')").groupBy("strategy", "d").agg(F.avg("r").alias("r"))
    both = days.groupBy("d").agg(F.max(F.when(F.col("strategy") == "m5", F.col("r"))).alias("a"), F.max(F.when(F.col("strategy") == "m21", F.col("r"))).alias("b")).dropna()
    months = both.groupBy(F.trunc("d", "MM").alias("m")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # Months are few however much data there is: one window over them is small.
    pairs = months.select((F.row_number().over(Window.orderBy("m")) - 1).cast("long").alias("i"), "a", "b")
    return rounded(va.paired_bootstrap(pairs, 500, 6, 12), ["draw"])


def v12_drawdown_bands(spark, sf_dir):
    """Bands of the worst drawdown and of the total return over 500 resampled paths of the simulator's trades."""
    trades = t6_simulator(spark, sf_dir).select("instrument", "d", "result")
    # Numbered within instruments, from where the one before ends, so that no window holds all trades.
    sizes = trades.groupBy("instrument").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("instrument").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = trades.join(F.broadcast(sizes.select("instrument", "before")), "instrument").select((F.col("before") + F.row_number().over(w.ordered()) - 1).cast("long").alias("i"), F.col("result").alias("r"))
    paths = va.drawdown_paths(numbered, 500)
    bands = [F.round(F.percentile(c, F.lit(p / 100)), 6).alias(f"{c}_p{p:02d}") for c in ("drawdown", "total") for p in (5, 25, 50, 75, 95)]
    return paths.agg(*bands, F.round(F.max("drawdown"), 6).alias("drawdown_worst"), F.round(F.avg((F.col("total") < 0).cast("double")), 6).alias("loss_probability"))


def x1_kelly(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"))
    stats = li.groupBy("l_returnflag").agg(F.avg((F.col("pnl") > 0).cast("double")).alias("p"), F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("gain"), (-F.avg(F.when(F.col("pnl") < 0, F.col("pnl")))).alias("loss"))
    kelly = F.col("p") - F.try_divide(1 - F.col("p"), F.try_divide(F.col("gain"), F.col("loss")))
    return rounded(stats.select("l_returnflag", "p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), kelly)).alias("kelly")), ["l_returnflag"])


def x4_stop_and_units(spark, sf_dir):
    b = day_bars(spark, sf_dir).withColumn("tr", w.true_range()).withColumn("atr", w.mean("tr", 14)).filter("atr > 0")
    return rounded(b.select("instrument", "d", (F.col("c") - 2 * F.col("atr")).alias("stop"), (F.lit(10000.0) / (2 * F.col("atr"))).alias("units")), ["instrument", "d"])


def x5_gross_cap(spark, sf_dir):
    b = day_bars(spark, sf_dir).withColumn("r", w.simple_return()).filter("r IS NOT NULL")
    gross = F.sum(F.abs("r")).over(Window.partitionBy("d"))
    return rounded(b.select("instrument", "d", (F.col("r") * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(1.0), gross), F.lit(1.0)))).alias("weight")), ["instrument", "d"])


def x6_breaker(spark, sf_dir):
    b = day_bars(spark, sf_dir).withColumn("dd", -w.drawdown("c"))
    state = F.when(F.col("dd") >= 0.9, "HALTED").when(F.col("dd") >= 0.7, "BREAKER").when(F.col("dd") >= 0.4, "REDUCING").otherwise("OK")
    scale = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.7 - F.col("dd")) / 0.3))
    return rounded(b.select("instrument", "d", state.alias("state"), scale.alias("scale")), ["instrument", "d"])


def z2_stream_bars(spark, sf_dir):
    """Hour bars of the event stream; the last windows, which the watermark hasn't closed, aren't there yet."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    out = st.drained(st.tumbling_bars(events, "1 hour", "10 minutes"), "bars")
    return rounded(out.withColumn("t", F.col("t").cast("timestamp_ntz")), ["instrument", "t"])


def t23_lifecycle(spark, sf_dir):
    """Messages that move each user's funnel forward, kept as streaming state."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ranks = {"view": 1, "click": 2, "signup": 3, "purchase": 4}
    rank = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ranks.items()], F.lit(0))
    messages = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").select(F.col("user_id").alias("order_id"), F.col("event_id").alias("message_id"), "ts", rank.alias("rank"))
    return st.drained(lifecycle.advanced(messages, 4), "orders")


def nearest_of(frames, ids: np.ndarray, q: np.ndarray, k: int = 16, rows: int = 1024, asked: int = 512):
    """The k nearest vectors of the frames (vec_id, embedding, label) to each query, by distance and id, itself excluded. Distances are held for rows x asked pairs at a time, and k of each query for the next."""
    kept = [np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max), np.zeros((len(ids), k), np.int64)]
    for frame in frames:
        f = frame.sort_values("vec_id", kind="stable")  # the stable sort below leaves ties in the final order
        for lo in range(0, len(f), rows):
            part = f.iloc[lo : lo + rows]
            x, names, labels = np.stack(part["embedding"].to_numpy()).astype(float), part["vec_id"].to_numpy(), part["label"].to_numpy()
            for at in range(0, len(ids), asked):
                some = slice(at, at + asked)
                y = q[some]
                dist = np.sqrt(np.maximum((y * y).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * y @ x.T, 0)).round(5)
                dist[ids[some][:, None] == names[None, :]] = np.inf
                best = np.argsort(dist, axis=1, kind="stable")[:, :k]
                both = [np.concatenate([old[some], new], axis=1) for old, new in zip(kept, (np.take_along_axis(dist, best, axis=1), names[best], labels[best]), strict=True)]
                order = np.lexsort((both[1], both[0]), axis=1)[:, :k]
                for old, new in zip(kept, both, strict=True):
                    old[some] = np.take_along_axis(new, order, axis=1)
    a, b = np.nonzero(np.isfinite(kept[0]))
    yield pd.DataFrame({"query": ids[a], "vec_id": kept[1][a, b], "label": kept[2][a, b], "dist": kept[0][a, b]})


def r12_nearest_setups(spark, sf_dir):
    """The 15 nearest vectors of each vector whose id is divisible by 100, itself excluded."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    asked = vectors.filter("vec_id % 100 = 0").select("vec_id", "embedding")
    block, found = 2048, None
    for at in range(0, max(asked.count(), 1), block):
        rows = asked.orderBy("vec_id").offset(at).limit(block).toPandas()
        if rows.empty:
            break
        ids, q = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
        shared = spark.sparkContext.broadcast((ids, q))

        def run(frames, shared=shared):
            yield from nearest_of(frames, *shared.value)

        part = vectors.mapInPandas(run, "query bigint, vec_id bigint, label int, dist double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query bigint, vec_id bigint, k bigint, dist double")
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("dist", "vec_id")).cast("long"))
    return ranked.filter("k <= 15").select("query", "vec_id", "k", "dist")


_ORD = "(PARTITION BY instrument ORDER BY d)"
_ATR = f"a AS (SELECT *, greatest(h - l, abs(h - coalesce(lag(c) OVER {_ORD}, c)), abs(l - coalesce(lag(c) OVER {_ORD}, c))) AS tr FROM day_bars), b AS (SELECT *, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr FROM a WINDOW w AS (PARTITION BY instrument ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"
_AHEAD = "(PARTITION BY instrument ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
_LOOKS = " UNION ALL ".join(f"SELECT 'm{n}' AS strategy, block, sign(sum(r) OVER (PARTITION BY instrument ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) * nxt AS r FROM x" for n in (5, 10, 21, 42, 63))
ORACLE_SQL = {
    "t1_triple_barrier": f"WITH {BARS}, x AS (SELECT *, row_number() OVER {_ORD} AS i, count(*) OVER (PARTITION BY instrument) AS n FROM day_bars), y AS (SELECT a.instrument, a.d, b.i - a.i AS k, CASE WHEN b.l <= a.c * 0.6 THEN 0 WHEN b.h >= a.c * 1.4 THEN 1 END AS hit FROM x a JOIN x b ON a.instrument = b.instrument AND b.i BETWEEN a.i + 1 AND a.i + 10 WHERE a.i + 10 <= a.n), z AS (SELECT instrument, d, min_by(hit, k) AS label, min(k) AS bars_held FROM y WHERE hit IS NOT NULL GROUP BY 1, 2) SELECT x.instrument, x.d, z.label, CAST(z.bars_held AS INT) AS bars_held FROM x LEFT JOIN z ON x.instrument = z.instrument AND x.d = z.d",
    "t5_excursions": f"WITH {BARS} SELECT instrument, d, CASE WHEN count(*) OVER w = 20 THEN round(max(h) OVER w - c, 6) END AS mfe, CASE WHEN count(*) OVER w = 20 THEN round(min(l) OVER w - c, 6) END AS mae FROM day_bars WINDOW w AS {_AHEAD.format(n=20)}",
    "t21_fifo": """WITH q AS (
        SELECT l_suppkey AS instrument, l_orderkey * 10 + l_linenumber AS fill_id, CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END AS side, l_extendedprice AS price,
               sum(l_quantity) OVER (PARTITION BY l_suppkey, l_returnflag = 'N' ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) AS upto FROM lineitem
    ), most AS (SELECT instrument, least(max(upto) FILTER (side > 0), max(upto) FILTER (side < 0)) AS most, count(DISTINCT side) AS sides FROM q GROUP BY 1
    ), cuts AS (SELECT DISTINCT instrument, upto FROM q JOIN most USING (instrument) WHERE sides = 2 AND upto <= most
    ), part AS (SELECT instrument, upto, upto - coalesce(lag(upto) OVER (PARTITION BY instrument ORDER BY upto), 0) AS qty FROM cuts
    ), bought AS (SELECT part.*, b.fill_id AS buy_id, b.price AS paid FROM part ASOF JOIN (SELECT * FROM q WHERE side > 0) b ON part.instrument = b.instrument AND part.upto <= b.upto
    ) SELECT bought.instrument, buy_id, s.fill_id AS sell_id, round(bought.qty, 6) AS qty, round(bought.qty * (s.price - paid), 4) AS pnl
    FROM bought ASOF JOIN (SELECT * FROM q WHERE side < 0) s ON bought.instrument = s.instrument AND bought.upto <= s.upto""",
    "t28_runs": "WITH x AS (SELECT o_orderpriority AS instrument, o_orderkey AS d, o_orderstatus AS status, CASE WHEN lag(o_orderstatus) OVER w IS NOT DISTINCT FROM o_orderstatus THEN 0 ELSE 1 END AS ch FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)), y AS (SELECT *, sum(ch) OVER (PARTITION BY instrument ORDER BY d) AS run FROM x) SELECT instrument, CAST(run AS BIGINT) AS run, any_value(status) AS status, count(*) AS n, min(d) AS first, max(d) AS last FROM y GROUP BY instrument, run",
    "f33_sign_streak": f"WITH {BARS}, s AS (SELECT instrument, d, CAST(sign(c - lag(c) OVER {_ORD}) AS INT) AS sign FROM day_bars), x AS (SELECT *, CASE WHEN lag(sign) OVER {_ORD} IS NOT DISTINCT FROM sign THEN 0 ELSE 1 END AS ch FROM s WHERE sign IS NOT NULL), y AS (SELECT *, sum(ch) OVER {_ORD} AS run FROM x) SELECT instrument, CAST(run AS BIGINT) AS run, any_value(sign) AS sign, count(*) AS n FROM y GROUP BY instrument, run",
    "v4_overfitting": f"WITH {BARS}, q AS (SELECT *, ln(c / lag(c) OVER {_ORD}) / 100 AS r FROM day_bars), x AS (SELECT *, lead(r) OVER {_ORD} AS nxt, CAST(least(floor(datediff('day', DATE '1995-01-01', d) / 310), 7) AS INT) AS block FROM q), s AS ({_LOOKS}), b AS (SELECT strategy, block, count(r) AS n, sum(r) AS s, sum(r * r) AS q FROM s WHERE r IS NOT NULL GROUP BY 1, 2), h AS (SELECT i AS split, k AS block, (i >> k) & 1 = 1 AS inside FROM range(256) t(i), range(8) u(k) WHERE bit_count(i) = 4), g AS (SELECT split, strategy, inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM b JOIN h USING (block) GROUP BY 1, 2, 3), m AS (SELECT split, strategy, inside, round(coalesce((s / n) / nullif(sqrt(greatest((q - n * (s / n) * (s / n)) / (n - 1), 0)), 0), 0), 9) AS x FROM g), a AS (SELECT split, strategy, max(x) FILTER (inside) AS a, max(x) FILTER (NOT inside) AS b FROM m GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY a DESC, strategy) AS best, row_number() OVER (PARTITION BY split ORDER BY b, strategy) AS rk, count(*) OVER (PARTITION BY split) AS many FROM a) SELECT count(*) AS splits, round(avg(CAST(2 * rk <= many + 1 AS DOUBLE)), 6) AS pbo FROM p WHERE best = 1",
    "v5_purged_splits": f"WITH {BARS}, n AS (SELECT max(datediff('day', DATE '1995-01-01', d)) + 1 AS n FROM day_bars), r AS (SELECT i, CAST(floor(i * 6 / n) AS INT) AS g FROM n, range(n) t(i)), c AS (SELECT id AS split FROM range(64) t(id) WHERE bit_count(id) = 2), e AS (SELECT g, min(i) AS lo, max(i) AS hi FROM r GROUP BY 1), x AS (SELECT split, r.i, ((split >> r.g) & 1) = 1 AS test, EXISTS (SELECT 1 FROM e WHERE ((split >> e.g) & 1) = 1 AND r.i BETWEEN e.lo - 5 AND e.hi + 10) AS near FROM c, r) SELECT split, count(*) FILTER (test) AS n_test, count(*) FILTER (NOT test AND NOT near) AS n_train FROM x GROUP BY 1",
    "x1_kelly": "WITH t AS (SELECT l_returnflag, l_extendedprice * (l_discount - 0.05) AS pnl FROM lineitem), s AS (SELECT l_returnflag, avg(CAST(pnl > 0 AS DOUBLE)) AS p, avg(pnl) FILTER (pnl > 0) AS gain, -avg(pnl) FILTER (pnl < 0) AS loss FROM t GROUP BY 1) SELECT l_returnflag, round(p, 6) AS p, round(greatest(0, least(1, p - (1 - p) / (gain / loss))), 6) AS kelly FROM s",
    "x4_stop_and_units": f"WITH {BARS}, {_ATR} SELECT instrument, d, round(c - 2 * atr, 6) AS stop, round(10000 / (2 * atr), 6) AS units FROM b WHERE atr > 0",
    "x5_gross_cap": f"WITH {BARS}, r AS (SELECT instrument, d, c / lag(c) OVER {_ORD} - 1 AS r FROM day_bars) SELECT instrument, d, round(r * least(1, coalesce(1 / nullif(sum(abs(r)) OVER (PARTITION BY d), 0), 1)), 6) AS weight FROM r WHERE r IS NOT NULL",
    "x6_breaker": f"WITH {BARS}, x AS (SELECT instrument, d, 1 - c / max(c) OVER {_ORD} AS dd FROM day_bars) SELECT instrument, d, CASE WHEN dd >= 0.9 THEN 'HALTED' WHEN dd >= 0.7 THEN 'BREAKER' WHEN dd >= 0.4 THEN 'REDUCING' ELSE 'OK' END AS state, round(greatest(0, least(1, (0.7 - dd) / 0.3)), 6) AS scale FROM x",
    "z2_stream_bars": "SELECT event_type AS instrument, date_trunc('hour', ts) AS t, round(min_by(value, (ts, event_id)), 6) AS o, max(value) AS h, min(value) AS l, max_by(value, (ts, event_id)) AS c, count(*) AS v FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "t23_lifecycle": "WITH x AS (SELECT user_id, event_id, ts, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS INT) AS rank FROM events), y AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x) SELECT user_id AS order_id, event_id AS message_id, rank FROM y WHERE rank > before",
    "r12_nearest_setups": "WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT query, vec_id, round(list_distance(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) AS dist FROM q JOIN embeddings ON vec_id <> query) SELECT query, vec_id, k, dist FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, vec_id) AS k FROM x) WHERE k <= 15",
}
QUERIES = {f.__name__: f for f in (t1_triple_barrier, t5_excursions, t21_fifo, t28_runs, f33_sign_streak, w24_recursive, t6_simulator, v4_overfitting, v5_purged_splits, v8_bootstrap, v12_drawdown_bands, x1_kelly, x4_stop_and_units, x5_gross_cap, x6_breaker, z2_stream_bars, t23_lifecycle, r12_nearest_setups)}
