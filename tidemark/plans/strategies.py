"""Queries of strategies, gates, patterns, books and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.operators import alignment, crosssection as xs, outcomes as oc, portfolio as pf
from tidemark.plans.bars import day_bars
from tidemark.plans.indicators import rounded
from tidemark.plans.joins import BARS

_ORD = "(PARTITION BY instrument ORDER BY d)"


def _t(n: int) -> str:
    return f"(PARTITION BY instrument ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def g2_weekly_gate(spark, sf_dir):
    """Close against the mean of the last four closed weeks and the open one, as it is known at each bar: no bar sees its week's end."""
    b = day_bars(spark, sf_dir).withColumn("week", F.date_trunc("week", "d").cast("date"))
    weeks = b.groupBy("instrument", "week").agg(F.max_by("c", "d").alias("wc"))
    past = Window.partitionBy("instrument").orderBy("week").rowsBetween(-4, -1)
    known = weeks.select("instrument", "week", F.when(F.count("wc").over(past) == 4, F.sum("wc").over(past)).alias("s"))
    return rounded(b.join(known, ["instrument", "week"]).select("instrument", "d", ((F.col("s") + F.col("c")) / 5).alias("ma"), (F.col("c") > (F.col("s") + F.col("c")) / 5).alias("above")), ["instrument", "d"])


def g7_ensemble(spark, sf_dir):
    """Momentum, breakout and band reversal vote; two votes of one side make a signal."""
    b = day_bars(spark, sf_dir).withColumns({"hi": w.prior_high("h", 20), "lo": w.prior_low("l", 20), "m": w.mean("c", 20), "s": w.sd("c", 20), "mom": w.simple_return(n=21)})
    votes = [
        F.coalesce(F.signum("mom").cast("int"), F.lit(0)),
        F.when(F.col("c") > F.col("hi"), 1).when(F.col("c") < F.col("lo"), -1).otherwise(0),
        F.when(F.col("c") < F.col("m") - F.col("s"), 1).when(F.col("c") > F.col("m") + F.col("s"), -1).otherwise(0),
    ]
    total = votes[0] + votes[1] + votes[2]
    return b.select("instrument", "d", total.alias("votes"), F.when(total >= 2, 1).when(total <= -2, -1).otherwise(0).alias("signal"))


def g9_residual_momentum(spark, sf_dir):
    """The two best of each day by the sum of residuals against the day's mean, over their spread."""
    r = day_bars(spark, sf_dir).withColumn("r", w.log_return() / 100).filter("r IS NOT NULL").withColumn("m", F.avg("r").over(xs.day()))
    t = w.trailing(60)
    b = r.withColumn("beta", F.when(F.count("r").over(t) == 60, F.try_divide(F.covar_samp("r", "m").over(t), F.var_samp("m").over(t)))).withColumn("e", F.col("r") - F.col("beta") * F.col("m"))
    scored = b.withColumn("score", F.round(F.try_divide(w.mean("e", 20), w.sd("e", 20)), 9)).filter("score IS NOT NULL")
    k = F.row_number().over(xs.day().orderBy(F.desc("score"), "instrument")).cast("long")
    return rounded(scored.withColumn("k", k).filter("k <= 2").select("instrument", "d", "k", "score"), ["instrument", "d"])


def g10_reversal(spark, sf_dir):
    """The worst five-bar return of a day, if it is significant and the bar is liquid; z from the full row."""
    b = day_bars(spark, sf_dir).withColumn("r5", w.simple_return(n=5)).filter("r5 IS NOT NULL")
    z = F.try_divide(F.col("r5") - F.avg("r5").over(xs.day()), F.nullif(F.stddev_samp("r5").over(xs.day()), F.lit(0.0)))
    k = F.row_number().over(xs.day().orderBy("r5", "instrument"))
    return rounded(b.withColumns({"z": z, "k": k}).filter("k = 1 AND z < -1 AND v >= 2").select("instrument", "d", "z"), ["instrument", "d"])


def g11_event_drift(spark, sf_dir):
    """For each large order: the first bar at or after it, and what the bar after made against the one before."""
    bars = day_bars(spark, sf_dir).select("instrument", "d", "c").withColumns({"before": F.lag("c").over(w.ordered()), "after": F.lead("c").over(w.ordered()), "at": F.col("d")})
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice > 400000")
    events = o.select(F.col("o_orderkey").alias("event"), F.col("o_orderpriority").alias("instrument"), F.to_date("o_orderdate").alias("d"))
    found = alignment.asof(events, bars, "instrument", "d", ["at", "before", "after"], forward=True)
    return rounded(found.select("event", F.col("at"), (F.try_divide("after", "before") - 1).alias("announced")), ["event", "at"])


def g12_extreme_hold(spark, sf_dir):
    """A signal when the z-score passes 1.5, held for ten bars and armed anew by each further hit."""
    b = day_bars(spark, sf_dir).withColumns({"z": w.z_score("c", 156, 52), "i": F.row_number().over(w.ordered())})
    hit = F.when(F.abs("z") >= 1.5, F.struct(F.col("i").alias("i"), (-F.signum("z")).cast("int").alias("side")))
    last = F.last(hit, ignorenulls=True).over(w.ordered().rowsBetween(Window.unboundedPreceding, 0))
    held = b.withColumn("_hit", last)
    return held.select("instrument", "d", F.when(F.col("i") - F.col("_hit.i") < 10, F.col("_hit.side")).otherwise(0).alias("signal"))


def g13_fix_hour(spark, sf_dir):
    """Events in the London hour before the fix, by day: first to last value, faded."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("local", F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/London"))
    day = e.filter(F.hour("local") == 15).groupBy("event_type", F.to_date("local").alias("d")).agg(F.min_by("value", F.struct("ts", "event_id")).alias("a"), F.max_by("value", F.struct("ts", "event_id")).alias("b"), F.count("*").alias("n"))
    return day.select("event_type", "d", "n", (-F.signum(F.col("b") - F.col("a"))).cast("int").alias("signal"))


def g14_close_momentum(spark, sf_dir):
    """A day's range against the median of the ten days before."""
    r = day_bars(spark, sf_dir).withColumn("x", F.col("h") - F.col("l"))
    past = w.ordered().rowsBetween(-10, -1)
    median = F.when(F.count("x").over(past) == 10, F.percentile("x", F.lit(0.5)).over(past))
    return rounded(r.withColumn("median", median).select("instrument", "d", "median", (F.col("x") > F.col("median")).alias("wide")), ["instrument", "d"])


def g19_blackout(spark, sf_dir):
    """Bars that aren't within two bars of a large order of their instrument."""
    bars = day_bars(spark, sf_dir).select("instrument", "d", "c")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice > 400000").select(F.col("o_orderpriority").alias("instrument"), F.to_date("o_orderdate").alias("d")).distinct().withColumn("event", F.lit(1))
    near = alignment.band(o, bars, "instrument", "d", 2).select("instrument", "d").distinct()
    return bars.join(near, ["instrument", "d"], "left_anti")


def g25_patterns(spark, sf_dir):
    """Fair-value gaps, engulfing bars, pins, and breaks of the last swing, as one row per pattern."""
    prev = lambda x, n=1: F.lag(x, n).over(w.ordered())
    o, h, low, c = (F.col(x) for x in "ohlc")
    body = F.abs(c - o)
    b = day_bars(spark, sf_dir).withColumns({"hi": w.prior_high("h", 10), "lo": w.prior_low("l", 10)})
    found = {
        "fvg_up": low > prev("h", 2),
        "fvg_down": h < prev("l", 2),
        "engulf_up": (c > o) & (prev("c") < prev("o")) & (c >= prev("o")) & (o <= prev("c")),
        "engulf_down": (c < o) & (prev("c") > prev("o")) & (c <= prev("o")) & (o >= prev("c")),
        "pin_up": (F.least(o, c) - low > 2 * body) & (h - F.greatest(o, c) < body) & (body > 0),
        "pin_down": (h - F.greatest(o, c) > 2 * body) & (F.least(o, c) - low < body) & (body > 0),
        "break_up": c > F.col("hi"),
        "break_down": c < F.col("lo"),
    }
    names = F.filter(F.array(*[F.col(k) for k in found]), lambda x: x.isNotNull())
    return b.withColumns({k: F.when(x, F.lit(k)) for k, x in found.items()}).select("instrument", "d", F.explode(names).alias("pattern"))


def t2_window_outcome(spark, sf_dir):
    """Signals of the breakout rule: which level the next 15 bars reach first."""
    b = oc.triple_barrier(day_bars(spark, sf_dir).withColumn("hi", w.prior_high("h", 20)), F.col("c") * 1.3, F.col("c") * 0.7, 15)
    return b.filter("c > hi").groupBy("instrument").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("sl"), F.count_if(F.col("label").isNull()).alias("pending"))


def t22_decayed_win_rate(spark, sf_dir):
    """Beta posterior of each supplier's wins, older fills weighing 0.99 for each later one: closed form, no recursion."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_suppkey").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"))
    t = li.withColumns({"w": F.pow(F.lit(0.99), F.row_number().over(order) - 1), "win": (F.col("l_discount") > 0.05).cast("double")})
    s = t.groupBy("l_suppkey").agg((1 + F.sum(F.col("w") * F.col("win"))).alias("a"), (1 + F.sum(F.col("w") * (1 - F.col("win")))).alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1)))
    return rounded(s.select("l_suppkey", mean.alias("mean"), F.greatest(F.lit(0.0), mean - sd).alias("lower")), ["l_suppkey"])


def _signals(spark, sf_dir) -> DataFrame:
    b = day_bars(spark, sf_dir).withColumns({"r": w.log_return(), "hi": w.prior_high("h", 20), "lo": w.prior_low("l", 20)}).withColumn("score", w.scaled_momentum("r", 21))
    return b.select("instrument", "d", "o", "h", "l", "c", F.when(F.col("c") > F.col("hi"), 1).when(F.col("c") < F.col("lo"), -1).otherwise(0).alias("signal"), F.abs("score").alias("score"))


def t10_portfolio(spark, sf_dir):
    """Twelve books, of three risks by four sets of levels, over the breakout signals."""
    grid = [(f"r{r}s{s}t{t}", r / 1000, 4, 2.0, s / 100, t / 100, 0.5) for r in (5, 10, 20) for s in (20, 40) for t in (30, 60)]
    configs = spark.createDataFrame(grid, "book string, risk double, slots int, max_gross double, stop double, target double, halt double")
    return rounded(pf.books(_signals(spark, sf_dir), configs), ["book", "d"])


def v15_best_books(spark, sf_dir):
    """The grid of books by a composite of growth, steadiness and drawdown."""
    run = Window.partitionBy("book").orderBy("d")
    e = t10_portfolio(spark, sf_dir).withColumns({"r": F.col("equity") / F.lag("equity").over(run) - 1, "dd": 1 - F.col("equity") / F.max("equity").over(run)})
    s = e.groupBy("book").agg(F.max_by("equity", "d").alias("final"), F.try_divide(F.avg("r"), F.stddev_samp("r")).alias("sharpe"), F.max("dd").alias("max_dd"), F.sum("n_closed").alias("trades"))
    return rounded(s.withColumn("score", F.col("sharpe") * F.col("final") / F.pow(1 + F.col("max_dd"), 2)), ["book"])


def v11_walk_forward(spark, sf_dir):
    """Returns of the momentum rule in the first 70 and the last 30 per cent of each series."""
    b = day_bars(spark, sf_dir).withColumns({"r": w.log_return() / 100, "i": F.row_number().over(w.ordered())}).withColumns({"side": F.signum(w.mean("r", 21)), "next": F.lead("r").over(w.ordered())})
    whole = b.groupBy("instrument").agg(F.max("i").alias("n"))
    part = F.when(F.col("i") <= 0.7 * F.col("n"), "train").otherwise("test")
    x = b.join(whole, "instrument").withColumn("part", part).withColumn("x", F.col("side") * F.col("next")).filter("x IS NOT NULL")
    return rounded(x.groupBy("instrument", "part").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.try_divide(F.avg("x"), F.stddev_samp("x")).alias("sharpe")), ["instrument", "part"])


def m3_dataset(spark, sf_dir):
    """Features of each bar with its triple-barrier label."""
    b = oc.triple_barrier(day_bars(spark, sf_dir), F.col("c") * 1.4, F.col("c") * 0.6, 10).withColumn("r", w.log_return())
    f = b.withColumns({"mom": w.scaled_momentum("r", 21), "vol": w.sd("r", 20), "z": w.z_score("c", 50, 20), "dd": w.drawdown("c")})
    return rounded(f.filter("label IS NOT NULL AND mom IS NOT NULL").select("instrument", "d", "label", "mom", "vol", "z", "dd"), ["instrument", "d"])


def m4_meta_label(spark, sf_dir):
    """A scaled logistic regression on the first 70 per cent of the days, its probabilities on the rest, and whether each is above the conformal bound."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = m3_dataset(spark, sf_dir).withColumn("label", F.col("label").cast("double"))
    cut = data.agg(F.percentile(F.datediff("d", F.lit("1970-01-01").cast("date")), F.array(F.lit(0.5), F.lit(0.7))).alias("q")).first()["q"]
    if not cut:
        return spark.createDataFrame([], "instrument string, d date, p double, sure boolean")
    day = F.datediff("d", F.lit("1970-01-01").cast("date"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["mom", "vol", "z", "dd"], outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(regParam=0.01)]).fit(data.filter(day <= cut[0]))
    scored = model.transform(data.filter(day > cut[0])).withColumn("p", vector_to_array("probability")[1])
    # Split conformal: the k-th least nonconformity of the calibration days.
    wrong = F.abs(F.col("label") - F.col("p"))
    bound = scored.filter(day <= cut[1]).agg(F.percentile(wrong, F.lit(0.9)).alias("q")).first()["q"]
    return scored.filter(day > cut[1]).select("instrument", "d", F.round("p", 4).alias("p"), (F.abs(1 - F.col("p")) <= (bound if bound is not None else 1.0)).alias("sure"))


def x8_event_veto(spark, sf_dir):
    """Orders at most one day before or two after a day of heavy shipping: looked up by as-of in both directions."""
    heavy = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("q")).filter("q > 800").select(F.lit(1).alias("k"), "d", F.col("d").alias("heavy"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    # Few days, one per date: joined to the days of the orders, not to the orders.
    days = o.select(F.lit(1).alias("k"), "d").distinct()
    both = alignment.asof(days, heavy, "k", "d", ["heavy"]).withColumnRenamed("heavy", "past")
    both = alignment.asof(both, heavy, "k", "d", ["heavy"], forward=True)
    veto = (F.coalesce(F.datediff("d", "past"), F.lit(99)) <= 2) | (F.coalesce(F.datediff("heavy", "d"), F.lit(99)) <= 1)
    return o.join(both.select("d", veto.alias("veto")), "d").groupBy("veto").agg(F.count("*").alias("n"))


_MOM = f"CASE WHEN count(r) OVER {_t(21)} = 21 THEN sum(r) OVER {_t(21)} END / nullif(stddev_samp(r) OVER {_t(21)} * sqrt(21), 0)"
_PRIOR = lambda f, x, n: f"CASE WHEN count({x}) OVER (PARTITION BY instrument ORDER BY d ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN {f}({x}) OVER (PARTITION BY instrument ORDER BY d ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
_BAR = lambda up, down, n: f"x AS (SELECT *, row_number() OVER {_ORD} AS i, count(*) OVER (PARTITION BY instrument) AS n FROM day_bars), y AS (SELECT a.instrument, a.d, b.i - a.i AS k, CASE WHEN b.l <= a.c * {down} THEN 0 WHEN b.h >= a.c * {up} THEN 1 END AS hit FROM x a JOIN x b ON a.instrument = b.instrument AND b.i BETWEEN a.i + 1 AND a.i + {n} WHERE a.i + {n} <= a.n), z AS (SELECT instrument, d, min_by(hit, k) AS label FROM y WHERE hit IS NOT NULL GROUP BY 1, 2)"
_BIG = "big AS (SELECT o_orderkey AS event, o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice > 400000)"
_P = {
    "fvg_up": "l > lag(h, 2) OVER w", "fvg_down": "h < lag(l, 2) OVER w",
    "engulf_up": "c > o AND lag(c) OVER w < lag(o) OVER w AND c >= lag(o) OVER w AND o <= lag(c) OVER w",
    "engulf_down": "c < o AND lag(c) OVER w > lag(o) OVER w AND c <= lag(o) OVER w AND o >= lag(c) OVER w",
    "pin_up": "least(o, c) - l > 2 * abs(c - o) AND h - greatest(o, c) < abs(c - o) AND abs(c - o) > 0",
    "pin_down": "h - greatest(o, c) > 2 * abs(c - o) AND least(o, c) - l < abs(c - o) AND abs(c - o) > 0",
    "break_up": f"c > {_PRIOR('max', 'h', 10)}", "break_down": f"c < {_PRIOR('min', 'l', 10)}",
}
ORACLE_SQL = {
    "g13_fix_hour": "WITH e AS (SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS local FROM events), x AS (SELECT event_type, CAST(local AS DATE) AS d, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b, count(*) AS n FROM e WHERE hour(local) = 15 GROUP BY 1, 2) SELECT event_type, d, n, CAST(-sign(b - a) AS INTEGER) AS signal FROM x",
    "g2_weekly_gate": f"WITH {BARS}, k AS (SELECT instrument, date_trunc('week', d) AS week, max_by(c, d) AS wc FROM day_bars GROUP BY 1, 2), s AS (SELECT instrument, week, CASE WHEN count(wc) OVER p = 4 THEN sum(wc) OVER p END AS s FROM k WINDOW p AS (PARTITION BY instrument ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) SELECT b.instrument, b.d, round((s + c) / 5, 6) AS ma, c > (s + c) / 5 AS above FROM day_bars b JOIN s ON b.instrument = s.instrument AND date_trunc('week', b.d) = s.week",
    "g7_ensemble": f"WITH {BARS}, x AS (SELECT *, {_PRIOR('max', 'h', 20)} AS hi, {_PRIOR('min', 'l', 20)} AS lo, CASE WHEN count(c) OVER {_t(20)} = 20 THEN avg(c) OVER {_t(20)} END AS m, CASE WHEN count(c) OVER {_t(20)} = 20 THEN stddev_samp(c) OVER {_t(20)} END AS s, c / lag(c, 21) OVER {_ORD} - 1 AS mom FROM day_bars), v AS (SELECT instrument, d, CAST(coalesce(sign(mom), 0) + CASE WHEN c > hi THEN 1 WHEN c < lo THEN -1 ELSE 0 END + CASE WHEN c < m - s THEN 1 WHEN c > m + s THEN -1 ELSE 0 END AS INT) AS votes FROM x) SELECT *, CASE WHEN votes >= 2 THEN 1 WHEN votes <= -2 THEN -1 ELSE 0 END AS signal FROM v",
    "g9_residual_momentum": f"WITH {BARS}, r AS (SELECT instrument, d, ln(c / lag(c) OVER {_ORD}) / 100 AS r FROM day_bars), x AS (SELECT *, avg(r) OVER (PARTITION BY d) AS m FROM r WHERE r IS NOT NULL), b AS (SELECT *, r - m * CASE WHEN count(r) OVER {_t(60)} = 60 THEN covar_samp(r, m) OVER {_t(60)} / nullif(var_samp(m) OVER {_t(60)}, 0) END AS e FROM x), s AS (SELECT instrument, d, round(CASE WHEN count(e) OVER {_t(20)} = 20 THEN avg(e) OVER {_t(20)} END / nullif(stddev_samp(e) OVER {_t(20)}, 0), 9) AS score FROM b) SELECT instrument, d, k, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, instrument) AS k FROM s WHERE score IS NOT NULL) WHERE k <= 2",
    "g10_reversal": f"WITH {BARS}, x AS (SELECT *, c / lag(c, 5) OVER {_ORD} - 1 AS r5 FROM day_bars), y AS (SELECT *, (r5 - avg(r5) OVER (PARTITION BY d)) / nullif(stddev_samp(r5) OVER (PARTITION BY d), 0) AS z, row_number() OVER (PARTITION BY d ORDER BY r5, instrument) AS k FROM x WHERE r5 IS NOT NULL) SELECT instrument, d, round(z, 6) AS z FROM y WHERE k = 1 AND z < -1 AND v >= 2",
    "g11_event_drift": f"WITH {BARS}, {_BIG}, x AS (SELECT instrument, d, lag(c) OVER {_ORD} AS p, lead(c) OVER {_ORD} AS n FROM day_bars) SELECT event, x.d AS at, round(n / p - 1, 6) AS announced FROM big ASOF LEFT JOIN x ON big.instrument = x.instrument AND big.d <= x.d",
    "g12_extreme_hold": f"WITH {BARS}, x AS (SELECT *, row_number() OVER {_ORD} AS i, CASE WHEN count(c) OVER {_t(156)} >= 52 THEN (c - avg(c) OVER {_t(156)}) / nullif(stddev_pop(c) OVER {_t(156)}, 0) END AS z FROM day_bars), y AS (SELECT *, last_value(CASE WHEN abs(z) >= 1.5 THEN i END IGNORE NULLS) OVER {_ORD} AS li, last_value(CASE WHEN abs(z) >= 1.5 THEN CAST(-sign(z) AS INT) END IGNORE NULLS) OVER {_ORD} AS ls FROM x) SELECT instrument, d, CASE WHEN i - li < 10 THEN ls ELSE 0 END AS signal FROM y",
    "g14_close_momentum": f"WITH {BARS}, x AS (SELECT *, h - l AS x FROM day_bars), y AS (SELECT *, CASE WHEN count(x) OVER p = 10 THEN quantile_cont(x, 0.5) OVER p END AS median FROM x WINDOW p AS (PARTITION BY instrument ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT instrument, d, round(median, 6) AS median, x > median AS wide FROM y",
    "g19_blackout": f"WITH {BARS}, {_BIG}, n AS (SELECT *, row_number() OVER {_ORD} AS i FROM day_bars), p AS (SELECT big.instrument, n.i FROM big ASOF JOIN n ON big.instrument = n.instrument AND big.d <= n.d) SELECT instrument, d, c FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.instrument = n.instrument AND n.i BETWEEN p.i - 2 AND p.i + 2)",
    "g25_patterns": f"WITH {BARS} SELECT instrument, d, pattern FROM (SELECT instrument, d, unnest(list_filter([{', '.join(f'CASE WHEN {x} THEN {chr(39)}{k}{chr(39)} END' for k, x in _P.items())}], lambda x: x IS NOT NULL)) AS pattern FROM day_bars WINDOW w AS {_ORD})",
    "t2_window_outcome": f"WITH {BARS}, {_BAR(1.3, 0.7, 15)}, s AS (SELECT *, {_PRIOR('max', 'h', 20)} AS hi FROM day_bars) SELECT s.instrument, count(*) AS n, count(*) FILTER (label = 1) AS tp, count(*) FILTER (label = 0) AS sl, count(*) FILTER (label IS NULL) AS pending FROM s LEFT JOIN z ON s.instrument = z.instrument AND s.d = z.d WHERE s.c > hi GROUP BY 1",
    "t22_decayed_win_rate": "WITH t AS (SELECT l_suppkey, power(0.99, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) - 1) AS w, CAST(l_discount > 0.05 AS DOUBLE) AS win FROM lineitem), s AS (SELECT l_suppkey, 1 + sum(w * win) AS a, 1 + sum(w * (1 - win)) AS b FROM t GROUP BY 1) SELECT l_suppkey, round(a / (a + b), 6) AS mean, round(greatest(0, a / (a + b) - sqrt(a * b / (power(a + b, 2) * (a + b + 1)))), 6) AS lower FROM s",
    "v11_walk_forward": f"WITH {BARS}, x AS (SELECT *, ln(c / lag(c) OVER {_ORD}) / 100 AS r, row_number() OVER {_ORD} AS i, count(*) OVER (PARTITION BY instrument) AS n FROM day_bars), y AS (SELECT *, sign(CASE WHEN count(r) OVER {_t(21)} = 21 THEN avg(r) OVER {_t(21)} END) * lead(r) OVER {_ORD} AS x FROM x) SELECT instrument, CASE WHEN i <= 0.7 * n THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(x), 6) AS mean, round(avg(x) / stddev_samp(x), 6) AS sharpe FROM y WHERE x IS NOT NULL GROUP BY 1, 2",
    "m3_dataset": f"WITH {BARS}, {_BAR(1.4, 0.6, 10)}, f AS (SELECT *, ln(c / lag(c) OVER {_ORD}) AS r FROM day_bars), g AS (SELECT *, {_MOM} AS mom, CASE WHEN count(r) OVER {_t(20)} = 20 THEN stddev_samp(r) OVER {_t(20)} END AS vol, CASE WHEN count(c) OVER {_t(50)} >= 20 THEN (c - avg(c) OVER {_t(50)}) / nullif(stddev_pop(c) OVER {_t(50)}, 0) END AS z, c / max(c) OVER {_ORD} - 1 AS dd FROM f) SELECT g.instrument, g.d, z.label, round(mom, 6) AS mom, round(vol, 6) AS vol, round(g.z, 6) AS z, round(dd, 6) AS dd FROM g JOIN z ON g.instrument = z.instrument AND g.d = z.d WHERE mom IS NOT NULL",
    "x8_event_veto": "WITH h AS (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 800), o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT EXISTS (SELECT 1 FROM h WHERE datediff('day', h.d, o.d) BETWEEN -1 AND 2) AS veto, count(*) AS n FROM o GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (g2_weekly_gate, g7_ensemble, g9_residual_momentum, g10_reversal, g11_event_drift, g12_extreme_hold, g13_fix_hour, g14_close_momentum, g19_blackout, g25_patterns, t2_window_outcome, t22_decayed_win_rate, t10_portfolio, v15_best_books, v11_walk_forward, m3_dataset, m4_meta_label, x8_event_veto)}
