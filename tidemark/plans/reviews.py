"""Queries that review setups and runs: scoreboards, drifts, lessons, searches. Their frame is that of the desk's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import desk as dk
from tidemark.plans import desk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: What the setups need besides: a reward ratio that may be missing, a result, checks in their order, a lesson.
_MORE = {
    "rr": "CASE w % 4 WHEN 0 THEN NULL ELSE 1 + (m % 9) / 4e0 END",
    "pnl": "(mark - px) * (CASE m % 2 WHEN 0 THEN 1 ELSE -1 END)",
    "open": "w % 4 = 0",
    "lesson": "CASE w % 3 WHEN 0 THEN NULL ELSE concat('lesson ', CAST(m AS STRING)) END",
    "checked": desk.pick("w", ["confirmed", "weakening", "invalidated", None]),
    "run": "m % 37",
    "stale": "w % 6 = 0",
}
SQL = desk.SETUPS_SQL.replace("setups AS (SELECT *,", "first_setups AS (SELECT *,", 1) + f", setups AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in _MORE.items())} FROM first_setups)"
WON, LOST = "outcome = 'tp_hit'", "outcome = 'sl_hit'"


def setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.setups(spark, sf_dir).selectExpr("*", *[f"{x} AS {k}" for k, x in _MORE.items()])


def _query(name: str, sql: str):
    """Registers a function of the setups under a name, with its SQL (over setups)."""

    def keep(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(setups(spark, sf_dir))
            return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])

        QUERIES[name] = query
        ORACLE_SQL[name] = f"WITH {SQL} {sql}"
        return build

    return keep


def _share(test: str) -> Column:
    return F.avg(F.expr(test).cast("double"))


def _n(test: str) -> Column:
    return F.count_if(F.expr(test))


R_RESULT = f"CASE WHEN {WON} THEN coalesce(rr, 1) WHEN {LOST} THEN -1 END"


@_query("a10_signal_power", "SELECT label, round(avg(lift), 6) AS lift, count(*) AS runs, CAST(sum(n) AS BIGINT) AS samples FROM (SELECT run, label, avg(CAST(pnl > 0 AS DOUBLE)) FILTER (s) - avg(CAST(pnl > 0 AS DOUBLE)) FILTER (NOT s) AS lift, count(*) AS n FROM (SELECT run, pnl, unnest(['early', 'large', 'long']) AS label, unnest([w % 2 = 0, px > 200, verdict IN ('BUY', 'STRONG BUY') IS TRUE]) AS s FROM setups) GROUP BY 1, 2 HAVING count(*) >= 30) WHERE lift IS NOT NULL GROUP BY 1")
def a10(df: DataFrame) -> DataFrame:
    """Mean lift of each label over the runs with at least 30 trades; the lifts of a run are one map."""
    labels = {"early": "w % 2 = 0", "large": "px > 200", "long": "coalesce(verdict IN ('BUY', 'STRONG BUY'), false)"}
    won = F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)
    lift = {k: F.avg(F.when(F.expr(x), won)) - F.avg(F.when(~F.expr(x), won)) for k, x in labels.items()}
    runs = df.groupBy("run").agg(F.count("*").alias("n"), F.create_map(*[y for k, x in lift.items() for y in (F.lit(k), x)]).alias("lifts")).filter("n >= 30")
    power = runs.select("n", F.explode("lifts").alias("label", "lift")).filter("lift IS NOT NULL")
    return power.groupBy("label").agg(F.avg("lift").alias("lift"), F.count("*").alias("runs"), F.sum("n").alias("samples"))


@_query("a11_threshold_sweep", f"SELECT threshold, round(avg(e), 6) AS expectancy, round(avg(n), 6) AS trades, count(*) AS runs FROM (SELECT run, threshold, avg({R_RESULT}) AS e, CAST(count(*) AS DOUBLE) AS n FROM setups, (SELECT unnest([55, 60, 65, 70, 75, 80]) AS threshold) WHERE conf >= threshold AND outcome IN ('tp_hit', 'sl_hit') GROUP BY 1, 2) GROUP BY 1")
def a11(df: DataFrame) -> DataFrame:
    decided = df.filter("outcome IN ('tp_hit', 'sl_hit')").withColumn("r", F.expr(R_RESULT))
    met = decided.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(x) for x in (55, 60, 65, 70, 75, 80)]), lambda x: x <= F.col("conf"))))
    runs = met.groupBy("run", "threshold").agg(F.avg("r").alias("e"), F.count("*").cast("double").alias("n"))
    return runs.groupBy("threshold").agg(F.avg("e").alias("expectancy"), F.avg("n").alias("trades"), F.count("*").alias("runs"))


@_query("a14_profitability", f"SELECT span, count(*) AS n, count(*) FILTER ({WON}) AS wins, CAST(floor(100.0 * count(*) FILTER ({WON}) / count(*) + 0.5) AS BIGINT) AS rate, round(avg(rr), 6) AS rr, round(avg({R_RESULT}), 6) AS expectancy, round(sum({R_RESULT}), 6) AS total FROM (SELECT *, unnest(CASE WHEN ts >= TIMESTAMP '1998-01-01' THEN ['all', 'late'] ELSE ['all'] END) AS span FROM setups WHERE outcome IN ('tp_hit', 'sl_hit')) GROUP BY 1")
def a14(df: DataFrame) -> DataFrame:
    late = F.col("ts") >= F.lit("1998-01-01").cast("timestamp_ntz")
    spans = df.filter("outcome IN ('tp_hit', 'sl_hit')").withColumns({"r": F.expr(R_RESULT), "span": F.explode(F.when(late, F.array(F.lit("all"), F.lit("late"))).otherwise(F.array(F.lit("all"))))})
    rate = dk.whole(100 * _n(WON) / F.count("*"))
    return spans.groupBy("span").agg(F.count("*").alias("n"), _n(WON).alias("wins"), rate.alias("rate"), F.avg("rr").alias("rr"), F.avg("r").alias("expectancy"), F.sum("r").alias("total"))


@_query("a15_check_reliability", f"SELECT checked AS last, count(*) AS n, CAST(floor(100.0 * count(*) FILTER ({LOST}) / count(*) + 0.5) AS BIGINT) AS stopped, CAST(floor(100.0 * count(*) FILTER ({WON}) / count(*) + 0.5) AS BIGINT) AS reached FROM setups WHERE outcome IN ('tp_hit', 'sl_hit') AND checked IS NOT NULL GROUP BY 1")
def a15(df: DataFrame) -> DataFrame:
    """By the last of a row's checks, how often it went to the stop and to the target."""
    checks = F.array_compact(F.array(F.lit("activated"), F.col("checked")))
    last = df.filter("outcome IN ('tp_hit', 'sl_hit')").withColumn("last", F.element_at(checks, -1)).filter("last <> 'activated'")
    return last.groupBy("last").agg(F.count("*").alias("n"), dk.whole(100 * _n(LOST) / F.count("*")).alias("stopped"), dk.whole(100 * _n(WON) / F.count("*")).alias("reached"))


_LEARN = "outcome IN ('tp_hit', 'sl_hit', 'managed')"


@_query("a16_lessons", f"SELECT kind, timeframe, count(*) AS n, count(*) FILTER ({WON}) AS wins, count(*) FILTER ({LOST}) AS losses, count(*) FILTER (outcome = 'managed') AS unclear, round(sum(CASE WHEN {WON} THEN coalesce(rr, 2) WHEN {LOST} THEN -1 END), 6) AS r, arg_max(lesson, (ts, id)) FILTER (lesson IS NOT NULL) AS lesson FROM setups WHERE {_LEARN} GROUP BY 1, 2")
def a16(df: DataFrame) -> DataFrame:
    """Setups of one kind: results, and the newest lesson."""
    r = F.expr(f"CASE WHEN {WON} THEN coalesce(rr, 2) WHEN {LOST} THEN -1 END")
    newest = F.max(F.when(F.col("lesson").isNotNull(), F.struct("ts", "id", "lesson")))["lesson"]
    return df.filter(_LEARN).groupBy("kind", "timeframe").agg(F.count("*").alias("n"), _n(WON).alias("wins"), _n(LOST).alias("losses"), _n("outcome = 'managed'").alias("unclear"), F.sum(r).alias("r"), newest.alias("lesson"))


@_query("a17_symbol_record", f"SELECT id, count(*) FILTER (outcome IN ('tp_hit', 'sl_hit')) OVER s AS resolved, count(*) FILTER ({WON}) OVER s AS wins FROM setups WINDOW s AS (PARTITION BY symbol)")
def a17(df: DataFrame) -> DataFrame:
    """Every setup with the record of its symbol: counted first, then joined, so that no symbol is one task."""
    record = df.groupBy("symbol").agg(_n("outcome IN ('tp_hit', 'sl_hit')").alias("resolved"), _n(WON).alias("wins"))
    return df.select("id", "symbol").join(record, "symbol").drop("symbol")


@_query("a22_fill_divergence", "SELECT symbol, count(*) AS n, round(avg(abs(mark / px - 1)) * 10000, 6) AS bps, max(c) AS modelled, coalesce(avg(abs(mark / px - 1)) * 10000 > 200 * max(c), false) AS flagged FROM setups LEFT JOIN (VALUES ('equity', 2.0::DOUBLE), ('crypto', 1.25::DOUBLE)) costs(k, c) ON k = kind WHERE NOT open GROUP BY 1")
def a22(df: DataFrame) -> DataFrame:
    """Mean absolute divergence of a symbol's fills against what its class is modelled to cost."""
    costs = df.sparkSession.createDataFrame([("equity", 2.0), ("crypto", 1.25)], "kind string, c double")
    fills = df.filter("NOT open").join(F.broadcast(costs), "kind", "left").groupBy("symbol").agg(F.count("*").alias("n"), (F.avg(F.abs(F.col("mark") / F.col("px") - 1)) * 10000).alias("bps"), F.max("c").alias("modelled"))
    return fills.withColumn("flagged", F.coalesce(F.col("bps") > 200 * F.col("modelled"), F.lit(False)))


@_query("a23_outcome_drift", f"SELECT symbol, n, CASE WHEN n >= 20 THEN round(rate, 6) END AS rate, CASE WHEN n >= 20 THEN abs(rate - 0.558) > 0.15 END AS drift FROM (SELECT symbol, count(*) AS n, avg(CAST({WON} AS DOUBLE)) AS rate FROM setups WHERE outcome IN ('tp_hit', 'sl_hit') GROUP BY 1)")
def a23(df: DataFrame) -> DataFrame:
    got = df.filter("outcome IN ('tp_hit', 'sl_hit')").groupBy("symbol").agg(F.count("*").alias("n"), _share(WON).alias("rate"))
    return got.select("symbol", "n", F.when(F.col("n") >= 20, F.col("rate")).alias("rate"), F.when(F.col("n") >= 20, F.abs(F.col("rate") - 0.558) > 0.15).alias("drift"))


_SIDE = "CASE m % 2 WHEN 0 THEN 'long' ELSE 'short' END"


@_query("a26_bucket_attribution", f"SELECT kind, side, count(*) AS n, round(sum(pnl), 4) AS net, round(sum(abs(pnl)), 4) AS gross FROM (SELECT *, {_SIDE} AS side FROM setups) GROUP BY GROUPING SETS ((kind, side), (kind), (side), ())")
def a26(df: DataFrame) -> DataFrame:
    sides = df.withColumn("side", F.expr(_SIDE))
    sets = sides.groupingSets([[F.col("kind"), F.col("side")], [F.col("kind")], [F.col("side")], []], "kind", "side")
    return sets.agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("net"), F.round(F.sum(F.abs("pnl")), 4).alias("gross"))


@_query("a31_counterfactual", "SELECT CAST(year(ts) AS INTEGER) AS year, round(sum(pnl), 4) AS net, round(sum(pnl) FILTER (NOT (kind = 'equity' AND m % 2 = 1)), 4) AS no_shares_short, round(sum(pnl) FILTER (m % 2 = 1), 4) AS shorts FROM setups GROUP BY 1")
def a31(df: DataFrame) -> DataFrame:
    def net(test: str) -> Column:
        return F.round(F.sum(F.when(F.expr(test), F.col("pnl"))), 4)

    return df.groupBy(F.year("ts").alias("year")).agg(net("true").alias("net"), net("NOT (kind = 'equity' AND m % 2 = 1)").alias("no_shares_short"), net("m % 2 = 1").alias("shorts"))


@_query("a32_exit_decomposition", "SELECT coalesce(outcome, 'open') AS reason, count(*) AS n, round(avg(pnl), 6) AS mean, round(sum(pnl) FILTER (pnl > 0), 4) AS won, round(sum(pnl) FILTER (pnl < 0), 4) AS lost FROM setups GROUP BY 1")
def a32(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("outcome", F.lit("open")).alias("reason")).agg(F.count("*").alias("n"), F.avg("pnl").alias("mean"), F.round(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), 4).alias("won"), F.round(F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))), 4).alias("lost"))


@_query("a37_knowledge_base", "SELECT kind, count(*) AS n, count(*) FILTER (w % 3 = 0) AS passed, round(count(*) FILTER (w % 3 = 0) * 1.0 / count(*), 2) AS rate, arg_max(id, (rr, id)) FILTER (rr IS NOT NULL) AS best FROM setups GROUP BY 1")
def a37(df: DataFrame) -> DataFrame:
    best = F.max(F.when(F.col("rr").isNotNull(), F.struct("rr", "id")))["id"]
    return df.groupBy("kind").agg(F.count("*").alias("n"), _n("w % 3 = 0").alias("passed"), F.round(_share("w % 3 = 0"), 2).alias("rate"), best.alias("best"))


@_query("a38_latest_run", "SELECT run, n, round(best, 6) AS best FROM (SELECT run, max(ts) AS newest, count(*) AS n, max(pnl) AS best FROM setups WHERE conf >= 70 GROUP BY 1 HAVING count(*) >= 6) ORDER BY newest DESC, run DESC LIMIT 1")
def a38(df: DataFrame) -> DataFrame:
    """The newest run with six rows that qualify."""
    runs = df.filter("conf >= 70").groupBy("run").agg(F.max("ts").alias("newest"), F.count("*").alias("n"), F.max("pnl").alias("best")).filter("n >= 6")
    return runs.orderBy(F.desc("newest"), F.desc("run")).limit(1).select("run", "n", "best")


@_query("a40_execution_summary", "SELECT kind, stale, count(*) AS n, round(avg(mark / px - 1) * 10000, 6) AS bps, round(max(abs(mark / px - 1)) * 10000, 6) AS worst FROM setups WHERE NOT open GROUP BY 1, 2")
def a40(df: DataFrame) -> DataFrame:
    bps = (F.col("mark") / F.col("px") - 1) * 10000
    return df.filter("NOT open").groupBy("kind", "stale").agg(F.count("*").alias("n"), F.avg(bps).alias("bps"), F.max(F.abs(bps)).alias("worst"))


_VALID = "(stop < px AND target > px OR stop > px AND target < px)"


@_query("a49_broker_scoreboard", f"SELECT kind, round(100.0 * count(*) FILTER (NOT open AND pnl > 0) / count(*) FILTER (NOT open), 6) AS realised, round(100.0 * count(*) FILTER (pnl > 0) / count(*), 6) AS projected, round(sum(pnl) FILTER (NOT open), 4) AS booked, round(sum(pnl) FILTER (open), 4) AS floating, round(avg(abs(target - px) / abs(px - stop)) FILTER ({_VALID}), 6) AS rr FROM setups GROUP BY 1")
def a49(df: DataFrame) -> DataFrame:
    """Win rates with and without the winners that are still open; the reward ratio where stop and target are on different sides."""
    closed, floating = (F.round(F.sum(F.when(F.expr(x), F.col("pnl"))), 4) for x in ("NOT open", "open"))
    realised = 100 * _n("NOT open AND pnl > 0") / _n("NOT open")
    ratio = F.avg(F.when(F.expr(_VALID), F.abs(F.col("target") - F.col("px")) / F.abs(F.col("px") - F.col("stop"))))
    return df.groupBy("kind").agg(realised.alias("realised"), (100 * _share("pnl > 0")).alias("projected"), closed.alias("booked"), floating.alias("floating"), ratio.alias("rr"))


@_query("a50_headline", f"SELECT count(*) AS n, CAST(floor(100.0 * count(*) FILTER ({WON}) / count(*) + 0.5) AS BIGINT) AS rate, round(avg(CASE WHEN {WON} THEN 1.5 ELSE -1 END), 2) AS expectancy FROM setups WHERE outcome IN ('tp_hit', 'sl_hit')")
def a50(df: DataFrame) -> DataFrame:
    flat = F.avg(F.when(F.expr(WON), 1.5).otherwise(-1.0))
    return df.filter("outcome IN ('tp_hit', 'sl_hit')").agg(F.count("*").alias("n"), dk.whole(100 * _n(WON) / F.count("*")).alias("rate"), F.round(flat, 2).alias("expectancy"))


@_query("a51_book_stats", "SELECT kind, count(*) FILTER (open) AS n_open, round(sum(abs(mark * conf)) FILTER (open), 4) AS gross, round(sum(abs(mark * conf)) FILTER (open) / 1000000, 6) AS times, round(sum(pnl) FILTER (open), 4) AS unrealised, round(100.0 * count(*) FILTER (NOT open AND pnl > 0) / count(*) FILTER (NOT open), 6) AS rate, round(sum(pnl) FILTER (NOT open), 4) AS realised FROM setups GROUP BY 1")
def a51(df: DataFrame) -> DataFrame:
    gross = F.sum(F.when(F.col("open"), F.abs(F.col("mark") * F.col("conf"))))
    sums = [F.round(F.sum(F.when(F.expr(x), F.col("pnl"))), 4) for x in ("open", "NOT open")]
    return df.groupBy("kind").agg(_n("open").alias("n_open"), F.round(gross, 4).alias("gross"), (gross / 1000000).alias("times"), sums[0].alias("unrealised"), (100 * _n("NOT open AND pnl > 0") / _n("NOT open")).alias("rate"), sums[1].alias("realised"))


@_query("a53_distribution", "SELECT kind, round(avg(pnl), 6) AS mean, " + ", ".join(f"round(quantile_cont(pnl, {p}), 6) AS p{int(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", round(avg(CAST(pnl < 0 AS DOUBLE)), 6) AS losing FROM setups GROUP BY 1")
def a53(df: DataFrame) -> DataFrame:
    return df.groupBy("kind").agg(F.avg("pnl").alias("mean"), *[F.percentile("pnl", F.lit(p)).alias(f"p{int(p * 100):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)], _share("pnl < 0").alias("losing"))


_TO = "CASE WHEN verdict IN ('BUY', 'STRONG BUY') THEN 'long' WHEN verdict IN ('SELL', 'SHORT') THEN 'short' ELSE 'neutral' END"


@_query("m8_verdict_ensemble", f"SELECT run, n, direction, agree, CAST(CASE WHEN agree <= n / 2 OR direction = 'neutral' THEN least(shaded, 50) ELSE shaded END AS BIGINT) AS conf FROM (SELECT run, n, direction, agree, CASE WHEN agree < n THEN floor(mid * (0.6 + 0.4 * agree / n) + 0.5) ELSE mid END AS shaded FROM (SELECT run, sum(k) AS n, arg_max(direction, (k, direction)) AS direction, max(k) AS agree FROM (SELECT run, {_TO} AS direction, count(*) AS k FROM setups GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT run, floor(median(conf) + 0.5) AS mid FROM setups GROUP BY 1) USING (run))")
def m8(df: DataFrame) -> DataFrame:
    """The direction of most verdicts of a run, and their median confidence, less where some disagree."""
    votes = df.groupBy("run", F.expr(_TO).alias("direction")).agg(F.count("*").alias("k"))
    most = votes.groupBy("run").agg(F.sum("k").alias("n"), F.max(F.struct("k", "direction")).alias("_m")).select("run", "n", F.col("_m.direction").alias("direction"), F.col("_m.k").alias("agree"))
    both = most.join(df.groupBy("run").agg(dk.whole(F.percentile("conf", F.lit(0.5))).alias("mid")), "run")
    shaded = F.when(F.col("agree") < F.col("n"), dk.whole(F.col("mid") * (0.6 + 0.4 * F.col("agree") / F.col("n")))).otherwise(F.col("mid"))
    return both.select("run", "n", "direction", "agree", F.when((F.col("agree") <= F.col("n") / 2) | (F.col("direction") == "neutral"), F.least(shaded, F.lit(50))).otherwise(shaded).cast("bigint").alias("conf"))


_KEYS = ("eur", "usd", "lesson 1", "9")


@_query("s19_relevance", "SELECT id, score FROM (SELECT id, ts, " + " + ".join(f"CAST(contains(lower(concat_ws(' ', symbol, lesson)), '{k}') AS BIGINT)" for k in _KEYS) + " AS score FROM setups) ORDER BY score DESC, ts DESC, id LIMIT 20")
def s19(df: DataFrame) -> DataFrame:
    """The twenty rows that hold most of the keywords, the newest first."""
    text = F.lower(F.concat_ws(" ", "symbol", "lesson"))
    score = F.aggregate(F.array(*[F.lit(k) for k in _KEYS]), F.lit(0).cast("bigint"), lambda n, k: n + F.contains(text, k).cast("bigint"))
    return df.select("id", "ts", score.alias("score")).orderBy(F.desc("score"), F.desc("ts"), "id").limit(20).select("id", "score")


@_query("s20_symbol_search", "SELECT symbol, min(first) AS first FROM (SELECT symbol, min(id) AS first FROM setups WHERE contains(upper(symbol), 'US') OR contains(upper(timeframe), 'US') GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('USO', -1), ('EUR/USD', -2)) remote(symbol, first)) GROUP BY 1 ORDER BY 1 LIMIT 10")
def s20(df: DataFrame) -> DataFrame:
    """Symbols by a part of one of two columns, with those of another source, each once."""
    own = df.filter(F.contains(F.upper("symbol"), F.lit("US")) | F.contains(F.upper("timeframe"), F.lit("US"))).groupBy("symbol").agg(F.min("id").alias("first"))
    remote = df.sparkSession.createDataFrame([("USO", -1), ("EUR/USD", -2)], "symbol string, first bigint")
    return own.unionByName(remote).groupBy("symbol").agg(F.min("first").alias("first")).orderBy("symbol").limit(10)


@_query("s23_feed_lag", "SELECT symbol, CAST(floor((epoch(TIMESTAMP '2000-01-01') - epoch(max(ts))) / 60) AS BIGINT) AS minutes FROM setups GROUP BY 1")
def s23(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.timestamp_diff("MINUTE", F.max("ts"), F.lit("2000-01-01").cast("timestamp_ntz")).alias("minutes"))


@_query("r14_weighted_sample", "SELECT id FROM setups ORDER BY -ln((m + 0.5) / 1000003.0) * (w % 7 + 1), id LIMIT 25")
def r14(df: DataFrame) -> DataFrame:
    """Twenty-five rows without replacement, of weight 1 / (times seen + 1): the least of exponential keys."""
    u = (F.col("m") + 0.5) / 1000003.0
    return df.orderBy(-F.log(u) * (F.col("w") % 7 + 1), "id").limit(25).select("id")


@_query("r18_padded", "SELECT id FROM setups ORDER BY CASE WHEN symbol LIKE '%/%' AND m % 2 = 0 AND m % 4001 = 0 THEN 0 ELSE 1 END, ts DESC, id LIMIT 8")
def r18(df: DataFrame) -> DataFrame:
    """What matches, then others up to the limit."""
    return df.orderBy(F.expr("symbol LIKE '%/%' AND m % 2 = 0 AND m % 4001 = 0").desc(), F.desc("ts"), "id").limit(8).select("id")


@_query("j16_fill_lookup", "SELECT s.id, coalesce(f.near, f.first) AS fill FROM setups s LEFT JOIN (SELECT run, min(CASE WHEN conf > 90 THEN id END) AS near, min(id) AS first FROM setups WHERE open GROUP BY 1) f ON f.run = s.run WHERE NOT s.open")
def j16(df: DataFrame) -> DataFrame:
    """Closed setups with the first near fill of their run, else the first of all."""
    fills = df.filter("open").groupBy("run").agg(F.min(F.when(F.col("conf") > 90, F.col("id"))).alias("near"), F.min("id").alias("first"))
    return df.filter("NOT open").join(fills, "run", "left").select("id", F.coalesce("near", "first").alias("fill"))


@_query("j22_staleness", "SELECT symbol, max(ts) AS last FROM setups GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM setups)")
def j22(df: DataFrame) -> DataFrame:
    """Symbols whose last row is older than the last of all."""
    last = df.groupBy("symbol").agg(F.max("ts").alias("last"))
    return last.join(F.broadcast(last.agg(F.max("last").alias("_newest"))), F.col("last") < F.col("_newest")).drop("_newest")


@_query("f24_next_event", "SELECT symbol, min(CAST(ts AS DATE)) FILTER (ts >= TIMESTAMP '1998-06-01') AS next, datediff('day', DATE '1998-06-01', min(CAST(ts AS DATE)) FILTER (ts >= TIMESTAMP '1998-06-01')) AS days FROM setups GROUP BY 1")
def f24(df: DataFrame) -> DataFrame:
    today = F.lit("1998-06-01").cast("date")
    coming = F.min(F.when(F.to_date("ts") >= today, F.to_date("ts")))
    return df.groupBy("symbol").agg(coming.alias("next"), F.datediff(coming, today).cast("bigint").alias("days"))


@_query("f32_open_interest", "SELECT symbol, round((arg_max(px, (ts, id)) - arg_min(px, (ts, id))) / arg_min(px, (ts, id)) * 100, 1) AS change, CAST(floor(100.0 * count(*) FILTER (m % 2 = 0) / count(*) + 0.5) AS BIGINT) AS long FROM setups GROUP BY 1")
def f32(df: DataFrame) -> DataFrame:
    first, last = F.min_by("px", F.struct("ts", "id")), F.max_by("px", F.struct("ts", "id"))
    return df.groupBy("symbol").agg(F.round((last - first) / first * 100, 1).alias("change"), dk.whole(100 * _n("m % 2 = 0") / F.count("*")).alias("long"))


@_query("k5_flat_report", "SELECT id, round(px, 6) AS sharpe, rr AS ratio, outcome = 'tp_hit' AS passed FROM setups")
def k5(df: DataFrame) -> DataFrame:
    """Rows of nested reports."""
    nested = df.select("id", F.struct(F.struct(F.col("px").alias("sharpe"), F.col("rr").alias("ratio")).alias("stats"), (F.col("outcome") == "tp_hit").alias("passed")).alias("report"))
    return nested.select("id", "report.stats.*", "report.passed")


@_query("m5_conformal", f"SELECT kind, round(max(q) FILTER (i = least(n, ceil((n + 1) * 0.9))), 6) AS q FROM (SELECT kind, q, row_number() OVER (PARTITION BY kind ORDER BY q, id) AS i, count(*) OVER (PARTITION BY kind) AS n FROM (SELECT kind, id, abs(CAST({WON} AS INTEGER) - (conf * 0.997 + 0.00001 * m) / 110) AS q FROM setups WHERE outcome IN ('tp_hit', 'sl_hit'))) GROUP BY 1")
def m5(df: DataFrame) -> DataFrame:
    """Half-width of the bands: the k-th least error, k = ceil((n + 1) * 0.9), as a percentile of whole places."""
    errors = df.filter("outcome IN ('tp_hit', 'sl_hit')").withColumn("q", F.abs(F.expr(WON).cast("int") - (F.col("conf") * 0.997 + 0.00001 * F.col("m")) / 110))
    n = errors.groupBy("kind").agg(F.count("*").alias("n")).withColumn("k", F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(0.9))))
    ranked = errors.join(F.broadcast(n), "kind").groupBy("kind", "k", "q").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy("kind").orderBy("q"))
    return ranked.withColumn("_to", upto).filter("_to >= k").groupBy("kind").agg(F.min("q").alias("q"))
