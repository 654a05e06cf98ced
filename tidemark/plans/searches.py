"""Queries of similar setups, of a null model of entries, and of learned strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.operators import entries, learned, nulls, outcomes as oc, similar
from tidemark.plans import indicators
from tidemark.plans.bars import DAY_BARS_SQL, day_bars
from tidemark.plans.indicators import ORD, rounded
from tidemark.streaming.windows import shared_folder

BARS = f"day_bars AS ({DAY_BARS_SQL})"


# Similar setups ----------------------------------------------------------------------------------


def _number(i: int) -> str:
    """The i-th component as a number from 0 to 1, of three digits; a few are unknown."""
    x = f"CAST(embedding[{{at}}] AS DOUBLE)".format(at=i)
    return f"CASE WHEN abs({x}) > 0.002e0 THEN round(least(1e0, greatest(0e0, {x} * 1.5e0 + 0.5e0)), 3) END"


def _setup(first: int) -> dict[str, str]:
    """A vector's setup; first: the number of an array's first element."""
    names = {n: _number(i + first) for i, n in enumerate(similar.SETUP.numbers)}
    return names | {
        "asset": "CASE label % 3 WHEN 0 THEN 'Crypto' WHEN 1 THEN 'Forex' END",
        "trend": f"CASE WHEN CAST(embedding[{5 + first}] AS DOUBLE) > 0.05e0 THEN 1 WHEN CAST(embedding[{5 + first}] AS DOUBLE) < -0.05e0 THEN -1 END",
        "regime": "CASE label % 4 WHEN 0 THEN 'up/high' WHEN 1 THEN 'up/low' WHEN 2 THEN 'ranging/low' END",
        "style": "CASE vec_id % 3 WHEN 0 THEN 'swing' WHEN 1 THEN 'scalp' ELSE 'position' END",
        "split": "CASE WHEN label % 3 = 0 THEN vec_id % 7 < 2 END",
        "win": f"CAST(embedding[{6 + first}] AS DOUBLE) > 0",
        "lesson": "CASE WHEN vec_id % 4 = 1 THEN ' ' WHEN vec_id % 4 > 1 THEN 'lesson ' || vec_id END",
        "resolved": "vec_id % 5 <> 4",
    }


def _setups(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("size(embedding) >= 7")
    return rows.selectExpr("vec_id AS id", *[f"{x} AS {k}" for k, x in _setup(0).items()])


def r12_meta_label(spark, sf_dir):
    """How often setups similar to each whose id is divisible by 100 were right."""
    s = _setups(spark, sf_dir)
    return similar.meta_label(s.filter("id % 100 = 0"), s.filter("resolved"))


def r13_lessons(spark, sf_dir):
    """The three nearest lessons of each setup whose id is divisible by 100."""
    s = _setups(spark, sf_dir)
    found = similar.lessons(s.filter("id % 100 = 0"), s.filter("resolved"))
    return found.select("query", "k", "id", "lesson", F.round("d", 6).alias("d"))


_DISTANCE_SQL = " + ".join(f"coalesce(power(q.{n} - s.{n}, 2), 0)" for n in similar.SETUP.numbers)
_COMMON_SQL = " + ".join(f"CAST(q.{n} IS NOT NULL AND s.{n} IS NOT NULL AS INT)" for n in similar.SETUP.numbers)
_PENALTY_SQL = " + ".join(f"CASE WHEN q.{n} {'IS DISTINCT FROM' if n in similar.SETUP.strict else '<>'} s.{n} THEN {p} ELSE 0 END" for n, p in similar.SETUP.labels.items())


def _near_sql(of: str, k: int, radius: float) -> str:
    return f"""
WITH s AS (SELECT vec_id AS id, {", ".join(f"{x} AS {k_}" for k_, x in _setup(1).items())} FROM embeddings WHERE len(embedding) >= 7),
p AS (
  SELECT q.id AS query, s.id, s.win, s.lesson, sqrt(({_DISTANCE_SQL}) / nullif({_COMMON_SQL}, 0)) + {_PENALTY_SQL} AS d
  FROM s q JOIN s ON q.id <> s.id AND s.resolved AND {of} AND NOT coalesce(q.split <> s.split, FALSE) WHERE q.id % 100 = 0
), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS k FROM p WHERE d <= {radius}) WHERE k <= {k})"""


# Entries at random -------------------------------------------------------------------------------


def g24_random_entries(spark, sf_dir):
    """Entries where the momentum of 21 bars turns, held five bars, against 200 runs of as many random ones."""
    b = day_bars(spark, sf_dir).withColumns({"r": w.log_return(), "sign": F.signum(F.col("c") - F.lag("c", 21).over(w.ordered()))})
    turned = F.when(F.col("sign") * F.lag("sign").over(w.ordered()) < 0, F.col("sign").cast("int"))
    bars = b.withColumns({"side": turned, "ahead": F.round(F.log(F.lead("c", 5).over(w.ordered()) / F.col("c")), 9)})
    return rounded(nulls.percentiles(bars.select("instrument", "d", "side", "ahead")), ["instrument"])


_RANDOM_SQL = f"""
WITH {BARS}, b AS (SELECT *, sign(c - lag(c, 21) OVER {ORD}) AS sg FROM day_bars), t AS (
  SELECT instrument, d, CASE WHEN sg * lag(sg) OVER {ORD} < 0 THEN CAST(sg AS INT) END AS side, round(ln(lead(c, 5) OVER {ORD} / c), 9) AS ahead FROM b
), x AS (SELECT * FROM t WHERE ahead IS NOT NULL), own AS (
  SELECT instrument, count(*) AS bars, count(side) AS trades, round(sum(side * ahead), 9) AS earned, least(0.9::DOUBLE, count(side)::DOUBLE / count(*)) AS p, count(*) FILTER (side > 0)::DOUBLE / count(side) AS lng FROM x GROUP BY 1 HAVING count(side) >= 10 AND count(*) >= 50
), h AS (
  SELECT x.instrument, run, ahead, p, lng, md5('null:' || run || ':' || x.instrument || ':' || strftime(d, '%Y-%m-%d')) AS h FROM x JOIN own USING (instrument), range(1, 201) r(run)
), e AS (
  SELECT instrument, run, round(sum(CASE WHEN CAST('0x' || substr(h, 9, 8) AS BIGINT) < lng * {nulls.VALUES} THEN ahead ELSE -ahead END), 9) AS e FROM h WHERE CAST('0x' || substr(h, 1, 8) AS BIGINT) < p * {nulls.VALUES} GROUP BY ALL
), a AS (SELECT instrument, trades, earned, coalesce(e, 0) AS e FROM own CROSS JOIN range(1, 201) r(run) LEFT JOIN e USING (instrument, run)
), f AS (SELECT instrument, trades, earned, list(e ORDER BY e)[101] AS median, max(e) AS best, CAST(floor(count(*) FILTER (e < earned) * 100 / 200 + 0.5) AS BIGINT) AS percentile FROM a GROUP BY ALL)
SELECT instrument, trades, round(earned, 6) AS earned, round(median, 6) AS median, round(best, 6) AS best, percentile, CASE WHEN percentile >= 95 THEN 'beats random' WHEN percentile >= 80 THEN 'edge unclear' ELSE 'no edge vs random' END AS verdict FROM f
"""


# Learned strategies ------------------------------------------------------------------------------

FEATURES = ["mom", "vol", "z", "dd"]


def _dataset(spark, sf_dir):
    """Features of each bar, the side of its momentum, whether that side's barrier came first within ten bars, and the day by which that was known; written, so that it stays as it is."""
    b = oc.triple_barrier(day_bars(spark, sf_dir), F.col("c") * 1.4, F.col("c") * 0.6, 10).withColumn("r", w.log_return())
    f = b.withColumns({"mom": w.scaled_momentum("r", 21), "vol": w.sd("r", 20), "z": w.z_score("c", 50, 20), "dd": w.drawdown("c"), "until": F.lead("d", 10).over(w.ordered())})
    side = F.signum("mom").cast("int")
    rows = f.filter("mom IS NOT NULL").withColumn("side", side).select("instrument", "d", "until", "side", F.when(F.col("side") != 0, (F.col("label") == 1) == (F.col("side") == 1)).cast("int").alias("label"), *FEATURES)
    path = shared_folder(spark, "dataset")
    rows.repartition("instrument").sortWithinPartitions("instrument", "d").write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def g16_learned_momentum(spark, sf_dir):
    """The side of each bar's momentum with the probability that boosted trees of the days before give it."""
    found = learned.walk_forward(_dataset(spark, sf_dir).filter("side <> 0"), FEATURES, keep=["instrument", "side"], trees=10)
    return found.select("instrument", "d", "fold", "side", F.round("p", 4).alias("p"), "learnt_until")


def g15_meta_labeled(spark, sf_dir):
    """The side of each bar's momentum, flat where a logistic model of the days before gives it less than one half; without a model the side stands."""
    found = learned.walk_forward(_dataset(spark, sf_dir).filter("side <> 0"), FEATURES, "logistic", keep=["instrument", "side"])
    p = F.round("p", 4)
    return found.select("instrument", "d", "fold", p.alias("p"), F.when(p < 0.5, 0).otherwise(F.col("side")).alias("signal"), "learnt_until")




def g22_base_signals(spark, sf_dir):
    """Every entry of the 22 base strategies, its stop and target, and whether the twin that asks for the strategy's regime enters too."""
    regimes = indicators.QUERIES["w13_rule_regime"](spark, sf_dir).select("instrument", "d", "regime")
    return rounded(entries.entries(day_bars(spark, sf_dir), regimes), ["instrument", "d"])


QUERIES = {f.__name__: f for f in (g22_base_signals, r12_meta_label, r13_lessons, g24_random_entries, g15_meta_labeled, g16_learned_momentum)}
ORACLE_SQL = {
    "g22_base_signals": entries.entries_sql(DAY_BARS_SQL, f"SELECT instrument, d, regime FROM ({indicators.ORACLE_SQL['w13_rule_regime']})"),
    "r12_meta_label": f"""{_near_sql("TRUE", 15, 0.45)}, b AS (SELECT avg(CAST(win AS INT)) AS rate, count(*) AS many FROM s WHERE resolved), g AS (SELECT query, count(*) AS n, count(*) FILTER (win) AS wins FROM n GROUP BY 1)
SELECT query AS id, CASE WHEN n >= 10 AND many >= 6 THEN CAST(floor((n / (n + 8.0::DOUBLE) * wins / n + (1 - n / (n + 8.0::DOUBLE)) * rate) * 100 + 0.5) AS BIGINT) END AS p_correct, n, wins, CAST(floor(rate * 100 + 0.5) AS BIGINT) AS base FROM g, b""",
    "r13_lessons": f"""{_near_sql("trim(s.lesson) <> ''", 3, 0.55)} SELECT query, k, id, lesson, round(d, 6) AS d FROM n""",
    "g24_random_entries": _RANDOM_SQL,
}
