"""Queries of oscillators, confluence, levels and similar states on day bars, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import oscillators as osc
from tidemark.functions import windows as w
from tidemark.operators.outcomes import walked
from tidemark.plans.bars import DAY_BARS_SQL, day_bars
from tidemark.plans.indicators import ORD, _mean, _w, rounded


def _walked(bars: DataFrame) -> DataFrame:
    """bars with rsi, stoch, macd and adx."""
    return bars.join(walked(bars, ["h", "l", "c"], osc.TREND, dict, osc.trend_step), ["instrument", "d"])


def w28_stochastic_rsi(spark, sf_dir):
    return walked(day_bars(spark, sf_dir), ["h", "l", "c"], osc.TREND, dict, osc.trend_step).select("instrument", "d", "rsi", "stoch")


def w29_adx(spark, sf_dir):
    return rounded(walked(day_bars(spark, sf_dir), ["h", "l", "c"], osc.TREND, dict, osc.trend_step).select("instrument", "d", "macd", "adx"), ["instrument", "d"])


def pivots(bars: DataFrame, reach: int = 5) -> DataFrame:
    """(instrument, kind, price): strict highs and lows of reach bars on both sides, beyond the last close of their series."""
    before, after = w.ordered().rowsBetween(-reach, -1), w.ordered().rowsBetween(1, reach)
    whole = (F.count("*").over(before) == reach) & (F.count("*").over(after) == reach)
    last = F.last("c").over(w.ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = bars.withColumns({"whole": whole, "last": last, "hb": F.max("h").over(before), "ha": F.max("h").over(after), "lb": F.min("l").over(before), "la": F.min("l").over(after)}).filter("whole")
    high = at.filter("h > hb AND h > ha AND h > last").select("instrument", F.lit("resistance").alias("kind"), F.col("h").alias("price"))
    return high.unionByName(at.filter("l < lb AND l < la AND l < last").select("instrument", F.lit("support").alias("kind"), F.col("l").alias("price")))


def w32_pivots(spark, sf_dir):
    """The three levels nearest to the last close on each side, without those within half a percent of the one kept below them."""

    def keep(state: dict, row: tuple) -> tuple:
        if "at" in state and row[0] / state["at"] - 1 <= 0.005:
            return (None,)
        state["at"] = row[0]
        return row

    # The walk is by price within kind and instrument; d only has the order.
    found = pivots(day_bars(spark, sf_dir)).distinct().withColumn("series", F.concat_ws("|", "kind", "instrument"))
    numbered = found.withColumn("i", F.row_number().over(Window.partitionBy("series").orderBy("price")))
    ordered = numbered.select(F.col("series").alias("instrument"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("i")).alias("d"), "price")
    kept = walked(ordered, ["price"], "level double", dict, keep).filter("level IS NOT NULL")
    named = kept.select(F.substring_index("instrument", "|", 1).alias("kind"), F.substring_index("instrument", "|", -1).alias("instrument"), "level")
    near = Window.partitionBy("instrument", "kind").orderBy(F.when(F.col("kind") == "support", -F.col("level")).otherwise(F.col("level")))
    return named.withColumn("place", F.row_number().over(near).cast("long")).filter("place <= 3").withColumn("level", F.round("level", 6))


def w34_volume_profile(spark, sf_dir):
    """The last 60 bars' volume in 30 steps of price: the step of most volume and the edges of the area that holds 70 % around it."""
    recent = day_bars(spark, sf_dir).withColumn("back", F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("d")))).filter("back <= 60")
    # 60 rows of a series at most.
    ranged = recent.groupBy("instrument").agg(F.min("l").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n")).filter("n >= 10 AND hi > lo").withColumn("size", (F.col("hi") - F.col("lo")) / 30)
    steps = recent.join(ranged, "instrument").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(29))))
    lower = F.col("lo") + F.col("i") * F.col("size")
    overlap = F.greatest(F.lit(0.0), F.least(F.col("h"), lower + F.col("size")) - F.greatest(F.col("l"), lower))
    width = F.when(F.col("h") == F.col("l"), 0.0001).otherwise(F.col("h") - F.col("l"))
    volumes = steps.groupBy("instrument", "lo", "size", "i").agg(F.round(F.sum(F.col("v") * overlap / width), 9).alias("x"))
    profile = volumes.groupBy("instrument", "lo", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    at = profile.withColumn("a", osc.value_area(F.col("x")))
    price = lambda i: F.round(F.col("lo") + i * F.col("size"), 4)
    return at.select("instrument", price(F.col("a.peak") + 0.5).alias("poc"), price(F.col("a.last") + 1).alias("vah"), price(F.col("a.first")).alias("val"))


def _weeks(bars: DataFrame) -> DataFrame:
    b = bars.groupBy("instrument", F.to_date(F.date_trunc("week", "d")).alias("d")).agg(F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "d").alias("c"))
    made = _walked(b).withColumns({"sma20": w.mean("c", 20), "sma50": w.mean("c", 50)})
    return made.select("instrument", F.col("d").alias("week"), *[F.col(x).alias(f"week_{x}") for x in ("c", "sma20", "sma50", "rsi", "macd")])


def desk_state(bars: DataFrame) -> DataFrame:
    """All that confluence weighs, of each day and of the week it lies in."""
    volume = F.when(F.row_number().over(w.ordered()) < 20, "normal").when(F.avg("v").over(w.trailing(5)) > F.avg("v").over(w.trailing(20)) * 1.4, "rising").otherwise("normal")
    days = _walked(bars).withColumns({"sma20": w.mean("c", 20), "sma50": w.mean("c", 50), "sma200": w.mean("c", 200), "volume": volume})
    return days.withColumn("week", F.to_date(F.date_trunc("week", "d"))).join(_weeks(bars), ["instrument", "week"], "left")


def w38_confluence(spark, sf_dir):
    df = desk_state(day_bars(spark, sf_dir))
    for step in osc.confluence():
        df = df.withColumns(step)
    return df.select("instrument", "d", "bull_pct", "direction", "strength", "n_signals")


def w39_family_confluence(spark, sf_dir):
    df = desk_state(day_bars(spark, sf_dir))
    for step in osc.family_confluence():
        df = df.withColumns(step)
    return df.select("instrument", "d", "bull_pct", "direction", "strength", "families", F.coalesce("concentrated", F.lit(False)).alias("concentrated"))


def w54_similar_states(spark, sf_dir):
    """What followed the bars whose RSI (within 12), trend and side of MACD are those of the series' last bar; series of 80 bars, three such bars at least."""
    whole = w.ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    states = _walked(day_bars(spark, sf_dir)).withColumns({"a": w.mean("c", 20), "b": w.mean("c", 50), "i": F.row_number().over(w.ordered()) - 1, "n": F.count("*").over(whole)})
    states = states.withColumns({"trend": w.ma_trend("c", "a", "b"), "up": F.col("macd") > 0, **{f"f{k}": (F.lead("c", k).over(w.ordered()) / F.col("c") - 1) * 100 for k in (5, 10, 20)}})
    now = states.withColumn("now", F.last(F.struct("rsi", "trend", "up")).over(whole))
    alike = (F.abs(F.col("rsi") - F.col("now.rsi")) <= 12) & (F.col("trend") == F.col("now.trend")) & F.coalesce(F.col("up") == F.col("now.up"), F.lit(True))
    found = now.filter("n >= 80 AND i >= 60 AND i < n - 21 AND rsi <> 0 AND now.rsi <> 0").filter(alike)
    out = found.groupBy("instrument").agg(
        F.count("*").alias("n_bars"),
        *[F.avg(f"f{k}").alias(f"avg{k}") for k in (5, 10, 20)],
        *[F.avg((F.col(f"f{k}") > 0).cast("double")).alias(f"win{k}") for k in (5, 20)],
        F.max("f20").alias("best20"),
        F.min("f20").alias("worst20"),
    )
    return rounded(out.filter("n_bars >= 3"), ["instrument"])


def _wilder_sql(changes: str, k: str, gain: str) -> str:
    """Smoothed gains (or losses) after k further changes, in closed form."""
    q = "(13 / 14e0)"
    return f"(power({q}, {k}) * list_sum(list_transform({changes}[1:14], lambda x: {gain.format(x='x')})) / 14 + coalesce(list_sum(list_transform(range(1, {k} + 1), lambda j: {gain.format(x=f'{changes}[14 + j]')} * power({q}, {k} - j) / 14)), 0))"


def _rsi_sql(changes: str, k: str) -> str:
    up, down = _wilder_sql(changes, k, "greatest({x}, 0)"), _wilder_sql(changes, k, "greatest(-({x}), 0)")
    return f"CASE WHEN {down} = 0 THEN 100e0 ELSE 100 - 100 / (1 + {up} / {down}) END"


def _state_sql(name: str, bars: str) -> str:
    """CTEs: {name} has instrument, d, n, c, rsi, stoch, macd and adx of bars."""
    return f"""
{name}_b AS (SELECT *, c - lag(c) OVER {ORD} AS move, h - lag(h) OVER {ORD} AS up, lag(l) OVER {ORD} - l AS down, greatest(h - l, abs(h - lag(c) OVER {ORD}), abs(l - lag(c) OVER {ORD})) AS tr, row_number() OVER {ORD} AS n FROM {bars}),
{name}_r(instrument, n, total, e12, e26, t, p, q, adx) AS (
    SELECT instrument, n, c, NULL::DOUBLE, NULL::DOUBLE, 0e0, 0e0, 0e0, 0e0 FROM {name}_b WHERE n = 1
    UNION ALL
    SELECT instrument, n, total, e12, e26, t, p, q,
           CASE WHEN n <= 14 THEN 0 WHEN n <= 28 THEN adx + dx / 14 ELSE (adx * 13 + dx) / 14 END
    FROM (SELECT *, CASE WHEN t = 0 OR p + q = 0 THEN 0 ELSE 100 * abs(p - q) / (p + q) END AS dx FROM (
        SELECT b.instrument, b.n, r.total + b.c AS total, r.adx,
               CASE WHEN b.n = 12 THEN (r.total + b.c) / 12 ELSE r.e12 * (11 / 13e0) + b.c * (2 / 13e0) END AS e12,
               CASE WHEN b.n = 26 THEN (r.total + b.c) / 26 ELSE r.e26 * (25 / 27e0) + b.c * (2 / 27e0) END AS e26,
               r.t - CASE WHEN b.n > 15 THEN r.t / 14 ELSE 0 END + b.tr AS t,
               r.p - CASE WHEN b.n > 15 THEN r.p / 14 ELSE 0 END + CASE WHEN b.up > b.down AND b.up > 0 THEN b.up ELSE 0 END AS p,
               r.q - CASE WHEN b.n > 15 THEN r.q / 14 ELSE 0 END + CASE WHEN b.down > b.up AND b.down > 0 THEN b.down ELSE 0 END AS q
        FROM {name}_r r JOIN {name}_b b ON b.instrument = r.instrument AND b.n = r.n + 1))),
{name}_l AS (SELECT *, list(move) FILTER (move IS NOT NULL) OVER {_w(42)} AS m42, list(move) FILTER (move IS NOT NULL) OVER {_w(37)} AS m37 FROM {name}_b),
{name}_s AS (SELECT *, CASE WHEN len(m37) >= 32 THEN list_transform(range(len(m37) - 27, len(m37) - 13), lambda k: {_rsi_sql('m37', 'k')}) END AS last14 FROM {name}_l),
{name} AS (SELECT s.*, CASE WHEN len(m42) >= 15 THEN CAST(floor({_rsi_sql('m42', '(len(m42) - 14)')} + 0.5) AS BIGINT) END AS rsi,
    CAST(CASE WHEN list_min(last14) = list_max(last14) THEN 50 ELSE floor((last14[14] - list_min(last14)) / (list_max(last14) - list_min(last14)) * 100 + 0.5) END AS BIGINT) AS stoch,
    CASE WHEN s.n >= 26 THEN e12 - e26 END AS macd, CASE WHEN s.n >= 30 THEN CAST(floor(adx + 0.5) AS BIGINT) END AS adx
    FROM {name}_s s JOIN {name}_r r USING (instrument, n))"""


_DAYS = f"WITH RECURSIVE day_bars AS ({DAY_BARS_SQL}), {_state_sql('days', 'day_bars')}"
_WEEKS = f"week_bars AS (SELECT instrument, CAST(date_trunc('week', d) AS DATE) AS d, max(h) AS h, min(l) AS l, max_by(c, d) AS c FROM day_bars GROUP BY 1, 2), {_state_sql('weeks', 'week_bars')}"
_SIGNALS = [
    ("dt", 2, "c IS NOT NULL AND sma20 IS NOT NULL", "c > sma20"), ("dt", 2, "sma50 IS NOT NULL", "c > sma50"), ("dt", 3, "sma200 IS NOT NULL", "c > sma200"),
    ("dt", 2, "sma50 IS NOT NULL", "sma20 > sma50"), ("dt", 2, "sma200 IS NOT NULL", "sma50 > sma200"), ("dt", 1, "adx > 25", "c > sma20"),
    ("dm", 2, "rsi IS NOT NULL", "rsi > 50"), ("dm", 2, "macd IS NOT NULL", "macd > 0"), ("dm", 1, "stoch IS NOT NULL", "stoch > 50"),
    ("wt", 3, "wm20 IS NOT NULL", "wc > wm20"), ("wt", 2, "wm50 IS NOT NULL", "wc > wm50"), ("wt", 3, "wmacd IS NOT NULL", "wmacd > 0"),
    ("wm", 2, "wrsi IS NOT NULL", "wrsi > 50"), ("v", 2, "rising", "true"),
]
_ALL = f"""{_DAYS}, {_WEEKS},
wk AS (SELECT instrument, d AS week, c AS wc, {_mean('c', 20)} AS wm20, {_mean('c', 50)} AS wm50, rsi AS wrsi, macd AS wmacd FROM weeks),
dy AS (SELECT *, {_mean('c', 20)} AS sma20, {_mean('c', 50)} AS sma50, {_mean('c', 200)} AS sma200, n >= 20 AND avg(v) OVER {_w(5)} > avg(v) OVER {_w(20)} * 1.4 AS rising, CAST(date_trunc('week', d) AS DATE) AS week FROM days),
wide AS (SELECT * FROM dy LEFT JOIN wk USING (instrument, week)),
sig AS ({' UNION ALL '.join(f"SELECT instrument, d, '{f}' AS fam, {i} AS ord, {x} AS weight, {bull} AS bull FROM wide WHERE {here}" for i, (f, x, here, bull) in enumerate(_SIGNALS))})"""
_STRENGTH = "CASE WHEN bull_pct >= 80 OR bull_pct <= 20 THEN 'HIGH' WHEN bull_pct >= 65 OR bull_pct <= 35 THEN 'MODERATE' WHEN bull_pct IS NOT NULL THEN 'LOW' END"
_DIRECTION = "CASE WHEN bull_pct >= 65 THEN 'BULLISH' WHEN bull_pct <= 35 THEN 'BEARISH' WHEN bull_pct IS NOT NULL THEN 'MIXED' END"
_TREND = "CASE WHEN sma20 IS NULL OR sma50 IS NULL THEN 'sideways' WHEN c > sma20 AND sma20 > sma50 THEN 'bullish' WHEN c < sma20 AND sma20 < sma50 THEN 'bearish' WHEN c > sma50 THEN 'mildly bullish' ELSE 'mildly bearish' END"
_5 = "(PARTITION BY instrument ORDER BY d ROWS BETWEEN {} AND {})"
_B5, _A5 = _5.format("5 PRECEDING", "1 PRECEDING"), _5.format("1 FOLLOWING", "5 FOLLOWING")

ORACLE_SQL = {
    "w28_stochastic_rsi": f"{_DAYS} SELECT instrument, d, rsi, stoch FROM days",
    "w29_adx": f"{_DAYS} SELECT instrument, d, round(macd, 6) AS macd, adx FROM days",
    "w32_pivots": f"""WITH RECURSIVE day_bars AS ({DAY_BARS_SQL}),
x AS (SELECT *, count(*) OVER {_B5} = 5 AND count(*) OVER {_A5} = 5 AS whole, last(c) OVER (PARTITION BY instrument ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z,
      max(h) OVER {_B5} AS hb, max(h) OVER {_A5} AS ha, min(l) OVER {_B5} AS lb, min(l) OVER {_A5} AS la FROM day_bars),
p AS (SELECT instrument, 'resistance' AS kind, h AS price FROM x WHERE whole AND h > hb AND h > ha AND h > z UNION SELECT instrument, 'support', l FROM x WHERE whole AND l < lb AND l < la AND l < z),
k AS (SELECT instrument, kind, min(price) AS level FROM p GROUP BY 1, 2 UNION ALL
      SELECT k.instrument, k.kind, min(p.price) FROM k JOIN p ON p.instrument = k.instrument AND p.kind = k.kind AND p.price / k.level - 1 > 0.005 GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY instrument, kind ORDER BY CASE WHEN kind = 'support' THEN -level ELSE level END) AS place FROM k)
SELECT kind, instrument, round(level, 6) AS level, place FROM n WHERE place <= 3""",
    "w34_volume_profile": f"""WITH RECURSIVE day_bars AS ({DAY_BARS_SQL}), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY d DESC) AS back FROM day_bars) WHERE back <= 60),
g AS (SELECT instrument, min(l) AS lo, (max(h) - min(l)) / 30 AS size FROM r GROUP BY 1 HAVING count(*) >= 10 AND max(h) > min(l)),
x AS (SELECT instrument, lo, size, i, round(sum(v * greatest(0, least(h, lo + i * size + size) - greatest(l, lo + i * size)) / CASE WHEN h = l THEN 0.0001 ELSE h - l END), 9) AS x FROM r JOIN g USING (instrument), range(0, 30) AS s(i) GROUP BY ALL),
t AS (SELECT instrument, lo, size, arg_max(i, (x, -i)) AS peak, max(x) AS held, sum(x) * 0.7 AS goal FROM x GROUP BY ALL),
e AS (SELECT instrument, peak AS a, peak AS b, held FROM t UNION ALL
      SELECT e.instrument, e.a - CASE WHEN up THEN 0 ELSE 1 END, e.b + CASE WHEN up THEN 1 ELSE 0 END, held + CASE WHEN up THEN hi ELSE below END
      FROM (SELECT e.*, n.x AS below, m.x AS hi, m.x IS NOT NULL AND (n.x IS NULL OR m.x >= n.x) AS up FROM e JOIN t USING (instrument)
            LEFT JOIN x n ON n.instrument = e.instrument AND n.i = e.a - 1 LEFT JOIN x m ON m.instrument = e.instrument AND m.i = e.b + 1
            WHERE e.held < t.goal AND (n.x IS NOT NULL OR m.x IS NOT NULL)) e)
SELECT instrument, round(lo + (peak + 0.5) * size, 4) AS poc, round(lo + (max(b) + 1) * size, 4) AS vah, round(lo + min(a) * size, 4) AS val FROM e JOIN t USING (instrument) GROUP BY instrument, lo, size, peak""",
    "w38_confluence": f"""{_ALL}, s AS (SELECT instrument, d, CAST(floor(sum(CASE WHEN bull THEN weight ELSE 0 END) / sum(weight) * 100 + 0.5) AS BIGINT) AS bull_pct, count(*) AS k FROM sig GROUP BY 1, 2)
SELECT instrument, d, bull_pct, {_DIRECTION} AS direction, {_STRENGTH} AS strength, coalesce(k, 0) AS n_signals FROM wide LEFT JOIN s USING (instrument, d)""",
    "w39_family_confluence": f"""{_ALL}, e AS (SELECT *, weight * power(0.55, row_number() OVER (PARTITION BY instrument, d, fam ORDER BY weight DESC, ord) - 1) AS eff FROM sig),
f AS (SELECT instrument, d, fam, sum(eff) AS total, sum(CASE WHEN bull THEN eff ELSE 0 END) AS up FROM e GROUP BY 1, 2, 3),
s AS (SELECT instrument, d, CAST(floor(sum(up) / sum(total) * 100 + 0.5) AS BIGINT) AS bull_pct, count(*) AS families, round(max(total) / sum(total), 9) >= 0.5 AS concentrated FROM f GROUP BY 1, 2),
o AS (SELECT instrument, d, bull_pct, {_DIRECTION} AS direction, {_STRENGTH} AS strength, coalesce(families, 0) AS families, coalesce(concentrated, false) AS concentrated FROM wide LEFT JOIN s USING (instrument, d))
SELECT * REPLACE (CASE WHEN NOT concentrated THEN strength WHEN strength = 'HIGH' THEN 'MODERATE' ELSE 'LOW' END AS strength) FROM o""",
    "w54_similar_states": f"""{_DAYS}, a AS (SELECT *, {_mean('c', 20)} AS sma20, {_mean('c', 50)} AS sma50, {', '.join(f'(lead(c, {k}) OVER {ORD} / c - 1) * 100 AS f{k}' for k in (5, 10, 20))}, count(*) OVER (PARTITION BY instrument) AS total FROM days),
b AS (SELECT *, {_TREND} AS trend FROM a), z AS (SELECT instrument, rsi AS zr, trend AS zt, macd > 0 AS zm FROM b WHERE n = total),
m AS (SELECT b.* FROM b JOIN z USING (instrument) WHERE total >= 80 AND n > 60 AND n < total - 20 AND rsi <> 0 AND zr <> 0 AND abs(rsi - zr) <= 12 AND trend = zt AND coalesce((macd > 0) = zm, true))
SELECT instrument, count(*) AS n_bars, {', '.join(f'round(avg(f{k}), 6) AS avg{k}' for k in (5, 10, 20))}, {', '.join(f'round(avg(CAST(f{k} > 0 AS DOUBLE)), 6) AS win{k}' for k in (5, 20))}, round(max(f20), 6) AS best20, round(min(f20), 6) AS worst20 FROM m GROUP BY 1 HAVING count(*) >= 3""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (w28_stochastic_rsi, w29_adx, w32_pivots, w34_volume_profile, w38_confluence, w39_family_confluence, w54_similar_states)}
