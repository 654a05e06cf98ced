"""The nearest setups in mixed features: numbers by root mean square, labels by penalties, found exactly and pruned by pivots and the triangle inequality.

d = sqrt(mean of squared differences of the numbers that both have) + the penalty of each label that differs; without a common number nothing is near.

1. Equal setups become one vector that keeps its k members of least id: no more of them can be among the k nearest. A setup that a third of all rows repeat costs k rows.
2. ``pivots`` complete vectors of least hash are known to all. A vector lies in the cell of its labels, of the numbers that it has, of its nearest pivot and of its ring around that pivot.
3. For each query every cell has a least and a greatest possible distance: from the penalties, the box of the cell's numbers, and, between complete ones, the query's distance to the pivot and the ring. The greatest distances of the
   nearest cells that hold k members bound the k-th neighbour; cells whose least distance is beyond that bound, or the radius, are never opened.
4. What is left is compared; queries and vectors meet by cell, so a partition has cells, and a large cell is split as any skewed join.

Cells have no more rows than labels, pivots and rings allow. Queries are a stated set against all rows.

Defined results: neighbours are ordered by distance, then by id; a query isn't its own neighbour where ids are equal. Null labels differ from nothing, but for those in ``strict``, where null differs from
a value and equals null. NaN and infinite numbers count as null. Rows of one id are rows of their own; queries with a null id are left out. An empty side gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slack of the bounds, far above what sums of a few numbers lose.
SLACK = 1e-9
NEVER = 1e9


@dataclass(frozen=True)
class Measure:
    """numbers: columns in comparable units; labels: the penalty of each label that differs; strict: labels whose null is a value; apart: labels that mustn't differ."""

    numbers: tuple[str, ...]
    labels: dict[str, float] = field(default_factory=dict)
    strict: frozenset[str] = frozenset()
    apart: tuple[str, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.labels, *self.apart)

    def penalty(self, a: str, b: str) -> Column:
        """Of rows aliased a and b; NEVER and more where they must not meet."""
        out = F.lit(0.0)
        for name, p in [*self.labels.items(), *((x, NEVER) for x in self.apart)]:
            x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
            differ = ~x.eqNullSafe(y) if name in self.strict else F.coalesce(x != y, F.lit(False))
            out = out + F.when(differ, p).otherwise(0.0)
        return out

    def common(self, a: str, b: str) -> Column:
        return sum((F.col(f"{a}.{n}").isNotNull() & F.col(f"{b}.{n}").isNotNull()).cast("int") for n in self.numbers)

    def distance(self, a: str, b: str) -> Column:
        """Null without a common number."""
        squares = sum(F.coalesce(F.pow(F.col(f"{a}.{n}") - F.col(f"{b}.{n}"), F.lit(2)), F.lit(0.0)) for n in self.numbers)
        return F.sqrt(F.try_divide(squares, self.common(a, b))) + self.penalty(a, b)


def _clean(rows: DataFrame, m: Measure, more: list[str]) -> DataFrame:
    number = lambda n: F.when(F.isnan(n) | (F.abs(F.col(n)) == math.inf), None).otherwise(F.col(n)).cast("double").alias(n)
    return rows.select(*more, *[number(n) for n in m.numbers], *m.names)


def _mask(m: Measure) -> Column:
    return F.concat(*[F.when(F.col(n).isNull(), "0").otherwise("1") for n in m.numbers])


def _to(m: Measure, pivot: list[float]) -> Column:
    """Distance from a pivot in the numbers that there are."""
    return F.sqrt(sum(F.coalesce(F.pow(F.col(n) - F.lit(x), F.lit(2)), F.lit(0.0)) for n, x in zip(m.numbers, pivot, strict=True)))


def placed(rows: DataFrame, m: Measure, points: list[list[float]], ring: float) -> DataFrame:
    """rows with _pivot (-1 if there is none), _far (their distance from it) and _ring."""
    nearest = F.array_min(F.array(*[F.struct(_to(m, p).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(points)])) if points else F.lit(None).cast("struct<d:double,i:int>")
    found = rows.withColumn("_near", nearest)
    return found.select("*", F.coalesce("_near.i", F.lit(-1)).alias("_pivot"), F.coalesce("_near.d", F.lit(0.0)).alias("_far"), F.floor(F.coalesce("_near.d", F.lit(0.0)) / ring).cast("int").alias("_ring")).drop("_near")


def candidates(queries: DataFrame, data: DataFrame, m: Measure, k: int, radius: float, keep: list[str], pivots: int = 16, ring: float = 0.05) -> DataFrame:
    """Pairs of a query (as q) and a vector (as v, with members: its k rows of least id) that can't be ruled out, each once."""
    rows = _clean(data, m, ["id", *keep])
    vector = [*m.numbers, *m.names]
    least = Window.partitionBy(*vector).orderBy("id", *keep)
    few = rows.withColumn("_k", F.row_number().over(least)).filter(F.col("_k") <= k + 1)  # one more, as the query itself may be among them
    vectors = few.groupBy(*vector).agg(F.array_sort(F.collect_list(F.struct("id", *keep))).alias("members"))
    whole = vectors.dropna(subset=list(m.numbers)).select(*m.numbers).orderBy(F.xxhash64(*m.numbers), *m.numbers).limit(pivots).collect()
    points = [[r[n] for n in m.numbers] for r in whole]
    key = ["_mask", "_pivot", "_ring", *m.names]
    inside = placed(vectors, m, points, ring).withColumn("_mask", _mask(m))
    box = [f(n).alias(f"{tag}_{n}") for n in m.numbers for f, tag in ((F.min, "_lo"), (F.max, "_hi"))]
    cells = inside.groupBy(*key).agg(F.min("_far").alias("_from"), F.max("_far").alias("_to"), F.sum(F.size("members")).alias("_n"), *box).withColumn("_cell", F.xxhash64(*key))
    asked = _clean(queries, m, ["id"]).filter("id IS NOT NULL").withColumn("_asked", _mask(m))
    asked = asked.withColumn("_pivots", F.array(*[_to(m, p) for p in points]) if points else F.array().cast("array<double>"))
    complete = "1" * len(m.numbers)
    penalty = m.penalty("q", "c")
    # Of complete vectors and queries: the triangle of query, pivot and vector.
    known = (F.col("_asked") == complete) & (F.col("_mask") == complete) & (F.col("_pivot") >= 0)
    away, size = F.get("_pivots", F.greatest(F.col("_pivot"), F.lit(0))), math.sqrt(len(m.numbers))
    near = F.when(known, F.greatest(F.lit(0.0), away - F.col("_to"), F.col("_from") - away) / size).otherwise(0.0)
    far = F.when(known, (away + F.col("_to")) / size).otherwise(NEVER)
    # Of all: the box of the numbers that a cell's vectors have, which are the same ones.
    common = sum((F.col(f"q.{n}").isNotNull() & F.col(f"_lo_{n}").isNotNull()).cast("int") for n in m.numbers)
    least_off = sum(F.coalesce(F.pow(F.greatest(F.lit(0.0), F.col(f"_lo_{n}") - F.col(f"q.{n}"), F.col(f"q.{n}") - F.col(f"_hi_{n}")), F.lit(2)), F.lit(0.0)) * F.col(f"q.{n}").isNotNull().cast("int") for n in m.numbers)
    most_off = sum(F.coalesce(F.pow(F.greatest(F.col(f"_hi_{n}") - F.col(f"q.{n}"), F.col(f"q.{n}") - F.col(f"_lo_{n}")), F.lit(2)), F.lit(0.0)) for n in m.numbers)
    boxed = [F.sqrt(F.coalesce(F.try_divide(x, common), F.lit(NEVER))) for x in (least_off, most_off)]
    low = penalty + F.greatest(near, boxed[0]) - SLACK
    high = penalty + F.least(far, boxed[1]) + SLACK
    met = asked.alias("q").join(cells.alias("c"), penalty <= radius).select("q.id", *[F.col(f"q.{x}") for x in vector], "_cell", "_n", low.alias("_low"), high.alias("_high"))
    running = Window.partitionBy("id", *vector).orderBy("_high", "_cell").rowsBetween(Window.unboundedPreceding, 0)
    enough = met.withColumn("_sum", F.sum("_n").over(running))
    bound = F.least(F.lit(float(radius)), F.coalesce(F.min(F.when(F.col("_sum") >= k + 1, F.col("_high"))).over(Window.partitionBy("id", *vector)), F.lit(NEVER)))
    left = enough.withColumn("_bound", bound).filter(F.col("_low") <= F.col("_bound")).select("id", *vector, "_cell")
    q = left.select("_cell", F.struct("id", *vector).alias("q"))
    v = inside.select(F.xxhash64(*key).alias("_cell"), F.struct(*vector, "members").alias("v"))
    return q.join(v, "_cell").select("q", "v")


def nearest(queries: DataFrame, data: DataFrame, m: Measure, k: int, radius: float, keep: list[str] | None = None, pivots: int = 16, ring: float = 0.05) -> DataFrame:
    """(query, k, d, id and the kept columns) of the k rows of data (id, numbers, labels) nearest to each query (the same columns), none farther than radius."""
    keep = keep or []
    near = candidates(queries.distinct(), data, m, k, radius, keep, pivots, ring).withColumn("d", m.distance("q", "v")).filter(F.col("d") <= radius)
    each = near.select(F.col("q.id").alias("query"), *[F.col(f"q.{x}").alias(f"_q{i}") for i, x in enumerate((*m.numbers, *m.names))], "d", F.explode("v.members").alias("x")).filter(~F.col("query").eqNullSafe(F.col("x.id")))
    place = Window.partitionBy("query", *[c for c in each.columns if c.startswith("_q")]).orderBy("d", "x.id", *[f"x.{c}" for c in keep])
    ranked = each.withColumn("k", F.row_number().over(place)).filter(F.col("k") <= k)
    return ranked.select("query", F.col("k").cast("bigint").alias("k"), "d", "x.*")


# What is known of similar setups -----------------------------------------------------------------

#: Penalties of the labels that differ, and how far setups may be apart; fixed values.
SETUP = Measure(("rsi", "adx", "vol", "confluence", "px_vs_ma"), {"asset": 0.15, "trend": 0.15, "regime": 0.15, "style": 0.10}, frozenset({"trend"}), ("split",))


def meta_label(setups: DataFrame, resolved: DataFrame, k: int = 15, radius: float = 0.45, least: int = 10, shrink: int = 8) -> DataFrame:
    """(id, p_correct, n, wins, base): how often similar resolved setups (win: boolean) were right, in per cent, drawn to the rate of all by its sample size; null with fewer than least similar ones."""
    whole = resolved.agg(F.avg(F.col("win").cast("double")).alias("rate"), F.count("*").alias("all"))
    found = nearest(setups, resolved, SETUP, k, radius, ["win"]).groupBy("query").agg(F.count("*").alias("n"), F.count_if("win").alias("wins"))
    w = F.col("n") / (F.col("n") + shrink)
    p = F.floor((w * F.col("wins") / F.col("n") + (1 - w) * F.col("rate")) * 100 + 0.5).cast("bigint")
    known = (F.col("n") >= least) & (F.col("all") >= 6)
    return found.join(F.broadcast(whole)).select(F.col("query").alias("id"), F.when(known, p).alias("p_correct"), "n", "wins", F.floor(F.col("rate") * 100 + 0.5).cast("bigint").alias("base"))


def lessons(setups: DataFrame, past: DataFrame, k: int = 3, radius: float = 0.55) -> DataFrame:
    """(query, k, d, id, lesson) of the nearest past setups with a lesson."""
    return nearest(setups, past.filter(F.trim("lesson") != ""), SETUP, k, radius, ["lesson"])
