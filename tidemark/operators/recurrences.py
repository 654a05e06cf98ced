"""Recursive averages without a task that walks a whole series.

y_t = q y_{t-1} + (1 - q) x_t is an affine map of y_{t-1}, and so are several steps together. A month of a key adds up its own steps in one window, as if it began with 0; what months end with is handed on
by a small table of a row for each month and key, folded in order; and each row gets its month's beginning, faded by its place in the month. The average begins with the first value.

Defined results: a null value leaves the average as it is, and null before the first; rows of one key and time are taken in any order. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fading(rows: DataFrame, averages: dict[str, tuple[str, float]], key: str = "instrument", time: str = "d") -> DataFrame:
    """rows with averages by name: of a column, with the weight q of the old average, from 0 to below 1."""
    inside = Window.partitionBy(key, "_month").orderBy(time)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # Places count the values of a month, which are few, so that q to the power of minus a place stays far from overflow for q from 0.5.
    columns = dict.fromkeys(c for c, _ in averages.values())
    placed = rows.withColumn("_month", F.trunc(time, "month")).withColumns({f"_k_{c}": F.count(c).over(upto) for c in columns})

    def sums(c: str, q: float) -> Column:
        x = F.col(c).cast("double") * (1 - q)
        if q >= 0.5:
            return F.pow(F.lit(q), F.col(f"_k_{c}")) * F.coalesce(F.sum(x * F.pow(F.lit(1 / q), F.col(f"_k_{c}"))).over(upto), F.lit(0.0))
        return F.aggregate(F.collect_list(x).over(upto), F.lit(0.0), lambda s, v: s * q + v)

    own = placed.withColumns({f"_own_{n}": sums(c, q) for n, (c, q) in averages.items()})
    last = [F.max(f"_k_{c}").alias(f"_n_{c}") for c in columns] + [F.min_by(F.col(c).cast("double"), F.when(F.col(c).isNotNull(), F.col(f"_k_{c}"))).alias(f"_first_{c}") for c in columns]
    ends = own.groupBy(key, "_month").agg(*last, *[F.max_by(f"_own_{n}", f"_k_{c}").alias(f"_own_{n}") for n, (c, _) in averages.items()])
    # Per key a row for each month: what it begins with is what all before it, in order, end with; the first month with a value begins with that.
    listed = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in ends.columns if c != key]))).alias("_ends"))

    def begins(n: str, c: str, q: float) -> Column:
        start = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<struct<y:double,old:boolean>>").alias("out"))

        def step(s: Column, e: Column) -> Column:
            begin = F.coalesce(s["y"], e[f"_first_{c}"])
            out = F.struct(begin.alias("y"), s["y"].isNotNull().alias("old"))
            return F.struct((F.pow(F.lit(q), e[f"_n_{c}"]) * begin + e[f"_own_{n}"]).alias("y"), F.concat(s["out"], F.array(out)).alias("out"))

        return F.aggregate("_ends", start, step)["out"]

    zipped = listed.select(key, F.arrays_zip(F.transform("_ends", lambda e: e["_month"]).alias("_month"), *[begins(n, c, q).alias(f"_begin_{n}") for n, (c, q) in averages.items()]).alias("z"))
    begun = zipped.select(key, F.explode("z").alias("z")).select(key, "z.*")

    def average(n: str, c: str, q: float) -> Column:
        begin = F.col(f"_begin_{n}")
        return F.when(begin["old"] | (F.col(f"_k_{c}") > 0), F.pow(F.lit(q), F.col(f"_k_{c}")) * begin["y"] + F.col(f"_own_{n}"))

    found = own.join(begun, [key, "_month"]).withColumns({n: average(n, c, q) for n, (c, q) in averages.items()})
    return found.drop("_month", *[f"_k_{c}" for c in columns], *[f"_own_{n}" for n in averages], *[f"_begin_{n}" for n in averages])


def faded(rows: DataFrame, value: str, spans: dict[str, float], key: str = "instrument", time: str = "d") -> DataFrame:
    """The rows that have a value, with its averages by name: spans has the weight of the old average, q."""
    return fading(rows.filter(F.col(value).isNotNull()), {n: (value, q) for n, q in spans.items()}, key, time)
