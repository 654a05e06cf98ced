"""Learned probabilities, walked forward: each stretch of days is scored by a model of the days before it.

Folds are cut at quantiles of the days. A fold's model sees rows whose label was settled (``until``) more than ``embargo`` days before the fold begins, so neither a scored row nor
the horizon of its label overlaps what was learnt. Of these rows the last part by day calibrates: a logistic curve turns the model's margin into a probability, and rows whose label
reaches into that part are not learnt from either. Models of all folds are fitted at the same time, each by Spark over all of its rows; a fold of fewer than ``least`` rows to learn from, or of one label
only, has no model.

Rows (d, until, label 0/1 or null, features). Defined results: rows with a null label are scored and never learnt from; rows with a null or NaN feature are neither; ties of days stay together; rows that repeat count as often; without rows there is nothing.
Deterministic for rows read from the same files: nothing is drawn at random but the candidates of splits, by seed.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the days before a fold that calibrates its model.
CALIBRATE = 0.25


def _day(x: str):
    return F.datediff(x, F.lit("1970-01-01").cast("date"))


def walk_forward(rows: DataFrame, features: list[str], model: str = "gbt", folds: int = 4, first: float = 0.4, embargo: int = 5, least: int = 40, seed: int = 42, trees: int = 20, keep: list[str] | None = None) -> DataFrame:
    """The kept columns, d, fold, p (null where the fold has no model) and learnt_until (the last day that its model knows of) of rows after the first share of days. rows: a table whose files stay as they are."""
    keep = keep or []
    known = rows.filter(reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(f) for f in features]))
    cuts = known.agg(F.percentile(_day("d"), F.array(*[F.lit(first + (1 - first) * i / folds) for i in range(folds)])).alias("q")).first()["q"]
    shape = known.select(*keep, "d", F.lit(0).alias("fold"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("date").alias("learnt_until")).limit(0)
    if not cuts:
        return shape
    bounds = [int(c) + 1 for c in cuts]

    def scored(i: int) -> DataFrame:
        begin = bounds[i]
        part = known.filter(_day("d") >= begin)
        if i + 1 < folds:
            part = part.filter(_day("d") < bounds[i + 1])
        settled = known.filter(F.col("label").isNotNull() & (_day("until") < begin - embargo))
        days = settled.agg(F.percentile(_day("d"), 1 - CALIBRATE).alias("cut"), F.max("until").alias("until")).first()
        none = part.select(*keep, "d", F.lit(i).alias("fold"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("date").alias("learnt_until"))
        if days["cut"] is None:
            return none
        cut = int(days["cut"]) + 1
        fit, curve = settled.filter(_day("until") < cut), settled.filter(_day("d") >= cut)
        counts = {(r["part"], r["label"]): r["count"] for r in fit.withColumn("part", F.lit(0)).unionByName(curve.withColumn("part", F.lit(1))).groupBy("part", F.col("label").cast("int").alias("label")).count().collect()}
        if sum(v for (p, _), v in counts.items() if p == 0) < least or len(counts) < 4:
            return none
        put = VectorAssembler(inputCols=features, outputCol="features" if model == "gbt" else "_raw")
        if model == "gbt":
            stages = [put, GBTClassifier(labelCol="label", featuresCol="features", maxDepth=3, maxIter=trees, stepSize=0.1, minInstancesPerNode=10, seed=seed, predictionCol="_class").setRawPredictionCol("_margin").setProbabilityCol("_probability")]
        else:
            stages = [put, StandardScaler(inputCol="_raw", outputCol="features", withMean=True), LogisticRegression(labelCol="label", regParam=0.01, rawPredictionCol="_margin", probabilityCol="_probability", predictionCol="_class")]
        learnt = Pipeline(stages=stages).fit(fit.withColumn("label", F.col("label").cast("double")))
        margin = lambda df: learnt.transform(df).withColumn("_m", vector_to_array("_margin")[1])
        to_curve = VectorAssembler(inputCols=["_m"], outputCol="_curve")
        platt = LogisticRegression(labelCol="label", featuresCol="_curve", rawPredictionCol="_r", probabilityCol="_p", predictionCol="_c").fit(to_curve.transform(margin(curve.withColumn("label", F.col("label").cast("double")))))
        found = platt.transform(to_curve.transform(margin(part)))
        return found.select(*keep, "d", F.lit(i).alias("fold"), vector_to_array("_p")[1].alias("p"), F.lit(days["until"]).cast("date").alias("learnt_until"))

    with ThreadPoolExecutor(folds) as pool:
        return reduce(DataFrame.unionByName, pool.map(scored, range(folds)))
