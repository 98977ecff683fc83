"""The churn job: features -> split -> gradient-boosted trees -> scores, metric, report.

Spark-side throughout: the feature frame is a two-level aggregate, the split is
``evaluate.stratified_split``, the model is MLlib's ``GBTClassifier`` (iterative
jobs over a cached, assembled frame), and the metric row is computed with the
same exact AUC as the oracle-checked evaluation queries. Only the metric row and
the feature importances (one number per feature) reach the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.functions.numeric import round4
from cartwise.operators import churn as C
from cartwise.operators import evaluate as E
from cartwise.session import stage
from cartwise.sources import tables as S

TOP_DRIVERS = 6
DEFAULT_ITERATIONS = 100


def features_frame(spark: SparkSession, sf_dir: str,
                   holdout_days: int = C.HOLDOUT_DAYS) -> tuple[DataFrame, dt.date | None]:
    # Basket totals: every churn feature is a sum / max / min over basket-days.
    return C.churn_features(S.basket_totals(spark, sf_dir), S.households(spark, sf_dir), holdout_days)


def gbt(iterations: int, label: str = "label", weight: str | None = None) -> GBTClassifier:
    """Library defaults of the reference's booster: depth 3, step 0.1, seed 42."""
    booster = GBTClassifier(featuresCol="features", labelCol=label, maxIter=iterations,
                            maxDepth=3, stepSize=0.1, seed=42)
    return booster if weight is None else booster.setWeightCol(weight)


def top_drivers(importances, names: list[str], k: int) -> list[str]:
    ranked = sorted(zip(names, list(importances)), key=lambda t: (-t[1], t[0]))
    return [n for n, _ in ranked[:k]]


def fit_churn_model(features: DataFrame, iterations: int = DEFAULT_ITERATIONS):
    """Returns (scores frame, metric frame) or (None, None) when only one class exists."""
    spark = features.sparkSession
    # One row per household, read by the class check, the split and the base rate.
    features = stage(features, "churn-features")
    classes = C.label_class_count(features).first()["classes"]
    if classes < 2:
        return None, None
    assembled = VectorAssembler(inputCols=C.FEATURE_COLUMNS, outputCol="features").transform(
        features.withColumn("label", F.col("churned").cast("double")))
    # Features are stored; the split adds a comparison with one threshold per class.
    split = E.stratified_split(assembled, "hshd_num", "churned")
    model = gbt(iterations).fit(split.where(~F.col("is_test")))
    predicted = model.transform(split).withColumn(
        "p1", vector_to_array("probability")[1])
    test = predicted.where(F.col("is_test"))
    acc = E.accuracy(test, "label", "prediction").first()["accuracy"]
    auc = E.roc_auc(test, "churned", "p1").first()["roc_auc"]
    rate = C.base_rate(features).first()["churn_rate"]
    drivers = top_drivers(model.featureImportances.toArray(), C.FEATURE_COLUMNS, TOP_DRIVERS)
    metric = spark.createDataFrame(
        [(float(acc), None if auc is None else float(auc), float(rate), drivers)],
        "accuracy double, roc_auc double, churn_rate double, top_drivers array<string>")
    metric = metric.select(round4("accuracy").alias("accuracy"), round4("roc_auc").alias("roc_auc"),
                           round4("churn_rate").alias("churn_rate"), "top_drivers")
    scores = C.scores_table(predicted, "p1")
    return scores, metric


def empty_metric(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "accuracy double, roc_auc double, churn_rate double, top_drivers string")


def empty_scores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "hshd_num bigint, churn_probability double, risk_band string")
