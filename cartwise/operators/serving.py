"""Serving queries over stored results: rankings, band histogram, latest metric row.

Rankings are ``orderBy(...).limit(k)``, which Spark plans as a distributed
top-k (``TakeOrderedAndProject``): each task keeps k rows, the driver merges
k x tasks, never the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.functions.numeric import BAND_ORDER, round4
from cartwise.operators import evaluate as E
from cartwise.session import stage

DEFAULT_LIMIT = 25
MAX_LIMIT = 200


def clamp_limit(limit: int | None) -> int:
    requested = int(limit or DEFAULT_LIMIT)
    return min(MAX_LIMIT, max(1, requested))


def at_risk(scores: DataFrame, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Households most likely to churn first (ties by household number)."""
    return (scores.orderBy(F.desc("churn_probability"), F.asc("hshd_num"))
                  .limit(clamp_limit(limit))
                  .select("hshd_num", "churn_probability", "risk_band"))


def top_rules(rules: DataFrame, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Strongest cross-sell first: lift, then confidence (then support, sides by name)."""
    return rules.orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"),
                         F.asc("antecedents"), F.asc("consequents")).limit(clamp_limit(limit))


def band_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, i) for i, b in enumerate(BAND_ORDER)],
                                 "band string, position int")


def risk_band_counts(scores: DataFrame) -> DataFrame:
    """Households per band, every band listed (zero when empty), in severity order."""
    counts = scores.groupBy(F.col("risk_band").alias("band")).agg(
        F.count(F.lit(1)).alias("households"))
    # The band frame has exactly three rows and the counts at most as many.
    bands = band_frame(scores.sparkSession)
    return (F.broadcast(bands).join(counts, "band", "left")
            .select("band", F.coalesce("households", F.lit(0)).cast("bigint").alias("households"),
                    "position")
            .orderBy("position"))


def valid_scores(scores: DataFrame, households: DataFrame) -> DataFrame:
    """Scores whose household still exists (the cascade on a household reload)."""
    return scores.join(households.select("hshd_num"), "hshd_num", "left_semi")


def stamp(df: DataFrame) -> DataFrame:
    """created_at = now, added at write time."""
    return df.withColumn("created_at", F.current_timestamp())


def latest(metrics: DataFrame) -> DataFrame:
    """The newest metric row (by created_at, then by id where rows have one)."""
    return metrics.orderBy(*[F.desc(c) for c in ("created_at", "id") if c in metrics.columns]).limit(1)


def heuristic_metric(scored: DataFrame, features: DataFrame, feature_cols: list[str],
                     label: str = "churned", top: int = 6) -> DataFrame:
    """Metric row for a stored score: held-out accuracy and AUC, base rate, and the
    features most correlated with the label as drivers."""
    spark = scored.sparkSession
    # One row per household, read by the split and four metrics: staged once.
    split = E.stratified_split(stage(scored, "metric-scored"), "hshd_num", label)
    features = split
    test = split.where("is_test").withColumn(
        "prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    acc = E.accuracy(test, label, "prediction").first()["accuracy"]
    auc = E.roc_auc(test, label, "score").first()["roc_auc"]
    rate = features.agg(F.avg(F.col(label).cast("double"))).first()[0]
    corr = E.feature_correlations(features, feature_cols, label).where(
        F.col("correlation").isNotNull())
    ranked = corr.orderBy(F.desc(F.abs("correlation")), "feature").limit(top).collect()
    drivers = ", ".join(r["feature"] for r in ranked)
    row = spark.createDataFrame([(acc, auc, rate, drivers)],
                                "accuracy double, roc_auc double, churn_rate double, "
                                "top_drivers string")
    return row.select(round4("accuracy").alias("accuracy"), round4("roc_auc").alias("roc_auc"),
                      round4("churn_rate").alias("churn_rate"), "top_drivers")


def churn_summary(scores: DataFrame, metric: DataFrame) -> DataFrame:
    """Band histogram plus the latest model metric, as one long frame
    (section, name, value, text); no metric rows when no model has run."""
    bands = risk_band_counts(scores).select(
        F.lit("band").alias("section"), F.col("band").alias("name"),
        F.col("households").cast("double").alias("value"), F.lit(None).cast("string").alias("text"))
    if "created_at" in metric.columns:
        metric = latest(metric).drop("created_at")
    m = metric.select(
        F.lit("metric").alias("section"),
        F.explode(F.array(
            F.struct(F.lit("accuracy").alias("name"), F.col("accuracy").alias("value"),
                     F.lit(None).cast("string").alias("text")),
            F.struct(F.lit("roc_auc").alias("name"), F.col("roc_auc").alias("value"),
                     F.lit(None).cast("string").alias("text")),
            F.struct(F.lit("churn_rate").alias("name"), F.col("churn_rate").alias("value"),
                     F.lit(None).cast("string").alias("text")),
            F.struct(F.lit("top_drivers").alias("name"), F.lit(None).cast("double").alias("value"),
                     F.col("top_drivers").alias("text")))).alias("m"))
    return bands.unionByName(m.select("section", "m.name", "m.value", "m.text"))
