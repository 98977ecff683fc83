"""Churn framing: cutoff, leak-free label, RFM features, scores and risk bands.

Features come from lines on or before the cutoff, the label from whether the
household bought anything after it. ``churn_features`` combines the fact to
basket-days once (map-side, staged as Parquet in the shared folder), then two
aggregates with map-side combine: per (household, basket), then per household.
The pre/post split is carried as conditional aggregates, not as a join, so a
household holding a third of all lines is combined inside every map task before
anything is shuffled.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.numeric import risk_band, round4

HOLDOUT_DAYS = 90
# The feature names, in the order of the model and of the reports.
FEATURE_COLUMNS = ["recency_days", "frequency", "monetary_total", "monetary_avg",
                   "tenure_days", "recent_spend", "earlier_spend", "trend_ratio", "loyalty"]


def churn_cutoff(activity: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """One row: data_end and cutoff = data_end - holdout_days."""
    end = activity.agg(F.max("purchase_date").alias("data_end"))
    return end.select("data_end", F.date_sub("data_end", holdout_days).alias("cutoff"))


def household_features(activity: DataFrame, cutoff: dt.date,
                       recent_window_days: int = HOLDOUT_DAYS) -> DataFrame:
    """One row per household with activity on or before ``cutoff``.

    ``activity`` needs hshd_num, basket_num, purchase_date, spend, loyalty_flag.
    The cutoff is a literal, so both date tests are plain column predicates.
    """
    cut = F.lit(cutoff).cast("date")
    recent_start = F.date_sub(cut, recent_window_days)
    d = F.col("purchase_date")
    pre = d <= cut
    zero = F.lit(0).cast(activity.schema["spend"].dataType)

    per_basket = activity.groupBy("hshd_num", "basket_num").agg(
        F.max(pre.cast("int")).alias("b_pre"),
        F.max((~pre).cast("int")).alias("b_post"),
        F.sum(F.when(pre, F.col("spend"))).alias("b_spend"),
        F.max(F.when(pre, d)).alias("b_last"),
        F.min(F.when(pre, d)).alias("b_first"),
        F.sum(F.when(pre & (d > recent_start), F.col("spend"))).alias("b_recent"),
        F.sum(F.when(d <= recent_start, F.col("spend"))).alias("b_earlier"),
        *([F.max(F.col("loyalty_flag").cast("int")).alias("b_loyalty")]
          if "loyalty_flag" in activity.columns else []),
    )
    per_household = per_basket.groupBy("hshd_num").agg(
        F.max("b_pre").alias("has_pre"),
        F.max("b_post").alias("has_post"),
        F.sum("b_pre").alias("frequency"),
        F.sum("b_spend").alias("monetary"),
        F.max("b_last").alias("last"),
        F.min("b_first").alias("first"),
        F.coalesce(F.sum("b_recent"), zero).alias("recent"),
        F.coalesce(F.sum("b_earlier"), zero).alias("earlier"),
        *([F.max("b_loyalty").alias("loyalty")] if "loyalty_flag" in activity.columns else []),
    )
    recent = F.col("recent").cast("double")
    earlier = F.col("earlier").cast("double")
    return per_household.where(F.col("has_pre") == 1).select(
        "hshd_num",
        F.datediff(cut, F.col("last")).alias("recency_days"),
        F.col("frequency").cast("bigint").alias("frequency"),
        F.col("monetary").cast("double").alias("monetary_total"),
        (F.col("monetary").cast("double") / F.col("frequency")).alias("monetary_avg"),
        F.datediff(F.col("last"), F.col("first")).alias("tenure_days"),
        recent.alias("recent_spend"),
        earlier.alias("earlier_spend"),
        (recent / (earlier + F.lit(1.0))).alias("trend_ratio"),
        *([F.col("loyalty").cast("int").alias("loyalty")]
          if "loyalty_flag" in activity.columns else []),
        F.when(F.col("has_post") == 1, F.lit(0)).otherwise(F.lit(1)).alias("churned"),
    )


def base_rate(features: DataFrame, label: str = "churned") -> DataFrame:
    return features.agg(F.avg(F.col(label).cast("double")).alias("churn_rate"),
                        F.count(F.lit(1)).alias("households"))


def label_class_count(features: DataFrame, label: str = "churned") -> DataFrame:
    """Distinct label values; fewer than two means no model can be trained."""
    n = F.count_distinct(F.col(label))
    return features.agg(n.alias("classes"), (n >= 2).alias("trainable"))


def heuristic_score(features: DataFrame) -> DataFrame:
    """A deterministic stand-in score: recency / (recency + tenure + 1).

    Used wherever a stored churn score is needed but a model fit would make the
    result untestable (serving queries, evaluation checks).
    """
    r = F.col("recency_days").cast("double")
    return features.withColumn(
        "score", r / (r + F.col("tenure_days").cast("double") + F.lit(1.0)))


def scores_table(scored: DataFrame, probability: str = "score") -> DataFrame:
    """household_churn rows: probability to 4 places, band from the unrounded value."""
    return scored.select(
        F.col("hshd_num").cast("bigint").alias("hshd_num"),
        round4(probability).alias("churn_probability"),
        risk_band(F.col(probability)).alias("risk_band"))


def basket_days(tx: DataFrame) -> DataFrame:
    """Lines combined to (household, basket, day, spend): every churn feature is a
    sum, max or min over these, so any cutoff can be applied to them later."""
    return tx.groupBy("hshd_num", "basket_num", "purchase_date").agg(
        F.sum("spend").alias("spend"))


def churn_features(tx: DataFrame, households: DataFrame,
                   holdout_days: int = HOLDOUT_DAYS) -> tuple[DataFrame | None, dt.date | None]:
    """Features and label from the fact and the households, in one pass over the fact.

    The fact is first combined to basket-days (map-side, so a hot household is
    reduced before the shuffle), restricted to known households with a semi
    join on that much smaller frame, and staged once as Parquet in the shared
    folder. The cutoff (one scalar) and the features both read that copy; the
    loyalty flag is joined per household at the end instead of per line.
    """
    from cartwise.session import stage
    days = stage(basket_days(tx).join(households.select("hshd_num"), "hshd_num", "left_semi"),
                 "basket-days")
    end = days.agg(F.max("purchase_date")).first()[0]
    if end is None:
        return None, None
    cutoff = end - dt.timedelta(days=holdout_days)
    per_household = household_features(days, cutoff, holdout_days)
    loyalty = households.select("hshd_num", F.col("loyalty_flag").cast("int").alias("loyalty"))
    out = per_household.join(loyalty, "hshd_num")
    return out.select("hshd_num", *FEATURE_COLUMNS, "churned"), cutoff
