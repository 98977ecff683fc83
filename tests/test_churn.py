"""Churn features (F4), bands, split and AUC against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cartwise.functions.numeric import risk_band
from cartwise.operators import churn as C
from cartwise.operators import evaluate as E

CUTOFF = dt.date(2020, 5, 1)


def activity(spark):
    rows = [(1, 10, dt.date(2020, 1, 1), "10", True), (1, 11, dt.date(2020, 6, 1), "20", True),
            (2, 20, dt.date(2020, 1, 1), "5", False), (3, 30, dt.date(2020, 7, 15), "8", True)]
    df = spark.createDataFrame(rows, "hshd_num long, basket_num long, purchase_date date, "
                                     "spend string, loyalty_flag boolean")
    return df.withColumn("spend", F.col("spend").cast("decimal(10,2)"))


def test_features(spark):
    f = {r["hshd_num"]: r for r in C.household_features(activity(spark), CUTOFF).collect()}
    assert set(f) == {1, 2}
    assert f[1]["churned"] == 0 and f[2]["churned"] == 1
    assert f[1]["recency_days"] == 121 and f[1]["frequency"] == 1
    assert f[2]["loyalty"] == 0 and f[1]["loyalty"] == 1
    assert f[1]["monetary_total"] == 10.0 and f[1]["monetary_avg"] == 10.0
    assert f[1]["earlier_spend"] == 10.0 and f[1]["recent_spend"] == 0.0
    assert f[1]["trend_ratio"] == 0.0 and f[1]["tenure_days"] == 0


def test_basket_spanning_cutoff_counts_pre_lines_only(spark):
    rows = [(1, 10, dt.date(2020, 4, 30), "3", True), (1, 10, dt.date(2020, 5, 2), "4", True),
            (1, 11, dt.date(2020, 1, 1), "5", True)]
    df = spark.createDataFrame(rows, "hshd_num long, basket_num long, purchase_date date, "
                                     "spend string, loyalty_flag boolean") \
        .withColumn("spend", F.col("spend").cast("decimal(10,2)"))
    r = C.household_features(df, CUTOFF).first()
    assert r["frequency"] == 2 and r["monetary_total"] == 8.0 and r["monetary_avg"] == 4.0
    assert r["churned"] == 0 and r["recent_spend"] == 3.0 and r["earlier_spend"] == 5.0


def test_bands(spark):
    df = spark.createDataFrame([(p,) for p in [0.9, 0.5, 0.1, 0.66, 0.33, 0.6599]], "p double")
    assert [r[0] for r in df.select(risk_band("p")).collect()] == \
        ["High", "Medium", "Low", "High", "Medium", "Medium"]


def brute_auc(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l == 0]
    wins = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return wins / (len(pos) * len(neg))


def test_auc_matches_brute_force(spark):
    rnd = random.Random(7)
    labels = [rnd.randint(0, 1) for _ in range(400)]
    scores = [round(rnd.random(), 2) + 0.3 * l for l in labels]   # many ties
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, score double")
    got = E.roc_auc(df, "label", "score", ranges=16).first()["roc_auc"]
    assert abs(got - brute_auc(labels, scores)) < 1e-12
    one_class = df.where("label = 1")
    assert E.roc_auc(one_class, "label", "score").first()["roc_auc"] is None


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = E.stratified_split(df, "k", "y")
    counts = {(r["y"], r["is_test"]): r["count"] for r in a.groupBy("y", "is_test").count().collect()}
    assert counts[(1, True)] == 84 and counts[(0, True)] == 167     # ceil(333/4), ceil(667/4)
    b = E.stratified_split(df.repartition(7), "k", "y")
    assert sorted(r["k"] for r in a.where("is_test").collect()) == \
        sorted(r["k"] for r in b.where("is_test").collect())


def test_correlation_constant_feature_is_null(spark):
    df = spark.createDataFrame([(1.0, 0, 5.0), (2.0, 1, 5.0), (3.0, 1, 5.0)], "a double, y int, c double")
    got = {r["feature"]: r["correlation"] for r in E.feature_correlations(df, ["a", "c"], "y").collect()}
    assert got["c"] is None and abs(got["a"] - 0.8660254037844387) < 1e-12
