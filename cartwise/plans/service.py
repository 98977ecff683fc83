"""The application's read and load operations as Spark calls (no HTTP layer).

Each function mirrors one operation of the reference application and returns
DataFrames over a loaded warehouse and its result tables:

    ingest(spark, paths, warehouse)                 -> load report
    dashboard(spark, warehouse)                     -> six panel frames
    household_pull(spark, warehouse, n, page, size) -> None | {total, pages, churn, rows}
    basket_rules(spark, results, limit)             -> top rules
    basket_models(spark, results)                   -> model metric rows, newest first
    churn_at_risk(spark, results, warehouse, limit) -> top households by probability
    churn_summary(spark, results, warehouse)        -> {bands, model}

Limits and page sizes are clamped like the reference (1..200, default 25 / 50);
missing result tables read as empty, and scores computed from an older load
read as empty after a reload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.operators import dashboard as D
from cartwise.operators import pull as P
from cartwise.operators import serving as V
from cartwise.plans import load as L
from cartwise.plans import results as R
from cartwise.schema import (BASKET_MODEL_METRIC, BASKET_RULES, CHURN_MODEL_METRIC,
                             HOUSEHOLD_CHURN)


def ingest(spark: SparkSession, paths: dict[str, str], warehouse: str) -> dict:
    return L.load_dataset(spark, paths, warehouse)


def _result(spark: SparkSession, results: str, name: str, schema,
            warehouse: str | None = None) -> DataFrame:
    source = L.current_version(spark, warehouse) if warehouse else None
    try:
        return R.read_result(spark, results, name, source)
    except FileNotFoundError:   # no result written yet reads as empty; other failures are raised
        return spark.createDataFrame([], schema).withColumn(
            "created_at", F.current_timestamp())


def dashboard(spark: SparkSession, warehouse: str) -> dict[str, DataFrame]:
    t = L.read_loaded(spark, warehouse)
    return D.dashboard_panels(t["transactions"], t["transactions"], t["households"],
                              t["products"])


def household_pull(spark: SparkSession, warehouse: str, hshd_num: int, page: int = 1,
                   page_size: int = P.DEFAULT_PAGE_SIZE, results: str | None = None):
    """None when the household does not exist (the reference answers 404); a number that is not
    positive is an error. The page and the total come from the load's page index."""
    if int(hshd_num) < 1:
        raise ValueError(f"household number must be positive, got {hshd_num}")
    t = L.read_loaded(spark, warehouse)
    if t["households"].where(F.col("hshd_num") == hshd_num).limit(1).count() == 0:
        return None
    p, s = P.clamp_page(page, page_size)
    stored, index = L.read_pages(spark, warehouse)
    lines = P.read_page(stored, index, hshd_num, p, s)
    rows = P.household_pull(lines, t["products"], hshd_num)    # at most a page of lines
    total = index.where(F.col("hshd_num") == hshd_num).agg(F.sum("_rows")).first()[0] or 0
    churn = None
    if results:
        scores = _result(spark, results, "household_churn", HOUSEHOLD_CHURN, warehouse)
        hit = scores.where(F.col("hshd_num") == hshd_num).limit(1).collect()
        churn = ({"probability": hit[0]["churn_probability"], "band": hit[0]["risk_band"]}
                 if hit else None)
    return {"hshd_num": hshd_num, "page": p, "page_size": s, "total": total,
            "pages": max(1, -(-total // s)), "churn": churn, "rows": rows}


def basket_rules(spark: SparkSession, results: str, limit: int | None = None) -> DataFrame:
    rules = _result(spark, results, "basket_rules", BASKET_RULES)
    return V.top_rules(rules.drop("created_at", "id"), limit)


def basket_models(spark: SparkSession, results: str) -> DataFrame:
    try:
        m = R.read_history(spark, results, "basket_model_metric")
    except FileNotFoundError:
        m = spark.createDataFrame([], BASKET_MODEL_METRIC).withColumn("created_at", F.current_timestamp())
    return m.orderBy(F.desc("created_at"))


def churn_at_risk(spark: SparkSession, results: str, warehouse: str | None = None,
                  limit: int | None = None) -> DataFrame:
    return V.at_risk(_result(spark, results, "household_churn", HOUSEHOLD_CHURN, warehouse), limit)


def churn_summary(spark: SparkSession, results: str, warehouse: str | None = None) -> dict:
    scores = _result(spark, results, "household_churn", HOUSEHOLD_CHURN, warehouse)
    bands = [(r["band"], r["households"]) for r in V.risk_band_counts(scores).collect()]
    latest = V.latest(_result(spark, results, "churn_model_metric", CHURN_MODEL_METRIC)).collect()
    model = None
    if latest:
        m = latest[0]
        model = {"accuracy": m["accuracy"], "roc_auc": m["roc_auc"],
                 "churn_rate": m["churn_rate"], "top_drivers": list(m["top_drivers"])}
    return {"bands": bands, "model": model}
