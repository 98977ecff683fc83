"""Job entry points: load, basket analysis, churn, each writing its result tables.

    python -m cartwise.plans.jobs load --households H --products P --transactions T --warehouse W
    python -m cartwise.plans.jobs basket --warehouse W --results R
    python -m cartwise.plans.jobs churn --warehouse W --results R --reports D

Without ``--warehouse`` the model jobs read the driver tables of ``--sf-dir``.
Each job prints the run summary the reference prints (counts, bands, top rules).
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.operators import baskets as B
from cartwise.operators import churn as C
from cartwise.operators import evaluate as E
from cartwise.operators import serving as V
from cartwise.plans import basket_job as BJ
from cartwise.plans import churn_job as CJ
from cartwise.plans import load as L
from cartwise.plans import results as R
from cartwise.session import build_session, scale_settings
from cartwise.sources import tables as S


def retail_tables(spark: SparkSession, warehouse: str | None, sf_dir: str | None) -> dict[str, DataFrame]:
    if warehouse:
        return L.read_loaded(spark, warehouse)
    return S.retail_tables(spark, sf_dir)


def run_load(spark: SparkSession, paths: dict[str, str], warehouse: str) -> dict:
    report = L.load_dataset(spark, paths, warehouse)
    print(json.dumps(report))
    return report


def run_basket(spark: SparkSession, tables: dict[str, DataFrame], results: str,
               iterations: int = BJ.DEFAULT_ITERATIONS, source: str | None = None) -> dict:
    lines = tables["transactions"].select("basket_num", "product_num").join(
        tables["products"].select("product_num", "commodity"), "product_num")
    summary = BJ.basket_summary(lines).first()
    print(f"{summary['lines']:,} lines, {summary['baskets']:,} baskets across "
          f"{summary['commodities']} distinct commodities")
    rules, _ = BJ.mine_lines(lines)
    written = R.replace_result(rules, results, "basket_rules", source, id_order=[
        F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedents", "consequents"])
    print(f"Wrote {written} association rules to basket_rules")
    stored = R.read_result(spark, results, "basket_rules").drop("id", "created_at")
    V.top_rules(BJ.rules_as_text(stored), 10).show(10, truncate=False)
    metric = BJ.copurchase_lines(lines, iterations)
    if metric.count() == 0:
        print("Skipped co-purchase model (target commodity has a single class).")
        return {"rules": written, "model": False}
    R.replace_result(metric.withColumn("top_drivers", F.split("top_drivers", ", ")),
                     results, "basket_model_metric", source, id_order=["target_commodity"])
    metric.show(truncate=False)
    return {"rules": written, "model": True}


def run_churn(spark: SparkSession, tables: dict[str, DataFrame], results: str,
              reports: str | None = None, iterations: int = CJ.DEFAULT_ITERATIONS,
              source: str | None = None) -> dict:
    """``source``: the loaded dataset version the tables come from; the stored
    scores are tied to it and read as empty after a reload."""
    features, cutoff = C.churn_features(
        tables["transactions"].select("hshd_num", "basket_num", "purchase_date", "spend"),
        tables["households"])
    if features is None:
        print("No activity.")
        return {"scored": 0}
    print(f"Data ends {cutoff + dt.timedelta(days=C.HOLDOUT_DAYS)}; cutoff = {cutoff}")
    rate = C.base_rate(features).first()
    print(f"{rate['households']:,} households scored; churn base rate = {rate['churn_rate']:.1%}")
    scores, metric = CJ.fit_churn_model(features, iterations)
    if scores is None:
        print("Only one class present - cannot train. Aborting.")
        return {"scored": 0}
    written = R.replace_result(scores, results, "household_churn", source, cluster_by="hshd_num", keep=2)
    print(f"Wrote {written} household churn scores")
    V.risk_band_counts(R.read_result(spark, results, "household_churn")).show()
    R.replace_result(metric, results, "churn_model_metric", source, id_order=["accuracy"])
    m = metric.first()
    print(f"Held-out accuracy {m['accuracy']}, ROC-AUC {m['roc_auc']}; drivers: {', '.join(m['top_drivers'])}")
    if reports:
        corr = E.feature_correlations(features, C.FEATURE_COLUMNS, "churned")
        R.write_report_csv(corr.coalesce(1), f"{reports}/churn_correlations")  # a row per feature
    return {"scored": written}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="cartwise.plans.jobs")
    ap.add_argument("job", choices=["load", "basket", "churn"])
    ap.add_argument("--households")
    ap.add_argument("--products")
    ap.add_argument("--transactions")
    ap.add_argument("--warehouse")
    ap.add_argument("--sf-dir")
    ap.add_argument("--results")
    ap.add_argument("--reports")
    ap.add_argument("--iterations", type=int, default=CJ.DEFAULT_ITERATIONS)
    ap.add_argument("--input-bytes", type=int, help="size the shuffles for an input of this many bytes")
    ap.add_argument("--executors", type=int, default=1)
    ap.add_argument("--executor-cores", type=int, default=8)
    a = ap.parse_args(argv)
    sized = scale_settings(a.input_bytes, a.executor_cores, a.executors) if a.input_bytes else None
    spark = build_session(extra=sized)
    if a.job == "load":
        run_load(spark, {"households": a.households, "products": a.products,
                         "transactions": a.transactions}, a.warehouse)
        return
    tables = retail_tables(spark, a.warehouse, a.sf_dir)
    source = L.current_version(spark, a.warehouse) if a.warehouse else None
    if a.job == "basket":
        run_basket(spark, tables, a.results, a.iterations, source)
    else:
        run_churn(spark, tables, a.results, a.reports, a.iterations, source)


if __name__ == "__main__":
    main()
