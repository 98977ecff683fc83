"""The application operations over a loaded warehouse and stored results (F1 + F5)."""

import pytest

from cartwise.plans import load as L
from cartwise.plans import results as R
from cartwise.plans import service as S
from test_load_and_dashboard import HOUSEHOLDS, PRODUCTS, TRANSACTIONS


@pytest.fixture(scope="module")
def env(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("svc")
    paths = {}
    for name, text in [("households", HOUSEHOLDS), ("products", PRODUCTS),
                       ("transactions", TRANSACTIONS)]:
        (d / name).mkdir()
        (d / name / "part.csv").write_text(text)
        paths[name] = str(d / name)
    wh, res = str(d / "wh"), str(d / "res")
    report = S.ingest(spark, paths, wh)
    return spark, wh, res, report


def test_empty_state(env):
    spark, wh, res, report = env
    assert report["skippedTransactions"] == 1
    assert S.churn_at_risk(spark, res, wh).count() == 0
    assert S.churn_summary(spark, res, wh) == {
        "bands": [("High", 0), ("Medium", 0), ("Low", 0)], "model": None}
    assert S.basket_rules(spark, res).count() == 0
    assert S.basket_models(spark, res).count() == 0
    pull = S.household_pull(spark, wh, 10, results=res)
    assert pull["total"] == 2 and pull["churn"] is None
    assert S.household_pull(spark, wh, 999) is None


def test_with_results(env):
    spark, wh, res, _ = env
    version = L.current_version(spark, wh)
    R.replace_result(spark.createDataFrame(
        [(10, 0.92, "High"), (20, 0.1, "Low"), (30, 0.5, "Medium")],
        "hshd_num long, churn_probability double, risk_band string"), res, "household_churn", version)
    R.replace_result(spark.createDataFrame(
        [(0.96, 0.99, 0.092, ["recency_days", "frequency"])],
        "accuracy double, roc_auc double, churn_rate double, top_drivers array<string>"),
        res, "churn_model_metric", version)
    R.replace_result(spark.createDataFrame(
        [(["BREAD"], ["MILK"], 0.02, 0.3, 1.5), (["PASTA", "PASTA SAUCE"], ["PARMESAN"], 0.01, 0.4, 4.2),
         (["EGGS"], ["BACON"], 0.015, 0.25, 2.1)],
        "antecedents array<string>, consequents array<string>, support double, confidence double, "
        "lift double"), res, "basket_rules", version)
    R.replace_result(spark.createDataFrame(
        [("GROCERY STAPLE", 0.81, 0.72, ["MILK", "BREAD", "EGGS"])],
        "target_commodity string, accuracy double, roc_auc double, top_drivers array<string>"),
        res, "basket_model_metric", version)
    assert [r["hshd_num"] for r in S.churn_at_risk(spark, res, wh).collect()] == [10, 30, 20]
    assert [r["hshd_num"] for r in S.churn_at_risk(spark, res, wh, 1).collect()] == [10]
    summary = S.churn_summary(spark, res, wh)
    assert summary["bands"] == [("High", 1), ("Medium", 1), ("Low", 1)]
    assert summary["model"]["top_drivers"] == ["recency_days", "frequency"]
    assert [r["lift"] for r in S.basket_rules(spark, res).collect()] == [4.2, 2.1, 1.5]
    top = S.basket_rules(spark, res, 1).collect()
    assert top[0]["antecedents"] == ["PASTA", "PASTA SAUCE"]
    m = S.basket_models(spark, res).first()
    assert m["target_commodity"] == "GROCERY STAPLE" and len(m["top_drivers"]) == 3
    pull = S.household_pull(spark, wh, 10, page=1, page_size=1, results=res)
    assert pull["churn"] == {"probability": 0.92, "band": "High"}
    assert pull["pages"] == 2 and pull["rows"].count() == 1
    assert {k: v.count() for k, v in S.dashboard(spark, wh).items()}["spend_by_department"] == 1
