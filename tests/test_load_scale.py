"""The load's shape at scale: what is rendered, how often the fact is read, code size."""

import os
import re

import pytest
from pyspark.sql import functions as F

from cartwise.operators import integrity as I
from cartwise.plans import load as L
from cartwise.plans import q_load as Q
from cartwise.schema import RAW_TRANSACTION_COLUMNS
from cartwise.sources import tables as S

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_files_a_query_reads_are_rendered(spark, monkeypatch):
    monkeypatch.setattr(Q, "_FIXTURES", {})
    first = Q.raw_fixture(spark, SF, ["all_products"])
    folder = os.path.dirname(first["all_products"].removeprefix("file:"))
    assert os.listdir(folder) == ["all_products"]
    assert Q.raw_fixture(spark, SF, ["all_products"]) == first
    Q.q_constraint_report(spark, SF)
    assert "transactions" not in next(iter(Q._FIXTURES.values()))


def test_the_fact_is_read_once_by_the_constraint_report(spark):
    tx = S.transactions(spark, SF)
    plan = _plan(I.constraint_report(S.households(spark, SF), S.products(spark, SF), tx))
    assert plan.count("l_orderkey") and len(re.findall(r"Relation \[l_orderkey", plan)) == 1


def test_constraint_report_counts_null_repeated_and_orphan_keys(spark):
    d = "DATE'2020-01-01'"
    tx = spark.sql(f"""SELECT * FROM VALUES
        (1L, 1L, {d}, 1L, 1.00BD, 1, 'A', 1, 2020), (1L, 1L, {d}, 1L, 1.00BD, 1, 'A', 1, 2020),
        (2L, NULL, {d}, 9L, 2.00BD, 1, 'A', 1, 2020), (3L, 7L, {d}, NULL, 100000000.00BD, 1, 'A', 1, 2020),
        (3000000000L, 2L, {d}, 2L, 1.00BD, NULL, 'A', 1, 2020)
        t(basket_num, hshd_num, purchase_date, product_num, spend, units, store_region, week_num, year)""")
    h = spark.sql("SELECT * FROM VALUES (1L, true), (1L, true), (2L, false), (NULL, true) t(hshd_num, loyalty_flag)")
    p = spark.sql("""SELECT * FROM VALUES (1L, 'd', 'c', 'b', true), (2L, 'd', 'c', 'b', true)
        t(product_num, department, commodity, brand_type, is_organic)""")
    got = {(r[0], r[1]): r[2] for r in I.constraint_report(h, p, tx).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "transactions"} == {
        "not_null": 3, "int_range": 1, "spend_range": 1, "fk_household": 2, "fk_product": 2}
    assert got[("households", "pk_duplicate")] == 1 and got[("households", "pk_null")] == 1
    empty = {r[1]: r[2] for r in I.constraint_report(h, p, tx.limit(0)).where("table_name = 'transactions'").collect()}
    assert set(empty.values()) == {0} and len(empty) == 5


def test_regions_meet_orders_not_lines(spark):
    plan = _plan(S.transactions(spark, SF))
    line = next(x for x in plan.splitlines() if "Relation [l_orderkey" in x)
    joins = [x for x in plan.splitlines()[:plan.splitlines().index(line)] if "Join " in x]
    assert len(joins) == 1      # only the orders; their regions are joined below
    assert S.transactions(spark, SF).where("store_region IS NULL").count() == 0


def test_generated_cleaning_code_is_small_enough_to_be_compiled(spark):
    raw = spark.createDataFrame([tuple("1" for _ in RAW_TRANSACTION_COLUMNS)],
                                ", ".join(f"{c} string" for c in RAW_TRANSACTION_COLUMNS))
    keys = spark.range(3)
    flagged = L.flag_transactions(raw, keys.select(F.col("id").alias("hshd_num")),
                                  keys.select(F.col("id").alias("product_num")))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = L.clean_transactions(flagged)
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000


@pytest.mark.parametrize("text,want", [
    ("   x \t", "x"), ("﻿ab　 ", "ab"), ("a b", "a b"), ("\t", ""), ("é ", "é"),
    ("\x7f", "\x7f"), (None, "")])
def test_trim_takes_every_white_space(spark, text, want):
    from cartwise.functions import clean as C
    assert spark.createDataFrame([(text,)], "c string").select(C.js_trim("c")).first()[0] == want
