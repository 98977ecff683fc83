"""The reference's loader / ingest / pull / dashboard fixtures (F1) end to end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartwise.operators import dashboard as D
from cartwise.operators import pull as P
from cartwise.plans import load as L

HOUSEHOLDS = """HSHD_NUM,L,AGE_RANGE,MARITAL,INCOME_RANGE,HOMEOWNER,HSHD_COMPOSITION,HH_SIZE,CHILDREN
10,Y,35-44,Married,50-74K,Homeowner,2 Adults and Kids,3,1
20,N,null,null,null,null,null,null,null
"""
PRODUCTS = """PRODUCT_NUM,DEPARTMENT,COMMODITY,BRAND_TY,NATURAL_ORGANIC_FLAG
100,FOOD,BREAD,PRIVATE,N
200,FOOD,MILK,NATIONAL,Y
"""
TRANSACTIONS = """BASKET_NUM,HSHD_NUM,PURCHASE_,PRODUCT_NUM,SPEND,UNITS,STORE_R,WEEK_NUM,YEAR
1,10,17-AUG-18,100,3.49,1,CENTRAL,32,2018
1,10,17-AUG-18,200,.59,2,CENTRAL,32,2018
2,20,18-AUG-18,100,1.00,1,WEST,32,2018
3,10,19-AUG-18,999,5.00,1,EAST,32,2018
"""


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("fixture")
    paths = {}
    for name, text in [("households", HOUSEHOLDS), ("products", PRODUCTS),
                       ("transactions", TRANSACTIONS)]:
        (d / name).mkdir()
        (d / name / "part.csv").write_text(text)
        paths[name] = str(d / name)
    root = str(d / "warehouse")
    report = L.load_dataset(spark, paths, root, partitions=2)
    return report, L.read_loaded(spark, root)


def test_load_report(loaded):
    report, _ = loaded
    assert report == {"households": 2, "products": 2, "transactions": 3, "skippedTransactions": 1}


def test_null_demographics(loaded):
    _, t = loaded
    row = t["households"].where("hshd_num = 20").first()
    assert row["age_range"] is None and row["income_range"] is None


def test_purchase_date(loaded):
    _, t = loaded
    row = t["transactions"].where("hshd_num = 10 AND product_num = 100").first()
    assert row["purchase_date"] == dt.date(2018, 8, 17)


def test_pull_order_and_paging(loaded):
    _, t = loaded
    pull = P.household_pull(t["transactions"], t["products"], 10).collect()
    assert [r["product_num"] for r in pull] == [100, 200]
    assert [r["spend"] for r in pull] == ["3.49", "0.59"]
    page = P.household_pull_page(t["transactions"], t["products"], 10, 1, 1).collect()
    assert len(page) == 1 and page[0]["product_num"] == 100
    counts = {r["hshd_num"]: (r["total"], r["pages"]) for r in
              P.household_line_counts(t["transactions"], t["households"], 1).collect()}
    assert counts[10] == (2, 2) and counts[20] == (1, 1)


def test_page_clamp():
    assert P.clamp_page(0, 0) == (1, 50)
    assert P.clamp_page(3, 1000) == (3, 200)


def test_dashboard_panels(loaded):
    _, t = loaded
    panels = D.dashboard_panels(t["transactions"], t["transactions"], t["households"], t["products"])
    rows = {k: [tuple(r) for r in v.collect()] for k, v in panels.items()}
    assert rows["spend_by_department"] == [("FOOD", 5.08)]
    assert rows["brand_mix"] == [("PRIVATE", 4.49), ("NATIONAL", 0.59)]
    assert rows["organic_mix"] == [(True, 0.59), (False, 4.49)]
    assert rows["spend_by_income"] == [("50-74K", 4.08, 1), ("Unknown", 1.0, 1)]
    assert rows["loyalty"] == [(True, 4.08, 1), (False, 1.0, 1)]
    assert rows["spend_over_time"] == [("2018-08", 5.08)]


def test_dashboard_empty(loaded):
    _, t = loaded
    empty = t["transactions"].where(F.lit(False))
    panels = D.dashboard_panels(empty, empty, t["households"], t["products"])
    assert all(v.count() == 0 for v in panels.values())
    summary = D.dashboard_summary(empty, empty, t["households"], t["products"])
    assert summary.count() == 0


def test_orphan_with_bad_value_is_not_an_error(spark, tmp_path):
    bad = TRANSACTIONS + "4,10,not-a-date,999,x,1,EAST,32,2018\n"
    paths = {}
    for name, text in [("households", HOUSEHOLDS), ("products", PRODUCTS), ("transactions", bad)]:
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(text)
        paths[name] = str(tmp_path / name)
    report = L.load_dataset(spark, paths, str(tmp_path / "wh"), partitions=2)
    assert report["skippedTransactions"] == 2 and report["transactions"] == 3


def test_missing_column_is_named(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "part.csv").write_text("PRODUCT_NUM,DEPARTMENT\n1,FOOD\n")
    from cartwise.sources.raw_files import read_raw_csv
    with pytest.raises(ValueError, match="COMMODITY"):
        read_raw_csv(spark, str(tmp_path / "p"), ["PRODUCT_NUM", "DEPARTMENT", "COMMODITY"])


def test_jobs_end_to_end(spark, tmp_path):
    """Model jobs over the smallest driver tables: results written and readable."""
    from cartwise.plans import jobs as J
    from cartwise.plans import results as R
    from conftest import SMALL_SF
    tables = J.retail_tables(spark, None, SMALL_SF)
    res, rep = str(tmp_path / "results"), str(tmp_path / "reports")
    out = J.run_churn(spark, tables, res, rep, iterations=5)
    scores = R.read_result(spark, res, "household_churn")
    assert scores.count() == out["scored"] > 0
    assert scores.where("churn_probability < 0 OR churn_probability > 1").count() == 0
    bad_band = scores.where("(churn_probability >= 0.6601 AND risk_band <> 'High') OR "
                            "(churn_probability < 0.3299 AND risk_band <> 'Low')")
    assert bad_band.count() == 0
    assert scores.select("hshd_num").distinct().count() == scores.count()
    assert R.read_result(spark, res, "churn_model_metric").count() == 1
    assert spark.read.option("header", True).csv(f"{rep}/churn_correlations").count() == 9
    b = J.run_basket(spark, tables, res, iterations=5)
    assert b["rules"] == R.read_result(spark, res, "basket_rules").count() > 0


def test_reload_invalidates_scores(spark, tmp_path):
    """Scores computed from one load read as empty after the next load."""
    from cartwise.plans import results as R
    paths = {}
    for name, text in [("households", HOUSEHOLDS), ("products", PRODUCTS),
                       ("transactions", TRANSACTIONS)]:
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(text)
        paths[name] = str(tmp_path / name)
    wh, res = str(tmp_path / "wh"), str(tmp_path / "res")
    L.load_dataset(spark, paths, wh, partitions=2)
    v1 = L.current_version(spark, wh)
    scores = spark.createDataFrame([(10, 0.9, "High")], "hshd_num long, churn_probability double, "
                                                        "risk_band string")
    R.replace_result(scores, res, "household_churn", source=v1)
    assert R.read_result(spark, res, "household_churn", v1).count() == 1
    L.load_dataset(spark, paths, wh, partitions=2)
    v2 = L.current_version(spark, wh)
    assert v2 != v1
    assert R.read_result(spark, res, "household_churn", v2).count() == 0


def _write(d, name, text, file="part.csv"):
    (d / name).mkdir(exist_ok=True)
    (d / name / file).write_text(text)
    return str(d / name)


def test_short_row_fails_the_load(spark, tmp_path):
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    paths = {"households": _write(tmp_path, "households", HOUSEHOLDS),
             "products": _write(tmp_path, "products", PRODUCTS),
             "transactions": _write(tmp_path, "transactions",
                                    TRANSACTIONS + "5,10,17-AUG-18,100,1.00\n")}
    with pytest.raises((PySparkException, Py4JJavaError), match="FAILED_READ_FILE|Malformed"):
        L.load_dataset(spark, paths, str(tmp_path / "wh"), partitions=2)


@pytest.mark.parametrize("name,line,what", [
    ("households", "10,N,null,null,null,null,null,null,null\n", "households.pk_duplicate: 1"),
    ("products", "100,FOOD,EGGS,PRIVATE,N\n", "products.pk_duplicate: 1"),
    ("products", "3000000000,FOOD,EGGS,PRIVATE,N\n", "products.int_range: 1"),
    ("transactions", "3000000000,10,17-AUG-18,100,1.00,1,WEST,32,2018\n", "transactions.int_range: 1")])
def test_broken_constraint_rejects_the_load(spark, tmp_path, name, line, what):
    texts = {"households": HOUSEHOLDS, "products": PRODUCTS, "transactions": TRANSACTIONS}
    good = {n: _write(tmp_path, n, t) for n, t in texts.items()}
    wh = str(tmp_path / "wh")
    L.load_dataset(spark, good, wh, partitions=2)
    before = L.current_version(spark, wh)
    (tmp_path / "bad").mkdir()
    bad = {**good, name: _write(tmp_path / "bad", name, texts[name] + line)}
    with pytest.raises(ValueError, match=what):
        L.load_dataset(spark, bad, wh, partitions=2)
    assert L.current_version(spark, wh) == before


def test_missing_files_are_named(spark, tmp_path):
    with pytest.raises(ValueError, match="products, transactions"):
        L.load_dataset(spark, {"households": "h", "products": None}, str(tmp_path / "wh"))


def test_reordered_header_in_second_file_fails(spark, tmp_path):
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    _write(tmp_path, "products", PRODUCTS)
    _write(tmp_path, "products",
           "DEPARTMENT,PRODUCT_NUM,COMMODITY,BRAND_TY,NATURAL_ORGANIC_FLAG\nFOOD,300,EGGS,PRIVATE,N\n",
           file="part2.csv")
    from cartwise.sources.raw_files import read_raw_csv
    from cartwise.schema import RAW_PRODUCT_COLUMNS
    with pytest.raises((PySparkException, Py4JJavaError), match="FAILED_READ_FILE|header"):
        L.clean_products(read_raw_csv(spark, str(tmp_path / "products"),
                                      RAW_PRODUCT_COLUMNS)).collect()


def test_constraint_report_sees_all_rows_and_real_orphans(spark, tmp_path):
    """Faults in rows that the load's files leave out, and lines without order or customer."""
    from cartwise.plans.q_load import q_constraint_report
    from cartwise.sources import tables as S
    sf = str(tmp_path)
    day = "timestamp'1995-03-04'"
    for name, columns, rows in [
            ("region", "r_regionkey, r_name", "(0, 'ASIA')"),
            ("nation", "n_nationkey, n_regionkey", "(0, 0)"),
            ("customer", "c_custkey, c_mktsegment, c_acctbal, c_nationkey",
             "(1L, 'BUILDING', 1.0D, 0), (2L, 'AUTOMOBILE', 1.0D, 0), (2L, 'AUTOMOBILE', 1.0D, 0), (3000000001L, 'AUTOMOBILE', 1.0D, 0)"),
            ("part", "p_partkey, p_type, p_brand, p_size", "(1L, 'TIN', 'B', 1), (2L, 'PROMO', 'B', 1), (2L, 'PROMO', 'B', 1)"),
            ("orders", "o_orderkey, o_custkey, o_orderdate", f"(1L, 1L, {day}), (2L, 99L, {day})"),
            ("lineitem", "l_orderkey, l_partkey, l_extendedprice, l_quantity",
             "(1L, 1L, 2.5D, 1.0D), (2L, 1L, 2.5D, 1.0D), (2L, 1L, 3.5D, 1.0D), (77L, 1L, 2.5D, 1.0D), (1L, 2L, 2.5D, 1.0D)")]:
        spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})").write.parquet(f"{sf}/{name}.parquet")
    got = {(r["table_name"], r["check_name"]): r["violations"] for r in q_constraint_report(spark, sf).collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("households", "pk_duplicate"): 1, ("households", "int_range"): 1, ("products", "pk_duplicate"): 1,
        ("transactions", "not_null"): 3, ("transactions", "fk_household"): 3, ("transactions", "fk_product"): 1}
    assert {S.transactions(spark, sf, c).count() for c in (["spend"], ["spend", "hshd_num"], ["store_region"], None)} == {5}


@pytest.mark.parametrize("line", ["5,10,17-AUG-18,100,1.00\n", "5,10,17-AUG-18,100,1.00,1,EAST,32,2018,extra\n"])
def test_field_counts_are_checked_when_few_columns_are_read(spark, tmp_path, line):
    """A short or long line fails a count and a two-column read, not only a read of all columns."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F
    from cartwise.functions import clean as C
    from cartwise.schema import RAW_TRANSACTION_COLUMNS
    from cartwise.sources.raw_files import read_raw_csv
    good = read_raw_csv(spark, _write(tmp_path, "good", TRANSACTIONS), RAW_TRANSACTION_COLUMNS)
    assert good.agg(F.count(F.lit(1))).first()[0] == 4
    bad = read_raw_csv(spark, _write(tmp_path, "bad", TRANSACTIONS + line), RAW_TRANSACTION_COLUMNS)
    for read in (bad.agg(F.count(F.lit(1))), bad.select(C.parse_money("SPEND"))):
        with pytest.raises((PySparkException, Py4JJavaError), match="FAILED_READ_FILE|Malformed|MALFORMED"):
            read.collect()


def test_one_copy_of_the_fact_and_old_versions_retire(spark, tmp_path):
    import os
    import time
    from cartwise.session import retire_versions
    paths = {n: _write(tmp_path, n, t) for n, t in
             [("households", HOUSEHOLDS), ("products", PRODUCTS), ("transactions", TRANSACTIONS)]}
    wh = tmp_path / "wh"
    for _ in range(3):
        L.load_dataset(spark, paths, str(wh), partitions=2, keep=2, grace_s=3600)
    versions = sorted(p.name for p in wh.glob("v=*"))
    assert len(versions) == 3       # within the grace time nothing goes
    assert {p.name for p in wh.glob("v=*/*") if p.is_dir()} == {"households", "products", "transactions", "page_index"}
    L.load_dataset(spark, paths, str(wh), partitions=2, keep=2, grace_s=0)
    left = sorted(p.name for p in wh.glob("v=*"))
    assert len(left) == 2 and left[0] == versions[-1]
    assert L.read_loaded(spark, str(wh))["transactions"].count() == 3
    # What a load that failed left behind goes once it is old; a young one stays.
    for age in (7200, 10):
        os.makedirs(wh / f"v={int((time.time() - age) * 1000):015d}-dead" / "households")
    published = [v.removeprefix("v=") for v in left]
    assert [v[-4:] for v in retire_versions(spark, str(wh), published, 2, 3600)] == ["dead"]
    assert len(list(wh.glob("v=*"))) == 3


def test_loaded_line_ids_and_pages(spark, tmp_path):
    """The same lines get the same ids in every load; pages come from the index."""
    from cartwise.plans import service as S
    many = TRANSACTIONS + "".join(f"{50 + i // 7},10,1{i % 9}-AUG-18,100,{i % 13}.00,1,EAST,32,2018\n" for i in range(400))
    paths = {n: _write(tmp_path, n, t) for n, t in [("households", HOUSEHOLDS), ("products", PRODUCTS), ("transactions", many)]}
    wh = str(tmp_path / "wh")
    ids = []
    for partitions in (1, 5):
        L.load_dataset(spark, paths, wh, partitions=partitions)
        ids.append(sorted(r[0] for r in L.read_loaded(spark, wh)["transactions"].select("line_id").collect()))
    assert ids[0] == ids[1] and len(set(ids[0])) == len(ids[0]) == 403
    t = L.read_loaded(spark, wh)
    from cartwise.operators import pull as P
    whole = [tuple(r) for r in P.household_pull(t["transactions"], t["products"], 10).collect()]
    pages = []
    for page in range(1, 10):
        got = S.household_pull(spark, wh, 10, page, 50)
        assert (got["total"], got["pages"]) == (len(whole), -(-len(whole) // 50))
        pages += [tuple(r) for r in got["rows"].collect()]
    assert pages == whole
    with pytest.raises(ValueError, match="positive"):
        S.household_pull(spark, wh, 0)


def test_results_keep_ids_and_history(spark, tmp_path):
    from cartwise.operators import serving as V
    from cartwise.plans import results as R
    root = str(tmp_path / "res")
    with pytest.raises(FileNotFoundError):
        R.read_result(spark, root, "churn_model_metric")
    for run in range(3):
        rows = spark.createDataFrame([(run + i / 10,) for i in range(2)], "accuracy double")
        assert R.replace_result(rows, root, "churn_model_metric", id_order=["accuracy"]) == 2
    assert [(r["id"], r["accuracy"]) for r in R.read_result(spark, root, "churn_model_metric").orderBy("id").collect()] == [(5, 2.0), (6, 2.1)]
    history = R.read_history(spark, root, "churn_model_metric")
    assert sorted(r["id"] for r in history.collect()) == [1, 2, 3, 4, 5, 6] and history.where("created_at is null").count() == 0
    assert V.latest(history).first()["id"] == 6


def test_failures_are_not_served_as_empty(spark, tmp_path):
    """No result yet reads as empty; a result that cannot be read is an error."""
    from cartwise.plans import results as R
    from cartwise.plans import service as S
    root = tmp_path / "res"
    assert S.basket_models(spark, str(root)).count() == 0
    rows = spark.createDataFrame([(["A"], ["B"], 0.1, 0.2, 1.5)],
                                 "antecedents array<string>, consequents array<string>, support double, confidence double, lift double")
    R.replace_result(rows, str(root), "basket_rules")
    assert S.basket_rules(spark, str(root)).count() == 1
    for part in root.glob("basket_rules/v=*/*.parquet"):
        part.write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        S.basket_rules(spark, str(root)).count()
