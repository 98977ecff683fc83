"""Load queries: CSV scan, cleaners, staged load, report, integrity, stream load.

The inputs are the driver tables rendered as raw retail CSV files (see
``sources.raw_files``) into a fresh folder under the session's shared
checkpoint folder, each file once per session and scale and only when a query reads it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise import oracle as O
from cartwise.functions import clean as C
from cartwise.functions.text import join_list, split_list
from cartwise.operators import baskets as B
from cartwise.operators import integrity as I
from cartwise.operators.numbering import with_line_id
from cartwise.plans import basket_job as BJ
from cartwise.plans import load as L
from cartwise.plans.registry import register
from cartwise.schema import (RAW_HOUSEHOLD_COLUMNS, RAW_PRODUCT_COLUMNS,
                             RAW_TRANSACTION_COLUMNS)
from cartwise.session import scratch_dir
from cartwise.sources import raw_files as R
from cartwise.sources import tables as S
from cartwise.streaming.incremental_load import finish, start_incremental_load, stream_report

STREAM_TIMEOUT_S = 3600   # an availableNow run ends by itself; never wait forever
_FIXTURES: dict[tuple[str, str], dict[str, str]] = {}
LOADED = ("households", "products", "transactions")


def raw_fixture(spark, sf: str, names=LOADED) -> dict[str, str]:
    """Paths of the raw files ``names``; each is rendered by the first query of a session and
    scale that reads it."""
    paths = _FIXTURES.setdefault((spark.sparkContext.applicationId, sf), {})
    missing = [n for n in names if n not in paths]
    if missing:
        paths.update(R.render_raw_files(spark, sf, scratch_dir(spark, "raw"), missing))
    return {n: paths[n] for n in names}


def _raw(spark, sf, name):
    """One raw file, as the load's fixture has it."""
    return L.read_inputs(spark, raw_fixture(spark, sf, [name]))[name]


def _whole(spark, sf, name):
    """The raw file of a whole dimension."""
    return L.read_inputs(spark, {name: raw_fixture(spark, sf, [f"all_{name}"])[f"all_{name}"]})[name]


def _fixture_dims(spark, sf):
    return (L.clean_households(_raw(spark, sf, "households")),
            L.clean_products(_raw(spark, sf, "products")))


FIX_DIMS = f"""fh AS (SELECT h.* FROM households h JOIN customer c ON c.c_custkey = h.hshd_num
              WHERE c.c_mktsegment <> '{R.MISSING_SEGMENT}'),
fp AS (SELECT p.* FROM products p JOIN part q ON q.p_partkey = p.product_num
       WHERE q.p_type <> '{R.MISSING_PART_TYPE}')"""
TX_COLS = ("basket_num, hshd_num, purchase_date, product_num, CAST(spend AS DOUBLE) AS spend, "
           "units, store_region, week_num, year")
VALID = """vt AS (SELECT * FROM transactions t
       WHERE EXISTS (SELECT 1 FROM fh WHERE fh.hshd_num = t.hshd_num)
         AND EXISTS (SELECT 1 FROM fp WHERE fp.product_num = t.product_num))"""


def _tx_double(df):
    return df.select("basket_num", "hshd_num", "purchase_date", "product_num",
                     F.col("spend").cast("double").alias("spend"), "units", "store_region",
                     "week_num", "year")


@register("csv_roundtrip", "SRC-1", O.with_views() + f"""
SELECT 'households' AS file, (SELECT count(*) FROM customer) AS row_count, {len(RAW_HOUSEHOLD_COLUMNS)} AS columns
UNION ALL SELECT 'products', (SELECT count(*) FROM part), {len(RAW_PRODUCT_COLUMNS)}
UNION ALL SELECT 'transactions', (SELECT count(*) FROM lineitem), {len(RAW_TRANSACTION_COLUMNS)}""")
def q_csv_roundtrip(spark, sf):
    raw = {"households": _whole(spark, sf, "households"), "products": _whole(spark, sf, "products"),
           "transactions": _raw(spark, sf, "transactions")}
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("file"), "row_count", F.lit(len(df.columns)).alias("columns"))
        for name, df in raw.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("clean_households", "PRJ-1 SC-1 SC-3 SC-4", O.with_views() + "SELECT * FROM households")
def q_clean_households(spark, sf):
    return L.clean_households(_whole(spark, sf, "households"))


@register("clean_products", "PRJ-2 SC-2 SC-4", O.with_views() + "SELECT * FROM products")
def q_clean_products(spark, sf):
    return L.clean_products(_whole(spark, sf, "products"))


@register("clean_transactions", "PRJ-3 SC-5 SC-6", O.with_views(FIX_DIMS, VALID)
          + f"SELECT {TX_COLS} FROM vt")
def q_clean_transactions(spark, sf):
    h, p = _fixture_dims(spark, sf)
    flagged = L.flag_transactions(_raw(spark, sf, "transactions"), h, p)
    return _tx_double(L.clean_transactions(flagged))


@register("load_dataset", "SNK-1", O.with_views(FIX_DIMS, VALID) + f"SELECT {TX_COLS} FROM vt")
def q_load_dataset(spark, sf):
    root = scratch_dir(spark, "load")
    L.load_dataset(spark, raw_fixture(spark, sf), root)
    return _tx_double(L.read_loaded(spark, root)["transactions"])


_REPORT_SQL = O.with_views(FIX_DIMS, VALID) + """
SELECT (SELECT count(*) FROM fh) AS households, (SELECT count(*) FROM fp) AS products,
       (SELECT count(*) FROM vt) AS transactions,
       (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM vt) AS skipped_transactions"""


@register("load_report", "SNK-8", _REPORT_SQL)
def q_load_report(spark, sf):
    root = scratch_dir(spark, "load")
    return L.report_frame(spark, L.load_dataset(spark, raw_fixture(spark, sf), root))


@register("stream_load_report", "STR-1", O.with_views(FIX_DIMS, VALID) + """
SELECT (SELECT count(*) FROM vt) AS transactions,
       (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM vt) AS skipped_transactions""")
def q_stream_load_report(spark, sf):
    paths = raw_fixture(spark, sf, ["transactions"])
    h, p = _fixture_dims(spark, sf)
    out = scratch_dir(spark, "stream")
    q = start_incremental_load(spark, paths["transactions"], h, p, f"{out}/data",
                               f"{out}/checkpoint")
    finish(q, timeout_s=STREAM_TIMEOUT_S)
    return stream_report(spark, f"{out}/data")


@register("constraint_report", "SNK-6", O.with_views(FIX_DIMS) + """
SELECT table_name, check_name, CAST(violations AS BIGINT) AS violations FROM (
SELECT 'households' AS table_name, 'pk_null' AS check_name, count_if(hshd_num IS NULL) AS violations FROM fh
UNION ALL SELECT 'households', 'not_null', count_if(loyalty_flag IS NULL) FROM fh
UNION ALL SELECT 'households', 'int_range', count_if(hshd_num < -2147483648 OR hshd_num > 2147483647) FROM fh
UNION ALL SELECT 'households', 'pk_duplicate', count(*) FROM (SELECT hshd_num FROM fh GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'products', 'pk_null', count_if(product_num IS NULL) FROM fp
UNION ALL SELECT 'products', 'not_null', count_if(department IS NULL OR commodity IS NULL OR brand_type IS NULL OR is_organic IS NULL) FROM fp
UNION ALL SELECT 'products', 'int_range', count_if(product_num < -2147483648 OR product_num > 2147483647) FROM fp
UNION ALL SELECT 'products', 'pk_duplicate', count(*) FROM (SELECT product_num FROM fp GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'transactions', 'not_null', count_if(basket_num IS NULL OR hshd_num IS NULL OR product_num IS NULL
    OR purchase_date IS NULL OR spend IS NULL OR units IS NULL OR store_region IS NULL OR week_num IS NULL OR year IS NULL) FROM transactions
UNION ALL SELECT 'transactions', 'int_range', count_if(basket_num < -2147483648 OR basket_num > 2147483647
    OR hshd_num < -2147483648 OR hshd_num > 2147483647 OR product_num < -2147483648 OR product_num > 2147483647) FROM transactions
UNION ALL SELECT 'transactions', 'spend_range', count_if(abs(spend) >= 100000000) FROM transactions
UNION ALL SELECT 'transactions', 'fk_household', count(*) FROM transactions t WHERE NOT EXISTS (SELECT 1 FROM fh h WHERE h.hshd_num = t.hshd_num)
UNION ALL SELECT 'transactions', 'fk_product', count(*) FROM transactions t WHERE NOT EXISTS (SELECT 1 FROM fp p WHERE p.product_num = t.product_num))""")
def q_constraint_report(spark, sf):
    # Only the foreign keys refer to the files without some rows: they count the orphan lines.
    return I.constraint_report(L.clean_households(_whole(spark, sf, "households")),
                               L.clean_products(_whole(spark, sf, "products")),
                               S.transactions(spark, sf), parents=_fixture_dims(spark, sf))


@register("valid_transactions", "JN-3", O.with_views(FIX_DIMS, VALID) + f"SELECT {TX_COLS} FROM vt")
def q_valid_transactions(spark, sf):
    h, p = _fixture_dims(spark, sf)
    return _tx_double(I.valid_transactions(S.transactions(spark, sf), h, p))


@register("orphan_transactions", "JN-4", O.with_views(FIX_DIMS) + """
SELECT NOT EXISTS (SELECT 1 FROM fh WHERE fh.hshd_num = t.hshd_num) AS household_missing,
       NOT EXISTS (SELECT 1 FROM fp WHERE fp.product_num = t.product_num) AS product_missing,
       count(*) AS lines
FROM transactions t
WHERE NOT EXISTS (SELECT 1 FROM fh WHERE fh.hshd_num = t.hshd_num)
   OR NOT EXISTS (SELECT 1 FROM fp WHERE fp.product_num = t.product_num)
GROUP BY 1, 2""")
def q_orphan_transactions(spark, sf):
    h, p = _fixture_dims(spark, sf)
    return I.orphan_counts(S.transactions(spark, sf, ["hshd_num", "product_num"]), h, p)


@register("clean_optional_text", "SC-1", O.with_views() + """
SELECT hshd_num, age_range, marital, income_range, homeowner, hshd_composition, hh_size, children
FROM households""")
def q_clean_optional_text(spark, sf):
    raw = _whole(spark, sf, "households")
    cols = [("AGE_RANGE", "age_range"), ("MARITAL", "marital"), ("INCOME_RANGE", "income_range"),
            ("HOMEOWNER", "homeowner"), ("HSHD_COMPOSITION", "hshd_composition"),
            ("HH_SIZE", "hh_size"), ("CHILDREN", "children")]
    return raw.select(C.parse_int("HSHD_NUM").alias("hshd_num"),
                      *[C.clean_optional_text(src).alias(dst) for src, dst in cols])


@register("clean_money", "SC-5", O.with_views() + """
SELECT l_orderkey AS basket_num, l_partkey AS product_num,
       CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS spend FROM lineitem""")
def q_clean_money(spark, sf):
    raw = _raw(spark, sf, "transactions")
    return raw.select(C.parse_int("BASKET_NUM").alias("basket_num"),
                      C.parse_int("PRODUCT_NUM").alias("product_num"),
                      C.parse_money("SPEND").cast("double").alias("spend"))


@register("clean_oracle_date", "SC-6", O.with_views() + """
SELECT l_orderkey AS basket_num, CAST(o_orderdate AS DATE) AS purchase_date
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def q_clean_oracle_date(spark, sf):
    raw = _raw(spark, sf, "transactions")
    return raw.select(C.parse_int("BASKET_NUM").alias("basket_num"),
                      C.parse_oracle_date("PURCHASE_").alias("purchase_date"))


@register("split_list", "SC-13 SC-12", O.with_views() + """,
bi AS (SELECT DISTINCT t.basket_num, p.commodity AS item
       FROM transactions t JOIN products p ON p.product_num = t.product_num)
SELECT basket_num, CAST(count(*) AS INTEGER) AS parts,
       array_to_string(list_sort(list(item)), '|') AS rejoined
FROM bi GROUP BY basket_num""")
def q_split_list(spark, sf):
    text = B.basket_itemsets(BJ.lines_frame(spark, sf)).select(
        "basket_num", join_list("items").alias("items_text"))
    parts = text.select("basket_num", split_list("items_text").alias("p"))
    return parts.select("basket_num", F.size("p").alias("parts"),
                        F.array_join("p", "|").alias("rejoined"))


@register("line_ids", "SNK-5", O.with_views() + f"""
SELECT md5(concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in L.LINE)},
                     CAST(row_number() OVER (PARTITION BY {', '.join(L.LINE)}) AS VARCHAR))) AS line_id,
       basket_num, product_num FROM transactions""")
def q_line_ids(spark, sf):
    lines = with_line_id(S.transactions(spark, sf), L.LINE)
    return lines.select("line_id", "basket_num", "product_num")
