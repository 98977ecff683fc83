"""Raw retail CSV files: render the typed tables as untidy text, and read them back.

``render_raw_files`` writes the three input files of the load job (households,
products, transactions) from the retail views with the quirks the cleaners must
undo: padded and zero-padded numbers, ``null`` / ``NULL`` / empty demographics,
``.59`` money, ``DD-MON-YY`` dates in mixed case, padded header names. The load's
households file leaves out the AUTOMOBILE segment and its products file the
PROMO type, so the transactions file has orphan lines for the load to skip; the
files ``all_households`` and ``all_products`` are whole.

``read_raw_csv`` is the load's CSV scan: every value a string, bound to columns
by (trimmed) header name, malformed records fail the job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.schema import (RAW_HOUSEHOLD_COLUMNS, RAW_PRODUCT_COLUMNS,
                             RAW_TRANSACTION_COLUMNS)
from cartwise.sources import tables as S

# Rows of the two dimensions that the load fixture's files do not carry.
MISSING_SEGMENT = "AUTOMOBILE"
MISSING_PART_TYPE = "PROMO"
CSV_READ = {"header": "true", "inferSchema": "false", "mode": "FAILFAST", "enforceSchema": "false",
            "escape": '"', "columnPruning": "false"}
CSV_WRITE = {"header": "true", "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false"}


def _num_text(c: Column, key: Column) -> Column:
    """Integer text: zero-padded, space-padded or plain, chosen by ``key``."""
    s = c.cast("string")
    return (F.when(key % 3 == 0, F.lpad(s, 8, "0"))
             .when(key % 3 == 1, F.concat(F.lit("  "), s, F.lit(" ")))
             .otherwise(s))


def _flag_text(c: Column, key: Column) -> Column:
    yn = F.when(c, F.lit("Y")).otherwise(F.lit("N"))
    return F.when(key % 2 == 0, F.concat(F.lit(" "), F.lower(yn), F.lit(" "))).otherwise(yn)


def _optional_text(c: Column, key: Column) -> Column:
    missing = (F.when(key % 3 == 0, F.lit("null")).when(key % 3 == 1, F.lit(" NULL "))
                .otherwise(F.lit("")))
    return F.when(c.isNull(), missing).otherwise(
        F.when(key % 2 == 0, F.concat(c, F.lit("  "))).otherwise(c))


def _money_text(c: Column, key: Column) -> Column:
    s = c.cast("string")
    short = F.regexp_replace(s, r"^0\.", ".")       # 0.59 -> .59
    return F.when(key % 2 == 0, F.concat(F.lit(" "), short)).otherwise(short)


def _date_text(d: Column, key: Column) -> Column:
    upper = F.upper(F.date_format(d, "dd-MMM-yy"))
    short_day = F.date_format(d, "d-MMM-yy")        # one-digit day, mixed-case month
    return F.when(key % 2 == 0, upper).otherwise(F.concat(F.lit(" "), short_day))


def listed_households(households: DataFrame, customer: DataFrame) -> DataFrame:
    return households.join(
        customer.where(F.col("c_mktsegment") != MISSING_SEGMENT)
                .select(F.col("c_custkey").alias("hshd_num")), "hshd_num", "left_semi")


def households_text(kept: DataFrame) -> DataFrame:
    k = F.col("hshd_num")
    names = dict(zip(RAW_HOUSEHOLD_COLUMNS, RAW_HOUSEHOLD_COLUMNS))
    names["HSHD_NUM"] = "HSHD_NUM  "                # padded header name
    return kept.select(
        _num_text(k, k).alias(names["HSHD_NUM"]),
        _flag_text(F.col("loyalty_flag"), k).alias("L"),
        *[_optional_text(F.col(src), k + i).alias(dst) for i, (src, dst) in enumerate(
            [("age_range", "AGE_RANGE"), ("marital", "MARITAL"), ("income_range", "INCOME_RANGE"),
             ("homeowner", "HOMEOWNER"), ("hshd_composition", "HSHD_COMPOSITION"),
             ("hh_size", "HH_SIZE"), ("children", "CHILDREN")])])


def listed_products(products: DataFrame, part: DataFrame) -> DataFrame:
    return products.join(
        part.where(F.col("p_type") != MISSING_PART_TYPE)
            .select(F.col("p_partkey").alias("product_num")), "product_num", "left_semi")


def products_text(kept: DataFrame) -> DataFrame:
    k = F.col("product_num")
    return kept.select(
        _num_text(k, k).alias("PRODUCT_NUM"),
        F.concat(F.col("department"), F.lit("   ")).alias("DEPARTMENT"),
        F.when(k % 2 == 0, F.concat(F.lit(" "), F.col("commodity"))).otherwise(F.col("commodity"))
         .alias("COMMODITY"),
        F.when(k % 3 == 0, F.concat(F.col("brand_type"), F.lit(" "))).otherwise(F.col("brand_type"))
         .alias("BRAND_TY"),
        _flag_text(F.col("is_organic"), k).alias("NATURAL_ORGANIC_FLAG"))


def transactions_text(tx: DataFrame) -> DataFrame:
    k = F.col("basket_num") + F.col("product_num")
    return tx.select(
        _num_text(F.col("basket_num"), k).alias("BASKET_NUM"),
        _num_text(F.col("hshd_num"), k + 1).alias("HSHD_NUM"),
        _date_text(F.col("purchase_date"), k).alias("PURCHASE_"),
        _num_text(F.col("product_num"), k + 2).alias("PRODUCT_NUM"),
        _money_text(F.col("spend"), k).alias("SPEND"),
        _num_text(F.col("units"), k).alias("UNITS"),
        F.when(k % 2 == 0, F.concat(F.col("store_region"), F.lit("  "))).otherwise(F.col("store_region"))
         .alias("STORE_R"),
        _num_text(F.col("week_num"), k + 1).alias("WEEK_NUM"),
        _num_text(F.col("year"), k + 2).alias("YEAR"))


FILES = ("households", "products", "all_households", "all_products", "transactions")


def render_raw_files(spark: SparkSession, sf_dir: str, out_dir: str,
                     names: Iterable[str] = FILES) -> dict[str, str]:
    """Write households/products/transactions CSV folders under ``out_dir``, and the whole
    dimensions as all_households/all_products; only those of ``names``."""
    texts = {
        "households": lambda: households_text(listed_households(
            S.households(spark, sf_dir), S.read_table(spark, sf_dir, "customer"))),
        "products": lambda: products_text(listed_products(
            S.products(spark, sf_dir), S.read_table(spark, sf_dir, "part"))),
        "all_households": lambda: households_text(S.households(spark, sf_dir)),
        "all_products": lambda: products_text(S.products(spark, sf_dir)),
        "transactions": lambda: transactions_text(S.transactions(spark, sf_dir))}
    paths = {name: f"{out_dir}/{name}" for name in names}
    for name, path in paths.items():
        texts[name]().write.options(**CSV_WRITE).mode("overwrite").csv(path)
    return paths


def read_raw_csv(spark: SparkSession, path: str, expected: list[str]) -> DataFrame:
    """All-string CSV scan bound by header name (names trimmed), FAILFAST.

    ``enforceSchema=false`` makes Spark check every file's header against the
    columns, so a file with reordered columns fails instead of being mis-read. A quote
    inside a quoted field is doubled; a backslash is a character like any other. Every
    record's fields are counted, also when a query reads few columns or none: the scan
    prunes columns after parsing whole records, so a short or long line always fails.
    """
    df = spark.read.options(**CSV_READ).csv(path)
    renamed = df.toDF(*[c.strip() for c in df.columns])
    missing = [c for c in expected if c not in renamed.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return renamed.select(*expected)


RAW_COLUMNS = {"households": RAW_HOUSEHOLD_COLUMNS, "products": RAW_PRODUCT_COLUMNS,
               "transactions": RAW_TRANSACTION_COLUMNS}
