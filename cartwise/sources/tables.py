"""The retail model (households, products, transactions) over the driver's tables.

The driver ships a TPC-H-like star; this module maps it onto the three retail
tables once, as plain DataFrame expressions, so every job reads Parquet with
predicate pushdown and column pruning intact.

``transactions`` only joins what the requested columns need, by left joins: a line
whose order or household is unknown stays, with NULLs, for
``operators.integrity.constraint_report`` to count. So leaving out the ``orders`` join
when no order-side column is asked for cannot change the rows; it removes the largest
join of the model from the panels that only need product and spend.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.schema import SPEND_TYPE, TRANSACTIONS

# Invented demographic labels for the mapped households, and the
# income bands on c_acctbal. They only need to agree with the DuckDB oracle views.
AGE_RANGES = ["19-24", "25-34", "35-44", "45-54", "55-64", "65-74", "75+"]
MARITAL = ["Married", "Single"]
HOMEOWNER = ["Homeowner", "Renter"]
COMPOSITION = ["1 Adult", "1 Adult and Kids", "2 Adults", "2 Adults and Kids",
               "Single Female", "Single Male"]
HH_SIZES = ["1", "2", "3", "4", "5+"]
CHILDREN = ["1", "2", "3+"]
# (column, value list, household numbers divisible by this have NULL)
DEMOGRAPHICS = [
    ("age_range", AGE_RANGES, 11),
    ("marital", MARITAL, 13),
    ("homeowner", HOMEOWNER, 17),
    ("hshd_composition", COMPOSITION, 19),
    ("hh_size", HH_SIZES, 23),
    ("children", CHILDREN, 29),
]
INCOME_BANDS = [(0.0, None), (2500.0, "UNDER 25K"), (5000.0, "25-49K"), (7500.0, "50-74K")]
INCOME_TOP = "75K+"
LOYAL_SEGMENTS = ["HOUSEHOLD", "BUILDING"]
PRIVATE_MAX_SIZE = 25      # p_size <= 25 -> PRIVATE brand, else NATIONAL
ORGANIC_SIZE_STEP = 5      # p_size % 5 = 0 -> organic

# Basket numbers that a point lookup passes to the scan of the lines as a filter.
FILTER_KEYS = 10_000

ORDER_SIDE = {"hshd_num", "purchase_date", "week_num", "year", "store_region"}
ALL_TRANSACTION_COLUMNS = [f.name for f in TRANSACTIONS.fields]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list[str], key: Column, null_every: int) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    picked = F.element_at(arr, (key % len(values) + 1).cast("int"))
    return F.when(key % null_every == 0, F.lit(None).cast("string")).otherwise(picked)


def income_band(acctbal: Column) -> Column:
    expr = None
    for upper, label in INCOME_BANDS:
        value = F.lit(label).cast("string")
        expr = F.when(acctbal < upper, value) if expr is None else expr.when(acctbal < upper, value)
    return expr.otherwise(F.lit(INCOME_TOP))


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    demo = [_pick(values, key, every).alias(name) for name, values, every in DEMOGRAPHICS]
    return c.select(
        key.alias("hshd_num"),
        F.col("c_mktsegment").isin(*LOYAL_SEGMENTS).alias("loyalty_flag"),
        demo[0], demo[1],
        income_band(F.col("c_acctbal")).alias("income_range"),
        demo[2], demo[3], demo[4], demo[5],
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_num"),
        F.col("p_type").alias("department"),
        F.col("p_brand").alias("commodity"),
        F.when(F.col("p_size") <= PRIVATE_MAX_SIZE, F.lit("PRIVATE"))
         .otherwise(F.lit("NATIONAL")).alias("brand_type"),
        (F.col("p_size") % ORGANIC_SIZE_STEP == 0).alias("is_organic"),
    )


def household_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hshd_num -> store_region through customer, nation and region."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
             .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
             .select(F.col("c_custkey").alias("hshd_num"), F.col("r_name").alias("store_region")))


def household_baskets(spark: SparkSession, sf_dir: str, hshd_num: int) -> list[int] | None:
    """Basket numbers of one household (a pushed-down read of ``orders``), or None when they
    are more than a filter can carry."""
    o = read_table(spark, sf_dir, "orders").where(F.col("o_custkey") == F.lit(hshd_num))
    keys = [r[0] for r in o.select("o_orderkey").distinct().limit(FILTER_KEYS + 1).collect()]
    return keys if len(keys) <= FILTER_KEYS else None


def household_transactions(spark: SparkSession, sf_dir: str, hshd_num: int,
                           columns: Iterable[str] | None = None) -> DataFrame:
    """One household's lines. The line-level table has no household column, so its baskets
    are looked up first and their numbers filter the scan of the lines: only that
    household's lines reach the joins. A household of over ``FILTER_KEYS`` baskets is
    filtered through the join with its orders instead (same rows)."""
    keys = household_baskets(spark, sf_dir, hshd_num)
    lines = transactions(spark, sf_dir, columns, keys)
    return lines.where(F.col("hshd_num") == F.lit(hshd_num))


def transactions(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None,
                 baskets: list[int] | None = None) -> DataFrame:
    """The fact, one row per purchased line, restricted to ``columns`` (and to ``baskets``)."""
    cols = list(columns) if columns is not None else ALL_TRANSACTION_COLUMNS
    unknown = set(cols) - set(ALL_TRANSACTION_COLUMNS)
    if unknown:
        raise ValueError(f"unknown transaction columns: {sorted(unknown)}")
    li = read_table(spark, sf_dir, "lineitem")
    if baskets is not None:
        li = li.where(F.col("l_orderkey").isin(baskets))
    fact = li.select(
        F.col("l_orderkey").alias("basket_num"),
        F.col("l_partkey").alias("product_num"),
        F.col("l_extendedprice").cast(SPEND_TYPE).alias("spend"),
        F.col("l_quantity").cast("int").alias("units"),
    )
    if ORDER_SIDE & set(cols):
        o = read_table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("basket_num"),
            F.col("o_custkey").alias("hshd_num"),
            F.col("o_orderdate").cast("date").alias("purchase_date"),
        )
        if "store_region" in cols:      # per order, not per line: the lines are shuffled once
            o = o.join(household_regions(spark, sf_dir), "hshd_num", "left")
        fact = fact.join(o, "basket_num", "left").withColumns({
            "week_num": F.weekofyear("purchase_date"), "year": F.year("purchase_date")})
    return fact.select(*cols)


def retail_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "households": households(spark, sf_dir),
        "products": products(spark, sf_dir),
        "transactions": transactions(spark, sf_dir),
    }


def basket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket_num, hshd_num, purchase_date, spend, lines) with one row per basket.

    Household and date come from the order, so they are the same for every line
    of a basket: summing the lines per basket *before* the orders join is exact
    (decimal sums) and shrinks the join input by the lines-per-basket factor.
    Household-level and month-level sums (dashboard, churn) read this instead of
    the line-level fact.
    """
    li = read_table(spark, sf_dir, "lineitem")
    per_basket = li.groupBy(F.col("l_orderkey").alias("basket_num")).agg(
        F.sum(F.col("l_extendedprice").cast(SPEND_TYPE)).alias("spend"),
        F.count(F.lit(1)).alias("lines"))
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("basket_num"),
        F.col("o_custkey").alias("hshd_num"),
        F.col("o_orderdate").cast("date").alias("purchase_date"))
    return per_basket.join(o, "basket_num", "left").select("basket_num", "hshd_num", "purchase_date",
                                                   "spend", "lines")
