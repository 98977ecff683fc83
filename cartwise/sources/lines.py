"""The two line-level sources the model jobs read, and the base-table row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASKET_LINE_COLUMNS = ["basket_num", "hshd_num", "product_num", "purchase_date", "spend",
                       "units", "commodity", "department", "brand_type", "is_organic"]
ACTIVITY_COLUMNS = ["hshd_num", "basket_num", "purchase_date", "spend", "loyalty_flag",
                    "income_range", "hh_size", "children"]


def basket_lines(tx: DataFrame, products: DataFrame) -> DataFrame:
    """Purchased lines with their product attributes (fact inner-join products)."""
    return tx.join(products, "product_num").select(*BASKET_LINE_COLUMNS)


def household_activity(tx: DataFrame, households: DataFrame) -> DataFrame:
    """Purchased lines with their household attributes (fact inner-join households)."""
    return tx.join(households, "hshd_num").select(*ACTIVITY_COLUMNS)


def table_row_counts(households: DataFrame, products: DataFrame, tx: DataFrame) -> DataFrame:
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
    return (counted(households, "households").unionByName(counted(products, "products"))
            .unionByName(counted(tx, "transactions")))
