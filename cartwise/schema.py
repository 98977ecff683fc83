"""Declared schemas of the retail model (three base tables, four result tables)."""

from __future__ import annotations

from pyspark.sql import types as T

SPEND_TYPE = T.DecimalType(10, 2)

HOUSEHOLDS = T.StructType([
    T.StructField("hshd_num", T.LongType(), False),
    T.StructField("loyalty_flag", T.BooleanType(), False),
    T.StructField("age_range", T.StringType(), True),
    T.StructField("marital", T.StringType(), True),
    T.StructField("income_range", T.StringType(), True),
    T.StructField("homeowner", T.StringType(), True),
    T.StructField("hshd_composition", T.StringType(), True),
    T.StructField("hh_size", T.StringType(), True),
    T.StructField("children", T.StringType(), True),
])

PRODUCTS = T.StructType([
    T.StructField("product_num", T.LongType(), False),
    T.StructField("department", T.StringType(), False),
    T.StructField("commodity", T.StringType(), False),
    T.StructField("brand_type", T.StringType(), False),
    T.StructField("is_organic", T.BooleanType(), False),
])

TRANSACTIONS = T.StructType([
    T.StructField("basket_num", T.LongType(), False),
    T.StructField("hshd_num", T.LongType(), False),
    T.StructField("purchase_date", T.DateType(), False),
    T.StructField("product_num", T.LongType(), False),
    T.StructField("spend", SPEND_TYPE, False),
    T.StructField("units", T.IntegerType(), False),
    T.StructField("store_region", T.StringType(), False),
    T.StructField("week_num", T.IntegerType(), False),
    T.StructField("year", T.IntegerType(), False),
])

BASKET_RULES = T.StructType([
    T.StructField("antecedents", T.ArrayType(T.StringType()), False),
    T.StructField("consequents", T.ArrayType(T.StringType()), False),
    T.StructField("support", T.DoubleType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("lift", T.DoubleType(), False),
])

BASKET_MODEL_METRIC = T.StructType([
    T.StructField("target_commodity", T.StringType(), False),
    T.StructField("accuracy", T.DoubleType(), False),
    T.StructField("roc_auc", T.DoubleType(), True),
    T.StructField("top_drivers", T.ArrayType(T.StringType()), False),
])

HOUSEHOLD_CHURN = T.StructType([
    T.StructField("hshd_num", T.LongType(), False),
    T.StructField("churn_probability", T.DoubleType(), False),
    T.StructField("risk_band", T.StringType(), False),
])

CHURN_MODEL_METRIC = T.StructType([
    T.StructField("accuracy", T.DoubleType(), False),
    T.StructField("roc_auc", T.DoubleType(), True),
    T.StructField("churn_rate", T.DoubleType(), False),
    T.StructField("top_drivers", T.ArrayType(T.StringType()), False),
])

# Raw CSV headers of the three input files, in file order.
RAW_HOUSEHOLD_COLUMNS = ["HSHD_NUM", "L", "AGE_RANGE", "MARITAL", "INCOME_RANGE",
                         "HOMEOWNER", "HSHD_COMPOSITION", "HH_SIZE", "CHILDREN"]
RAW_PRODUCT_COLUMNS = ["PRODUCT_NUM", "DEPARTMENT", "COMMODITY", "BRAND_TY",
                       "NATURAL_ORGANIC_FLAG"]
RAW_TRANSACTION_COLUMNS = ["BASKET_NUM", "HSHD_NUM", "PURCHASE_", "PRODUCT_NUM", "SPEND",
                           "UNITS", "STORE_R", "WEEK_NUM", "YEAR"]
