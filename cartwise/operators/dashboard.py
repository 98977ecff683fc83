"""Dashboard panels: spend by month, department, brand, organic flag, income, loyalty.

Every panel sums ``spend`` (decimal, exact) and groups by a dimension attribute.
The fact is aggregated down to the dimension key *before* the dimension join
(per product for the product panels, per household for the household panels):
the join then sees one row per key instead of one per line, a hot product or
household is combined map-side instead of shuffled raw, and ``COUNT(DISTINCT
hshd_num)`` becomes a plain count because each household is one row. Sums of
decimals are associative, so the two-step sum is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.numeric import avg_per_household, round_cents

TOP_DEPARTMENTS = 10
UNKNOWN_INCOME = "Unknown"
PANELS = ["spend_over_time", "spend_by_department", "brand_mix", "organic_mix",
          "spend_by_income", "loyalty"]


def spend_by_key(tx: DataFrame, key: str) -> DataFrame:
    """Partial aggregate of the fact on one key (the pre-join combine)."""
    return tx.groupBy(key).agg(F.sum("spend").alias("spend"))


def spend_by_household_month(tx: DataFrame) -> DataFrame:
    """(hshd_num, month, spend): feeds the month panel and both household panels."""
    return (tx.groupBy("hshd_num", F.trunc("purchase_date", "month").alias("purchase_date"))
              .agg(F.sum("spend").alias("spend")))


def _sorted(df: DataFrame, ordered: bool, *cols) -> DataFrame:
    """Panel order for the API shape; skipped inside the long summary, where a
    per-panel global sort would only add a range shuffle."""
    return df.orderBy(*cols) if ordered else df


def spend_over_time(tx: DataFrame, ordered: bool = True) -> DataFrame:
    """Spend per calendar month ``YYYY-MM``, chronological."""
    by_month = (tx.groupBy(F.trunc("purchase_date", "month").alias("month"))
                  .agg(F.sum("spend").cast("double").alias("spend")))
    return _sorted(by_month.select(F.date_format("month", "yyyy-MM").alias("period"),
                                   round_cents("spend").alias("spend")), ordered, "period")


def _per_key(tx: DataFrame, key: str) -> DataFrame:
    """The fact combined to one row per ``key`` unless it already is (pre-aggregates
    passed in by ``dashboard_summary`` carry the ``_per`` marker column)."""
    if f"_per_{key}" in tx.columns:
        return tx.drop(f"_per_{key}")
    return spend_by_key(tx, key)


def _product_panel(tx: DataFrame, products: DataFrame, attr: str) -> DataFrame:
    per_product = _per_key(tx, "product_num")
    return (per_product.join(products.select("product_num", attr), "product_num")
                       .groupBy(attr).agg(F.sum("spend").cast("double").alias("spend")))


def spend_by_department(tx: DataFrame, products: DataFrame,
                        limit: int = TOP_DEPARTMENTS) -> DataFrame:
    """Top departments by spend (ranked on the unrounded sum, ties by name)."""
    dep = _product_panel(tx, products, "department")
    top = dep.orderBy(F.desc("spend"), F.asc("department")).limit(limit)
    return top.select("department", round_cents("spend").alias("spend"))


def brand_mix(tx: DataFrame, products: DataFrame, ordered: bool = True) -> DataFrame:
    b = _product_panel(tx, products, "brand_type")
    out = b.select("brand_type", round_cents("spend").alias("spend"), F.col("spend").alias("_raw"))
    return _sorted(out, ordered, F.desc("_raw"), F.asc("brand_type")).drop("_raw")


def organic_mix(tx: DataFrame, products: DataFrame, ordered: bool = True) -> DataFrame:
    o = _product_panel(tx, products, "is_organic")
    out = o.select(F.col("is_organic").alias("organic"), round_cents("spend").alias("spend"))
    return _sorted(out, ordered, F.desc("organic"))


def _household_panel(tx: DataFrame, households: DataFrame, group_col) -> DataFrame:
    per_household = _per_key(tx, "hshd_num")
    joined = per_household.join(households, "hshd_num")
    return joined.groupBy(group_col).agg(
        F.sum("spend").cast("double").alias("spend"),
        F.count(F.lit(1)).alias("households"))


def spend_by_income(tx: DataFrame, households: DataFrame, ordered: bool = True) -> DataFrame:
    """Spend and distinct households per income range (NULL -> ``Unknown``)."""
    g = _household_panel(tx, households.select("hshd_num", "income_range"),
                         F.coalesce(F.col("income_range"), F.lit(UNKNOWN_INCOME)).alias("income_range"))
    out = g.select("income_range", round_cents("spend").alias("spend"), "households",
                   F.col("spend").alias("_raw"))
    return _sorted(out, ordered, F.desc("_raw"), F.asc("income_range")).drop("_raw")


def spend_by_loyalty(tx: DataFrame, households: DataFrame, ordered: bool = True) -> DataFrame:
    g = _household_panel(tx, households.select("hshd_num", "loyalty_flag"),
                         F.col("loyalty_flag").alias("loyal"))
    out = g.select("loyal", round_cents("spend").alias("spend"), "households")
    return _sorted(out, ordered, F.desc("loyal"))


def income_engagement(tx: DataFrame, households: DataFrame, ordered: bool = True) -> DataFrame:
    """Average spend per household by income range (from the cents-rounded sum)."""
    g = spend_by_income(tx, households, ordered)
    return g.select("income_range",
                    avg_per_household("spend", "households").alias("avg_spend_per_household"),
                    "households")


def loyalty_engagement(tx: DataFrame, households: DataFrame, ordered: bool = True) -> DataFrame:
    g = spend_by_loyalty(tx, households, ordered)
    return g.select("loyal",
                    avg_per_household("spend", "households").alias("avg_spend_per_household"),
                    "households")


def mix_labels(tx: DataFrame, products: DataFrame, households: DataFrame) -> DataFrame:
    """Organic and loyalty groups with their display labels, in one long frame."""
    org = organic_mix(tx, products).select(
        F.lit("organic").alias("panel"),
        F.when(F.col("organic"), "Organic").otherwise("Non-organic").alias("label"),
        F.col("spend").alias("value"))
    loy = loyalty_engagement(tx, households).select(
        F.lit("loyalty").alias("panel"),
        F.when(F.col("loyal"), "Member").otherwise("Non-member").alias("label"),
        F.col("avg_spend_per_household").alias("value"))
    return org.unionByName(loy)


def dashboard_summary(tx_lines: DataFrame, tx_household: DataFrame,
                      households: DataFrame, products: DataFrame) -> DataFrame:
    """The six panels as one long frame (panel, label, value, households).

    ``tx_lines`` needs (product_num, spend) and ``tx_household`` needs
    (hshd_num, purchase_date, spend). The household side is pre-aggregated once
    per (household, month); the month panel and both household panels read that
    one aggregate (the same plan, so its exchange is reused), the product panels
    read one per-product aggregate. An empty fact gives an empty frame.
    """
    hm = spend_by_household_month(tx_household)       # trunc(month) is idempotent downstream
    per_household = spend_by_key(hm, "hshd_num").withColumn("_per_hshd_num", F.lit(True))
    per_product = spend_by_key(tx_lines, "product_num").withColumn("_per_product_num", F.lit(True))

    def numbered(df: DataFrame, panel: str, label, value, households_col=None) -> DataFrame:
        return df.select(
            F.lit(panel).alias("panel"),
            label.cast("string").alias("label"),
            value.cast("double").alias("value"),
            (households_col if households_col is not None else F.lit(None)).cast("bigint")
            .alias("households"))

    panels = [
        numbered(spend_over_time(hm, False), "spend_over_time", F.col("period"), F.col("spend")),
        numbered(spend_by_department(per_product, products), "spend_by_department",
                 F.col("department"), F.col("spend")),
        numbered(brand_mix(per_product, products, False), "brand_mix", F.col("brand_type"),
                 F.col("spend")),
        numbered(organic_mix(per_product, products, False), "organic_mix", F.col("organic"),
                 F.col("spend")),
        numbered(income_engagement(per_household, households, False), "spend_by_income",
                 F.col("income_range"), F.col("avg_spend_per_household"), F.col("households")),
        numbered(loyalty_engagement(per_household, households, False), "loyalty", F.col("loyal"),
                 F.col("avg_spend_per_household"), F.col("households")),
    ]
    out = panels[0]
    for p in panels[1:]:
        out = out.unionByName(p)
    return out


def dashboard_panels(tx_lines: DataFrame, tx_household: DataFrame,
                     households: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """The six panels as separate frames (the API shape), sharing the pre-aggregates."""
    hm = spend_by_household_month(tx_household)
    per_household = spend_by_key(hm, "hshd_num").withColumn("_per_hshd_num", F.lit(True))
    per_product = spend_by_key(tx_lines, "product_num").withColumn("_per_product_num", F.lit(True))
    return {
        "spend_over_time": spend_over_time(hm),
        "spend_by_department": spend_by_department(per_product, products),
        "brand_mix": brand_mix(per_product, products),
        "organic_mix": organic_mix(per_product, products),
        "spend_by_income": income_engagement(per_household, households),
        "loyalty": loyalty_engagement(per_household, households),
    }
