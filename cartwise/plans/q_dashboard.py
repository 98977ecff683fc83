"""Dashboard queries (AGG-1..8, SC-7..10, PRJ-6) and the base-table sources (SRC-2..4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise import oracle as O
from cartwise.operators import dashboard as D
from cartwise.plans.registry import register
from cartwise.sources import tables as S



def _rc(x: str) -> str:
    return O.round_cents(x)


@register("spend_over_time", "AGG-1 SC-7 SC-9 SC-10", O.with_views() + f"""
SELECT strftime(purchase_date, '%Y-%m') AS period,
       {_rc('CAST(SUM(spend) AS DOUBLE)')} AS spend
FROM transactions GROUP BY 1 ORDER BY 1""")
def q_spend_over_time(spark, sf):
    return D.spend_over_time(S.basket_totals(spark, sf))


@register("spend_by_department", "AGG-2 JN-1", O.with_views() + f"""
SELECT department, {_rc('spend')} AS spend FROM (
  SELECT p.department, CAST(SUM(t.spend) AS DOUBLE) AS spend
  FROM transactions t JOIN products p ON p.product_num = t.product_num
  GROUP BY p.department ORDER BY spend DESC, department LIMIT 10)""")
def q_spend_by_department(spark, sf):
    return D.spend_by_department(S.transactions(spark, sf, ["product_num", "spend"]),
                                 S.products(spark, sf))


@register("brand_mix", "AGG-3", O.with_views() + f"""
SELECT p.brand_type, {_rc('CAST(SUM(t.spend) AS DOUBLE)')} AS spend
FROM transactions t JOIN products p ON p.product_num = t.product_num
GROUP BY p.brand_type""")
def q_brand_mix(spark, sf):
    return D.brand_mix(S.transactions(spark, sf, ["product_num", "spend"]), S.products(spark, sf))


@register("organic_mix", "AGG-4", O.with_views() + f"""
SELECT p.is_organic AS organic, {_rc('CAST(SUM(t.spend) AS DOUBLE)')} AS spend
FROM transactions t JOIN products p ON p.product_num = t.product_num
GROUP BY p.is_organic""")
def q_organic_mix(spark, sf):
    return D.organic_mix(S.transactions(spark, sf, ["product_num", "spend"]), S.products(spark, sf))


_INCOME = O.with_views() + f"""
SELECT COALESCE(h.income_range, 'Unknown') AS income_range,
       {_rc('CAST(SUM(t.spend) AS DOUBLE)')} AS spend,
       CAST(COUNT(DISTINCT t.hshd_num) AS BIGINT) AS households
FROM transactions t JOIN households h ON h.hshd_num = t.hshd_num
GROUP BY 1"""

_LOYALTY = O.with_views() + f"""
SELECT h.loyalty_flag AS loyal,
       {_rc('CAST(SUM(t.spend) AS DOUBLE)')} AS spend,
       CAST(COUNT(DISTINCT t.hshd_num) AS BIGINT) AS households
FROM transactions t JOIN households h ON h.hshd_num = t.hshd_num
GROUP BY 1"""


@register("spend_by_income", "AGG-5 SC-8", _INCOME)
def q_spend_by_income(spark, sf):
    return D.spend_by_income(S.basket_totals(spark, sf),
                             S.households(spark, sf))


@register("spend_by_loyalty", "AGG-6", _LOYALTY)
def q_spend_by_loyalty(spark, sf):
    return D.spend_by_loyalty(S.basket_totals(spark, sf),
                              S.households(spark, sf))


def _avg(spend: str, hh: str) -> str:
    return f"CASE WHEN {hh} > 0 THEN {_rc(f'{spend} / {hh}')} ELSE 0.0 END"


@register("income_engagement", "AGG-7", f"""
SELECT income_range, {_avg('spend', 'households')} AS avg_spend_per_household, households
FROM ({_INCOME})""")
def q_income_engagement(spark, sf):
    return D.income_engagement(S.basket_totals(spark, sf),
                               S.households(spark, sf))


@register("loyalty_engagement", "AGG-7", f"""
SELECT loyal, {_avg('spend', 'households')} AS avg_spend_per_household, households
FROM ({_LOYALTY})""")
def q_loyalty_engagement(spark, sf):
    return D.loyalty_engagement(S.basket_totals(spark, sf),
                                S.households(spark, sf))


@register("mix_labels", "PRJ-6", O.with_views() + f"""
SELECT 'organic' AS panel, CASE WHEN p.is_organic THEN 'Organic' ELSE 'Non-organic' END AS label,
       {_rc('CAST(SUM(t.spend) AS DOUBLE)')} AS value
FROM transactions t JOIN products p ON p.product_num = t.product_num GROUP BY p.is_organic
UNION ALL
SELECT 'loyalty', CASE WHEN loyal THEN 'Member' ELSE 'Non-member' END,
       {_avg('spend', 'households')}
FROM (SELECT h.loyalty_flag AS loyal, {_rc('CAST(SUM(t.spend) AS DOUBLE)')} AS spend,
             COUNT(DISTINCT t.hshd_num) AS households
      FROM transactions t JOIN households h ON h.hshd_num = t.hshd_num GROUP BY 1)""")
def q_mix_labels(spark, sf):
    return D.mix_labels(S.transactions(spark, sf, ["product_num", "hshd_num", "spend"]),
                        S.products(spark, sf), S.households(spark, sf))


DASHBOARD_SUMMARY_SQL = O.with_views() + f""",
hh AS (SELECT h.income_range, h.loyalty_flag, t.hshd_num, SUM(t.spend) AS spend
       FROM transactions t JOIN households h ON h.hshd_num = t.hshd_num GROUP BY 1, 2, 3)
SELECT 'spend_over_time' AS panel, strftime(purchase_date, '%Y-%m') AS label,
       {_rc('CAST(SUM(spend) AS DOUBLE)')} AS value, CAST(NULL AS BIGINT) AS households
FROM transactions GROUP BY 2
UNION ALL
SELECT 'spend_by_department', department, {_rc('spend')}, NULL FROM (
  SELECT p.department, CAST(SUM(t.spend) AS DOUBLE) AS spend
  FROM transactions t JOIN products p ON p.product_num = t.product_num
  GROUP BY p.department ORDER BY spend DESC, department LIMIT 10)
UNION ALL
SELECT 'brand_mix', p.brand_type, {_rc('CAST(SUM(t.spend) AS DOUBLE)')}, NULL
FROM transactions t JOIN products p ON p.product_num = t.product_num GROUP BY p.brand_type
UNION ALL
SELECT 'organic_mix', CAST(p.is_organic AS VARCHAR), {_rc('CAST(SUM(t.spend) AS DOUBLE)')}, NULL
FROM transactions t JOIN products p ON p.product_num = t.product_num GROUP BY p.is_organic
UNION ALL
SELECT 'spend_by_income', income_range, {_avg('spend', 'households')}, households FROM (
  SELECT COALESCE(income_range, 'Unknown') AS income_range,
         {_rc('CAST(SUM(spend) AS DOUBLE)')} AS spend, COUNT(*) AS households
  FROM hh GROUP BY 1)
UNION ALL
SELECT 'loyalty', CAST(loyal AS VARCHAR), {_avg('spend', 'households')}, households FROM (
  SELECT loyalty_flag AS loyal, {_rc('CAST(SUM(spend) AS DOUBLE)')} AS spend,
         COUNT(*) AS households
  FROM hh GROUP BY 1)"""


def dashboard_summary(spark, sf):
    return D.dashboard_summary(
        S.transactions(spark, sf, ["product_num", "spend"]),
        S.basket_totals(spark, sf),
        S.households(spark, sf), S.products(spark, sf))


register("dashboard_summary", "AGG-8", DASHBOARD_SUMMARY_SQL)(dashboard_summary)


@register("basket_lines", "SRC-2 JN-1", O.with_views() + """
SELECT t.basket_num, t.hshd_num, t.product_num, t.purchase_date,
       CAST(t.spend AS DOUBLE) AS spend, t.units,
       p.commodity, p.department, p.brand_type, p.is_organic
FROM transactions t JOIN products p ON p.product_num = t.product_num""")
def q_basket_lines(spark, sf):
    from cartwise.sources.lines import basket_lines
    return basket_lines(S.transactions(spark, sf, ["basket_num", "hshd_num", "product_num",
                                                   "purchase_date", "spend", "units"]),
                        S.products(spark, sf)).withColumn("spend", F.col("spend").cast("double"))


@register("household_activity", "SRC-3 JN-2", O.with_views() + """
SELECT t.hshd_num, t.basket_num, t.purchase_date, CAST(t.spend AS DOUBLE) AS spend,
       h.loyalty_flag, h.income_range, h.hh_size, h.children
FROM transactions t JOIN households h ON h.hshd_num = t.hshd_num""")
def q_household_activity(spark, sf):
    from cartwise.sources.lines import household_activity
    return household_activity(S.transactions(spark, sf, ["hshd_num", "basket_num",
                                                         "purchase_date", "spend"]),
                              S.households(spark, sf)).withColumn("spend", F.col("spend").cast("double"))


@register("table_row_counts", "SRC-4", O.with_views() + """
SELECT 'households' AS table_name, COUNT(*) AS row_count FROM households
UNION ALL SELECT 'products', COUNT(*) FROM products
UNION ALL SELECT 'transactions', COUNT(*) FROM transactions""")
def q_table_row_counts(spark, sf):
    from cartwise.sources.lines import table_row_counts
    return table_row_counts(S.households(spark, sf), S.products(spark, sf),
                            S.transactions(spark, sf, ["basket_num"]))
