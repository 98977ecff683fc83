"""Household pull queries (SRT-1..3, FLT-1/2, JN-5/6, AGG-9/10, PRJ-4, SC-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise import oracle as O
from cartwise.operators import pull as P
from cartwise.plans import q_churn as QC
from cartwise.plans.registry import register
from cartwise.sources import tables as S

DEMO_HOUSEHOLD = 10
DEMO_PAGE = 2
DEMO_PAGE_SIZE = 10
# Household numbers asked for by the existence check: one known, one never issued.
LOOKUP_HOUSEHOLDS = [DEMO_HOUSEHOLD, -1]

_TEXT = ("CASE WHEN instr(CAST(t.spend AS VARCHAR), '.') > 0 THEN "
         "regexp_replace(regexp_replace(CAST(t.spend AS VARCHAR), '0+$', ''), '\\.$', '') "
         "ELSE CAST(t.spend AS VARCHAR) END")
_PULL_COLS = f"""t.hshd_num, t.basket_num, t.purchase_date, t.product_num, p.department,
       p.commodity, {_TEXT} AS spend, t.units, t.store_region, t.week_num, t.year"""
_ORDER = ("t.hshd_num, t.basket_num, t.purchase_date, t.product_num, p.department, p.commodity, "
          "t.spend, t.units, t.store_region, t.week_num, t.year")


def _pull_sql(where: str, tail: str = "") -> str:
    return O.with_views() + f"""SELECT {_PULL_COLS}
FROM transactions t JOIN products p ON p.product_num = t.product_num
{where} ORDER BY {_ORDER} {tail}"""


@register("household_pull", "SRT-1 FLT-1 JN-5 PRJ-4 SC-16",
          _pull_sql(f"WHERE t.hshd_num = {DEMO_HOUSEHOLD}"))
def q_household_pull(spark, sf):
    return P.household_pull(S.household_transactions(spark, sf, DEMO_HOUSEHOLD), S.products(spark, sf),
                            DEMO_HOUSEHOLD)


@register("household_pull_page", "SRT-2",
          _pull_sql(f"WHERE t.hshd_num = {DEMO_HOUSEHOLD}",
                    f"LIMIT {DEMO_PAGE_SIZE} OFFSET {(DEMO_PAGE - 1) * DEMO_PAGE_SIZE}"))
def q_household_pull_page(spark, sf):
    return P.household_pull_page(S.household_transactions(spark, sf, DEMO_HOUSEHOLD),
                                 S.products(spark, sf), DEMO_HOUSEHOLD, DEMO_PAGE, DEMO_PAGE_SIZE)


@register("data_pull_all", "SRT-3", _pull_sql(""))
def q_data_pull_all(spark, sf):
    return P.data_pull_all(S.transactions(spark, sf), S.products(spark, sf))


@register("household_line_count", "AGG-9 AGG-10", O.with_views() + """
SELECT h.hshd_num, CAST(coalesce(n.total, 0) AS BIGINT) AS total,
       CAST(greatest(1, ceil(coalesce(n.total, 0) / 50.0)) AS BIGINT) AS pages
FROM households h LEFT JOIN (SELECT hshd_num, count(*) AS total FROM transactions GROUP BY 1) n
  ON n.hshd_num = h.hshd_num""")
def q_household_line_count(spark, sf):
    return P.household_line_counts(S.basket_totals(spark, sf), S.households(spark, sf))


@register("household_exists", "FLT-2", QC.churn_sql(QC.SCORE, QC.STORED) + f""",
req AS (SELECT * FROM (VALUES {', '.join(f'({h})' for h in LOOKUP_HOUSEHOLDS)}) r(hshd_num))
SELECT CAST(r.hshd_num AS BIGINT) AS hshd_num,
       EXISTS (SELECT 1 FROM households h WHERE h.hshd_num = r.hshd_num) AS exists,
       hc.churn_probability, hc.risk_band
FROM req r LEFT JOIN hc ON hc.hshd_num = r.hshd_num""")
def q_household_exists(spark, sf):
    return P.household_exists(S.households(spark, sf), QC.stored_scores(spark, sf), LOOKUP_HOUSEHOLDS)


@register("household_pull_risk", "JN-6", QC.churn_sql(QC.SCORE, QC.STORED) + f"""
SELECT {_PULL_COLS}, hc.churn_probability, hc.risk_band
FROM transactions t JOIN products p ON p.product_num = t.product_num
LEFT JOIN hc ON hc.hshd_num = t.hshd_num
WHERE t.hshd_num = {DEMO_HOUSEHOLD}""")
def q_household_pull_risk(spark, sf):
    scores = QC.stored_scores(spark, sf).where(F.col("hshd_num") == DEMO_HOUSEHOLD)
    return P.household_pull(S.household_transactions(spark, sf, DEMO_HOUSEHOLD), S.products(spark, sf),
                            DEMO_HOUSEHOLD, scores)
