"""DuckDB oracle SQL: the retail views and helpers shared by every oracle query.

The driver registers the raw tables (customer, part, orders, lineitem, nation,
region, ...) as DuckDB views; each oracle query starts with ``WITH`` + these view
definitions, written independently of the Spark code from the mapping rules in
``cartwise.sources.tables``.
"""

from __future__ import annotations

from cartwise.sources import tables as T


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _demo(name: str, values: list[str], every: int) -> str:
    return (f"CASE WHEN c_custkey % {every} = 0 THEN NULL "
            f"ELSE {_sql_list(values)}[c_custkey % {len(values)} + 1] END AS {name}")


def _income() -> str:
    parts = []
    for upper, label in T.INCOME_BANDS:
        parts.append(f"WHEN c_acctbal < {upper} THEN " + ("NULL" if label is None else f"'{label}'"))
    return "CASE " + " ".join(parts) + f" ELSE '{T.INCOME_TOP}' END"


def _households() -> str:
    d = {name: _demo(name, values, every) for name, values, every in T.DEMOGRAPHICS}
    return f"""households AS (
  SELECT c_custkey AS hshd_num,
         c_mktsegment IN ('HOUSEHOLD', 'BUILDING') AS loyalty_flag,
         {d['age_range']}, {d['marital']},
         {_income()} AS income_range,
         {d['homeowner']}, {d['hshd_composition']}, {d['hh_size']}, {d['children']}
  FROM customer)"""


PRODUCTS = f"""products AS (
  SELECT p_partkey AS product_num, p_type AS department, p_brand AS commodity,
         CASE WHEN p_size <= {T.PRIVATE_MAX_SIZE} THEN 'PRIVATE' ELSE 'NATIONAL' END AS brand_type,
         p_size % {T.ORGANIC_SIZE_STEP} = 0 AS is_organic
  FROM part)"""

TRANSACTIONS = """transactions AS (
  SELECT l_orderkey AS basket_num, o_custkey AS hshd_num,
         CAST(o_orderdate AS DATE) AS purchase_date, l_partkey AS product_num,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS spend, CAST(l_quantity AS INTEGER) AS units,
         r_name AS store_region, CAST(weekofyear(o_orderdate) AS INTEGER) AS week_num,
         CAST(year(o_orderdate) AS INTEGER) AS year
  FROM lineitem
  LEFT JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey)"""

VIEWS = "WITH " + ",\n".join([_households(), PRODUCTS, TRANSACTIONS])


def with_views(*ctes: str) -> str:
    """``WITH <retail views>, <extra ctes>`` prefix for an oracle query."""
    return VIEWS + "".join(",\n" + c for c in ctes) + "\n"


def round_cents(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def round4(x: str) -> str:
    """Half away from zero on the decimal value of the double (as Spark's round)."""
    return f"CAST(round(CAST(({x}) AS DECIMAL(38,18)), 4) AS DOUBLE)"


def round6(x: str) -> str:
    return f"CAST(round(CAST(({x}) AS DECIMAL(38,18)), 6) AS DOUBLE)"
