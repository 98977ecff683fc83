"""Basket queries: itemsets, frequencies, one-hot, FP-growth, rules, co-purchase."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise import oracle as O
from cartwise.functions.text import join_list
from cartwise.operators import baskets as B
from cartwise.operators import serving as V
from cartwise.plans import basket_job as J
from cartwise.plans import results as R
from cartwise.plans.registry import register
from cartwise.session import scratch_dir, stage

BI = """bi AS (SELECT DISTINCT t.basket_num, p.commodity AS item
       FROM transactions t JOIN products p ON p.product_num = t.product_num
       WHERE p.commodity IS NOT NULL)"""
NB = f"""nb AS (SELECT count(DISTINCT basket_num) AS n,
              CAST(ceil({B.MIN_SUPPORT} * count(DISTINCT basket_num)) AS BIGINT) AS minc FROM bi)"""


# Level by level, as far as there are frequent itemsets: a turn extends each basket's last
# level by its later items and keeps what enough baskets hold.
FI = ["""occ AS (SELECT basket_num, [item] AS items, item AS last FROM (
         SELECT *, count(*) OVER (PARTITION BY item) AS n FROM bi) WHERE n >= (SELECT minc FROM nb)
       UNION ALL SELECT basket_num, items, last FROM (
         SELECT o.basket_num, list_append(o.items, b.item) AS items, b.item AS last,
                count(*) OVER (PARTITION BY list_append(o.items, b.item)) AS n
         FROM occ o JOIN bi b ON b.basket_num = o.basket_num AND b.item > o.last)
       WHERE n >= (SELECT minc FROM nb))""",
      "fi AS MATERIALIZED (SELECT items, array_to_string(items, chr(1)) AS k, count(*) AS freq FROM occ GROUP BY items)"]
RULES = """sub AS MATERIALIZED (SELECT items, freq, mask,
         list_filter(items, lambda x, i: ((mask >> (i - 1)) & 1) = 1) AS ante,
         list_filter(items, lambda x, i: ((mask >> (i - 1)) & 1) = 0) AS cons
       FROM (SELECT items, freq, unnest(range(1, (CAST(1 AS BIGINT) << len(items)) - 1)) AS mask
             FROM fi WHERE len(items) >= 2)),
r0 AS (SELECT s.ante, s.cons, CAST(s.freq AS DOUBLE) / nb.n AS support,
              CAST(a.freq AS DOUBLE) / nb.n AS sa, CAST(c.freq AS DOUBLE) / nb.n AS sc
       FROM sub s JOIN fi a ON a.k = array_to_string(s.ante, chr(1))
       JOIN fi c ON c.k = array_to_string(s.cons, chr(1)), nb),
r1 AS (SELECT ante, cons, support, support / sa AS confidence, (support / sa) / sc AS lift FROM r0),
ranked AS (SELECT array_to_string(ante, ', ') AS antecedents, array_to_string(cons, ', ') AS consequents,
                  support, confidence, lift FROM r1
           WHERE lift >= 1.0 AND confidence >= 0.05
           ORDER BY lift DESC, confidence DESC, support DESC, antecedents, consequents LIMIT 50)"""
RULE_COLS = (f"antecedents, consequents, {O.round4('support')} AS support, "
             f"{O.round4('confidence')} AS confidence, {O.round4('lift')} AS lift")


def mining_sql(*extra: str) -> str:
    return O.with_views(BI, NB, *FI, *extra).replace("WITH ", "WITH RECURSIVE ", 1)


def _pairs(spark, sf):
    return B.basket_items(J.lines_frame(spark, sf))


@register("basket_itemsets", "AGG-12 FLT-5 SC-12", O.with_views(BI) + """
SELECT basket_num, array_to_string(list_sort(list(item)), ', ') AS items, count(*) AS n_items
FROM bi GROUP BY basket_num""")
def q_basket_itemsets(spark, sf):
    s = B.basket_itemsets(J.lines_frame(spark, sf))
    return s.select("basket_num", join_list("items").alias("items"),
                    F.size("items").cast("bigint").alias("n_items"))


@register("item_frequency", "AGG-13", O.with_views(BI) + """
SELECT item AS commodity, count(*) AS baskets FROM bi GROUP BY item""")
def q_item_frequency(spark, sf):
    return B.item_frequency(_pairs(spark, sf))


@register("target_commodity", "AGG-13", O.with_views(BI) + """
SELECT item AS commodity, count(*) AS baskets FROM bi GROUP BY item
ORDER BY baskets DESC, commodity LIMIT 1""")
def q_target_commodity(spark, sf):
    return B.target_item(B.item_frequency(_pairs(spark, sf)))


@register("basket_onehot", "ML-1", O.with_views(BI) + """,
voc AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM bi))
SELECT basket_num, string_agg(CAST(idx AS VARCHAR), ', ' ORDER BY idx) AS indices,
       (SELECT count(*) FROM voc) AS width
FROM bi JOIN voc USING (item) GROUP BY basket_num""")
def q_basket_onehot(spark, sf):
    oh = B.onehot_indices(stage(_pairs(spark, sf), "basket-items"))
    return oh.select("basket_num", F.array_join(F.transform("indices", lambda x: x.cast("string")),
                                                ", ").alias("indices"), "width")


@register("frequent_itemsets", "ML-2", mining_sql() + """
SELECT array_to_string(items, ', ') AS items, CAST(len(items) AS INTEGER) AS size,
       freq, CAST(freq AS DOUBLE) / (SELECT n FROM nb) AS support FROM fi""")
def q_frequent_itemsets(spark, sf):
    itemsets = stage(B.basket_itemsets(J.lines_frame(spark, sf)), "itemsets")  # counted, mined
    n = itemsets.count()
    fi = B.frequent_itemsets(itemsets)
    return fi.select(join_list("items").alias("items"), F.size("items").alias("size"), "freq",
                     (F.col("freq") / F.lit(float(n))).alias("support"))


@register("basket_rules", "ML-3 JN-9 FLT-4 SRT-6 SC-11 SC-12 SNK-2", mining_sql(RULES)
          + f"SELECT {RULE_COLS} FROM ranked")
def q_basket_rules(spark, sf):
    rules, _ = J.mine(spark, sf)
    root = scratch_dir(spark, "rules")      # written as a result table and read back
    R.replace_result(rules, root, "basket_rules")
    return J.rules_as_text(R.read_result(spark, root, "basket_rules"))


@register("top_rules", "SRT-5 ML-10", mining_sql(RULES) + f"""
SELECT * FROM (SELECT {RULE_COLS} FROM ranked)
ORDER BY lift DESC, confidence DESC, support DESC, antecedents, consequents
LIMIT 25""")
def q_top_rules(spark, sf):
    rules, _ = J.mine(spark, sf)
    return V.top_rules(J.rules_as_text(rules))


@register("pair_rules", "ML-4", O.with_views(BI) + f""",
nb AS (SELECT count(DISTINCT basket_num) AS n,
              CAST(ceil({B.MIN_SUPPORT} * count(DISTINCT basket_num)) AS BIGINT) AS minc FROM bi),
ic AS (SELECT item, count(*) AS n_item FROM bi GROUP BY item),
co AS (SELECT a.item AS x, b.item AS y, count(*) AS n_xy FROM bi a JOIN bi b
         ON a.basket_num = b.basket_num AND a.item < b.item GROUP BY 1, 2
       HAVING count(*) >= (SELECT minc FROM nb)),
both_ways AS (SELECT x AS ante, y AS cons, n_xy FROM co UNION ALL SELECT y, x, n_xy FROM co),
r AS (SELECT ante, cons, CAST(n_xy AS DOUBLE) / nb.n AS support,
             CAST(ia.n_item AS DOUBLE) / nb.n AS sa, CAST(ic2.n_item AS DOUBLE) / nb.n AS sc
      FROM both_ways JOIN ic ia ON ia.item = ante JOIN ic ic2 ON ic2.item = cons, nb)
SELECT ante AS antecedent, cons AS consequent, support, support / sa AS confidence,
       (support / sa) / sc AS lift
FROM r WHERE (support / sa) / sc >= 1.0 AND support / sa >= 0.05""")
def q_pair_rules(spark, sf):
    itemsets = stage(B.basket_itemsets(J.lines_frame(spark, sf)), "itemsets")  # counted, paired
    return B.pair_rules(itemsets, itemsets.count())


@register("copurchase_dataset", "ML-5", O.with_views(BI) + """,
tgt AS (SELECT item FROM bi GROUP BY item ORDER BY count(*) DESC, item LIMIT 1),
its AS (SELECT basket_num, list_sort(list(item)) AS items FROM bi GROUP BY basket_num)
SELECT basket_num, CAST(list_contains(items, tgt.item) AS INTEGER) AS label,
       array_to_string(list_filter(items, lambda x, i: x <> tgt.item), ', ') AS features
FROM its, tgt""")
def q_copurchase_dataset(spark, sf):
    itemsets = stage(B.basket_itemsets(J.lines_frame(spark, sf)), "itemsets")
    top = B.target_item(B.item_frequency(itemsets.select(F.explode("items").alias("item")))).first()
    rows = B.copurchase_rows(itemsets, top["commodity"] if top else "")
    return rows.select("basket_num", "label", F.array_join("other_items", ", ").alias("features"))


@register("basket_summary", "SNK-9", O.with_views(BI) + """
SELECT (SELECT count(*) FROM transactions t JOIN products p ON p.product_num = t.product_num)
         AS lines,
       (SELECT count(DISTINCT basket_num) FROM bi) AS baskets,
       (SELECT count(DISTINCT item) FROM bi) AS commodities""")
def q_basket_summary(spark, sf):
    return J.basket_summary(J.lines_frame(spark, sf))


@register("copurchase_model", "ML-5 ML-6 ML-7 SPL-1 SRT-9")
def q_copurchase_model(spark, sf):
    return J.copurchase_model(spark, sf)
