"""Market-basket mining: itemsets, item frequency, one-hot, frequent itemsets, rules.

Scale notes:

* Every basket is first reduced to its distinct (basket, item) pairs with a
  map-side combine, so a basket holding a third of all lines shrinks to at most
  one row per distinct item before any shuffle; an itemset is therefore bounded
  by the item vocabulary, not by the number of lines.
* Frequent itemsets come from MLlib's parallel FP-growth (conditional trees are
  distributed by item group).
* Pair rules remove infrequent items first, then count item pairs inside each
  basket's task with a map-side combine (no self-join of baskets).
* Rules expand every frequent itemset into all its non-empty proper subsets
  (bit masks over the sorted items, no cap on the itemset size) and look the
  support of both sides up with two joins on the itemset key; the itemset
  table is the only thing joined, never the baskets.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.functions.numeric import round4
from cartwise.functions.text import join_list
from cartwise.operators.numbering import dense_index
from cartwise.session import output_partitions, stage

# The reference's mining thresholds.
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.05
MIN_LIFT = 1.0
TOP_RULES = 50

RULES_SCHEMA = ("antecedents array<string>, consequents array<string>, support double, "
                "confidence double, lift double")


def basket_items(lines: DataFrame, basket_col: str = "basket_num",
                 item_col: str = "commodity") -> DataFrame:
    """Distinct (basket, item) pairs; the de-duplication is combined map-side."""
    return (lines.select(F.col(basket_col).alias("basket_num"), F.col(item_col).alias("item"))
                 .where(F.col("item").isNotNull()).distinct())


def basket_itemsets(lines: DataFrame, basket_col: str = "basket_num",
                    item_col: str = "commodity") -> DataFrame:
    """One sorted, de-duplicated itemset per basket; empty baskets dropped.

    One shuffle: ``collect_set`` de-duplicates inside the map-side partial
    aggregate, so what a basket ships is bounded by its distinct items.
    """
    items = (lines.select(F.col(basket_col).alias("basket_num"), F.col(item_col).alias("item"))
                  .where(F.col("item").isNotNull()))
    return (items.groupBy("basket_num").agg(F.array_sort(F.collect_set("item")).alias("items"))
                 .where(F.size("items") > 0))


def item_frequency(pairs: DataFrame) -> DataFrame:
    """Baskets containing each item."""
    return pairs.groupBy(F.col("item").alias("commodity")).agg(
        F.count(F.lit(1)).alias("baskets"))


def target_item(freq: DataFrame) -> DataFrame:
    """The most frequent item; on ties the first by name (columns are name-sorted)."""
    return freq.orderBy(F.desc("baskets"), F.asc("commodity")).limit(1)


def vocabulary_index(pairs: DataFrame) -> DataFrame:
    """(item, index) with items sorted by name, numbered by range (``numbering.dense_index``)."""
    return dense_index(pairs.select("item").distinct(), ["item"])


def onehot_indices(pairs: DataFrame) -> DataFrame:
    """Sparse one-hot rows: basket -> sorted column indices (columns = items by name).
    ``pairs`` is read twice (vocabulary, join): store it first."""
    idx = vocabulary_index(pairs)
    width = idx.count()  # one number: the vocabulary size
    rows = (pairs.join(idx, "item")
                 .groupBy("basket_num").agg(F.array_sort(F.collect_list("index")).alias("indices")))
    return rows.withColumn("width", F.lit(width).cast("bigint"))


def onehot_wide(pairs: DataFrame, items: list[str]) -> DataFrame:
    """Boolean column per item (for export only): pivot with the vocabulary given."""
    wide = (pairs.groupBy("basket_num").pivot("item", items)
                 .agg(F.count(F.lit(1)) > 0))
    return wide.select("basket_num", *[F.coalesce(F.col(f"`{i}`"), F.lit(False)).alias(i)
                                       for i in items])


def min_count(n_baskets: int, min_support: float = MIN_SUPPORT) -> int:
    """Support threshold as a count, inclusive: ceil(min_support * baskets)."""
    return int(math.ceil(min_support * n_baskets))


def frequent_itemsets(itemsets: DataFrame, min_support: float = MIN_SUPPORT,
                      partitions: int | None = None) -> DataFrame:
    """All itemsets in at least ``min_support`` of the baskets: (items sorted, freq)."""
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0,
                  numPartitions=partitions or output_partitions(itemsets.sparkSession))
    model = fp.fit(itemsets)
    return model.freqItemsets.select(F.array_sort("items").alias("items"),
                                     F.col("freq").cast("bigint").alias("freq"))


def association_rules(freq: DataFrame, n_baskets: int) -> DataFrame:
    """Every split of every frequent itemset (k >= 2) into non-empty sides.

    support = n(AC)/n, confidence = support / (n(A)/n), lift = confidence / (n(C)/n),
    computed in that order so threshold tests agree bit for bit with the oracle.
    """
    n = F.lit(float(n_baskets))
    multi = freq.where(F.size("items") >= 2)
    size = F.size("items")
    # The masks 1 .. 2^k - 2 as high and low bits, so no array holds them all.
    half = F.floor(size / 2)
    upto = lambda bits: F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2), bits).cast("bigint") - 1)
    masks = (multi.withColumn("high", F.explode(upto(size - half)))
             .withColumn("low", F.explode(upto(half)))
             .withColumn("mask", F.col("high") * F.pow(F.lit(2), half).cast("bigint") + F.col("low"))
             .where((F.col("mask") > 0) & (F.col("mask") < F.pow(F.lit(2), size).cast("bigint") - 1)))
    def in_antecedent(i):  # bit i of the mask set -> item i is on the left side
        return F.col("mask").bitwiseAND(F.pow(F.lit(2), i).cast("bigint")) != 0
    sides = masks.select(
        F.filter("items", lambda x, i: in_antecedent(i)).alias("antecedents"),
        F.filter("items", lambda x, i: ~in_antecedent(i)).alias("consequents"),
        "freq")
    a = freq.select(F.col("items").alias("antecedents"), F.col("freq").alias("freq_a"))
    c = freq.select(F.col("items").alias("consequents"), F.col("freq").alias("freq_c"))
    joined = sides.join(a, "antecedents").join(c, "consequents")
    support = F.col("freq") / n
    confidence = support / (F.col("freq_a") / n)
    lift = confidence / (F.col("freq_c") / n)
    return joined.select("antecedents", "consequents", support.alias("support"),
                         confidence.alias("confidence"), lift.alias("lift"))


def rank_rules(rules: DataFrame, min_lift: float = MIN_LIFT,
               min_confidence: float = MIN_CONFIDENCE, top: int = TOP_RULES) -> DataFrame:
    """Thresholds, the ``top`` rules by lift (ranked before rounding), rounded to 4 places."""
    kept = rules.where((F.col("lift") >= min_lift) & (F.col("confidence") >= min_confidence))
    ranked = kept.orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"),
                          F.asc(join_list("antecedents")), F.asc(join_list("consequents")))
    return ranked.limit(top).select(
        "antecedents", "consequents", round4("support").alias("support"),
        round4("confidence").alias("confidence"), round4("lift").alias("lift"))


def item_pairs(itemsets: DataFrame) -> DataFrame:
    """(x, y) for every two items x < y of each basket, generated inside the task
    that holds the basket (no join, no shuffle of baskets); callers aggregate them
    right away, so only combined pair counts ever leave a task. Two steps, so that no
    array holds more than the items of one basket."""
    each = itemsets.select("items", F.posexplode("items").alias("i", "x"))
    return each.select("x", F.explode(F.slice(
        "items", F.col("i") + 2, F.size("items") - F.col("i") - 1)).alias("y"))


def frequent_baskets(itemsets: DataFrame, singles: DataFrame, threshold: int) -> DataFrame:
    """Baskets reduced to their items of at least ``threshold`` baskets (baskets with fewer
    than two of them dropped): a pair cannot be more frequent than either of its items."""
    frequent = singles.where(F.col("n_item") >= threshold).select("item")
    return (itemsets.select("basket_num", F.explode("items").alias("item"))
            .join(frequent, "item", "left_semi")
            .groupBy("basket_num").agg(F.array_sort(F.collect_list("item")).alias("items"))
            .where(F.size("items") > 1))


def pair_rules(itemsets: DataFrame, n_baskets: int, min_support: float = MIN_SUPPORT,
               min_lift: float = MIN_LIFT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules with one item on each side, by a path independent of FP-growth.

    Items below the support are removed before baskets are paired, so rare items make no
    pairs however many of them a basket has; frequent items number at most (items per
    basket) / ``min_support``. Pairs are counted in the task that holds the basket, with a
    map-side combine over the sorted, de-duplicated itemsets: what is shuffled is at most
    one partial count per distinct frequent pair per task.
    """
    threshold = min_count(n_baskets, min_support)
    # One row per item; read four times.
    singles = stage(itemsets.select(F.explode("items").alias("item"))
                    .groupBy("item").agg(F.count(F.lit(1)).alias("n_item")), "item-counts")
    co = (item_pairs(frequent_baskets(itemsets, singles, threshold))
          .groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_xy"))
          .where(F.col("n_xy") >= threshold))
    both = (co.select(F.col("x").alias("ante"), F.col("y").alias("cons"), "n_xy")
              .unionByName(co.select(F.col("y").alias("ante"), F.col("x").alias("cons"), "n_xy")))
    na = singles.select(F.col("item").alias("ante"), F.col("n_item").alias("n_a"))
    nc = singles.select(F.col("item").alias("cons"), F.col("n_item").alias("n_c"))
    n = F.lit(float(n_baskets))
    r = both.join(na, "ante").join(nc, "cons")
    support = F.col("n_xy") / n
    confidence = support / (F.col("n_a") / n)
    lift = confidence / (F.col("n_c") / n)
    out = r.select(F.col("ante").alias("antecedent"), F.col("cons").alias("consequent"),
                   support.alias("support"), confidence.alias("confidence"), lift.alias("lift"))
    return out.where((F.col("lift") >= min_lift) & (F.col("confidence") >= min_confidence))


def copurchase_rows(itemsets: DataFrame, target: str) -> DataFrame:
    """label = basket contains the target; features = the other items."""
    return itemsets.select(
        "basket_num",
        F.array_contains("items", F.lit(target)).cast("int").alias("label"),
        F.array_remove("items", F.lit(target)).alias("other_items"))


def sparse_features(rows: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """(basket_num, label, features): each basket's items as a sparse 0/1 vector of ``width``
    columns, in the layout in which Spark stores ML vectors. The items meet their column
    numbers in a join, so no vocabulary passes the driver; a basket without other items is
    the zero vector."""
    items = rows.select("basket_num", "label", F.explode_outer("other_items").alias("item"))
    grouped = (items.join(index.select("item", F.col("index").cast("int").alias("index")), "item", "left")
               .groupBy("basket_num", "label").agg(F.array_sort(F.collect_list("index")).alias("indices")))
    return grouped.select("basket_num", "label", F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(width).cast("int").alias("size"), "indices",
        F.transform("indices", lambda i: F.lit(1.0)).alias("values")).alias("features"))
