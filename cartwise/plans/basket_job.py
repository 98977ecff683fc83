"""The basket job: lines -> itemsets -> FP-growth -> rules, and the co-purchase model.

Outputs are the two result tables (``basket_rules`` and ``basket_model_metric``);
only scalars (basket count, target item, vocabulary size, metric row, importances of
the items that trees use) reach the driver.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.functions.numeric import round4
from cartwise.functions.text import join_list
from cartwise.operators import baskets as B
from cartwise.operators import evaluate as E
from cartwise.plans.churn_job import gbt, top_drivers
from cartwise.session import shared_root, stage
from cartwise.sources import tables as S

TOP_DRIVERS = 8
DEFAULT_ITERATIONS = 100
FEATURE_ROWS = T.StructType([
    T.StructField("basket_num", T.LongType()), T.StructField("label", T.IntegerType()),
    T.StructField("features", VectorUDT())])
ALIKE_ROWS = T.StructType([
    T.StructField("label", T.IntegerType()), T.StructField("is_test", T.BooleanType()),
    T.StructField("features", VectorUDT()), T.StructField("baskets", T.DoubleType())])


def lines_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = S.transactions(spark, sf_dir, ["basket_num", "product_num"])
    return tx.join(S.products(spark, sf_dir).select("product_num", "commodity"), "product_num")


def mine(spark: SparkSession, sf_dir: str, top: int = B.TOP_RULES) -> tuple[DataFrame, int]:
    """(ranked rules with array sides, basket count) over the driver tables."""
    return mine_lines(lines_frame(spark, sf_dir), top)


def mine_lines(lines: DataFrame, top: int = B.TOP_RULES) -> tuple[DataFrame, int]:
    """(ranked rules with array sides, basket count) from (basket_num, commodity) lines."""
    spark = lines.sparkSession
    itemsets = stage(B.basket_itemsets(lines), "itemsets")   # counted, then mined
    n = itemsets.count()
    if n == 0:
        return spark.createDataFrame([], B.RULES_SCHEMA), 0
    shared_root(spark)
    freq = B.frequent_itemsets(itemsets).checkpoint()   # small; read three times by the rules
    rules = B.rank_rules(B.association_rules(freq, n), top=top)
    return rules, n


def basket_summary(lines: DataFrame) -> DataFrame:
    """One row: lines, baskets with an item, distinct items. Lines are combined to one row
    per basket, once; both counts are read from those."""
    per_basket = stage(lines.groupBy("basket_num").agg(
        F.count(F.lit(1)).alias("lines"), F.collect_set("commodity").alias("items")), "basket-summary")
    distinct = (per_basket.select(F.explode("items").alias("item")).distinct()
                .agg(F.count(F.lit(1)).alias("commodities")).first()[0])
    return per_basket.agg(F.coalesce(F.sum("lines"), F.lit(0)).cast("bigint").alias("lines"),
                          F.count_if(F.size("items") > 0).alias("baskets")).withColumn(
        "commodities", F.lit(distinct).cast("bigint"))


def copurchase_model(spark: SparkSession, sf_dir: str,
                     iterations: int = DEFAULT_ITERATIONS) -> DataFrame:
    """Metric row (target, accuracy, AUC, top drivers) or an empty frame."""
    return copurchase_lines(lines_frame(spark, sf_dir), iterations)


def copurchase_lines(lines: DataFrame, iterations: int = DEFAULT_ITERATIONS) -> DataFrame:
    """The co-purchase model from (basket_num, commodity) lines, which are read once."""
    spark = lines.sparkSession
    empty = spark.createDataFrame([], "target_commodity string, accuracy double, "
                                      "roc_auc double, top_drivers string")
    itemsets = stage(B.basket_itemsets(lines), "itemsets")
    pairs = itemsets.select("basket_num", F.explode("items").alias("item"))
    top = B.target_item(B.item_frequency(pairs)).first()
    if top is None:
        return empty
    target = top["commodity"]
    rows = B.copurchase_rows(itemsets, target)
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return empty
    index = B.vocabulary_index(pairs.where(F.col("item") != target))
    width = index.count()
    if width == 0:
        return empty
    split = alike(E.stratified_split(stage(B.sparse_features(rows, index, width), "copurchase-rows"),
                                     "basket_num", "label"))
    model = gbt(iterations, label="label_d", weight="baskets").fit(split.where(~F.col("is_test")))
    test = model.transform(split.where(F.col("is_test"))).withColumn(
        "p1", vector_to_array("probability")[1])
    acc = E.accuracy(test, "label_d", "prediction", "baskets").first()["accuracy"]
    auc = E.roc_auc(test, "label", "p1", weight_col="baskets").first()["roc_auc"]
    drivers = item_drivers(model.featureImportances, index)
    row = spark.createDataFrame([(target, float(acc), None if auc is None else float(auc),
                                  ", ".join(drivers))],
                                "target_commodity string, accuracy double, roc_auc double, "
                                "top_drivers string")
    return row.select("target_commodity", round4("accuracy").alias("accuracy"),
                      round4("roc_auc").alias("roc_auc"), "top_drivers")


def alike(split: DataFrame) -> DataFrame:
    """Split baskets with the same items, label and part as one row with their number
    (``baskets``), which the fit and the metrics take as its weight: the trees read each of
    these rows hundreds of times. Stored, and read back with the vector type over the
    stored layout."""
    rows = (split.groupBy("label", "is_test", "features")
            .agg(F.count(F.lit(1)).cast("double").alias("baskets")))
    return stage(rows, "copurchase-alike", ALIKE_ROWS).withColumn("label_d", F.col("label").cast("double"))


def item_drivers(importances, index: DataFrame, k: int = TOP_DRIVERS) -> list[str]:
    """The ``k`` most important items (ties by name). Only items that a tree uses have an
    importance; those and the first ``k`` by name, which fill up, are looked up."""
    used = {int(i): float(v) for i, v in zip(importances.indices, importances.values) if v}
    wanted = sorted({*used, *range(len(used) + k)})
    names = {r["index"]: r["item"] for r in index.where(F.col("index").isin(wanted)).collect()}
    return top_drivers([used.get(i, 0.0) for i in names], list(names.values()), k)


def rules_as_text(rules: DataFrame) -> DataFrame:
    return rules.select(join_list("antecedents").alias("antecedents"),
                        join_list("consequents").alias("consequents"),
                        "support", "confidence", "lift")
