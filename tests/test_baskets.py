"""Basket features (F3), rule mining against brute force, and the two mining paths."""

import itertools
import math

from pyspark.sql import functions as F

from cartwise.operators import baskets as B
from cartwise.plans import basket_job as J
from conftest import SMALL_SF


def test_itemsets_and_onehot(spark):
    lines = spark.createDataFrame(
        [(1, "BREAD"), (1, "MILK"), (1, "BREAD"), (2, "MILK"), (2, "EGGS")],
        "basket_num long, commodity string")
    got = {r["basket_num"]: r["items"] for r in B.basket_itemsets(lines).collect()}
    assert got == {1: ["BREAD", "MILK"], 2: ["EGGS", "MILK"]}
    pairs = B.basket_items(lines)
    oh = {r["basket_num"]: (r["indices"], r["width"]) for r in B.onehot_indices(pairs).collect()}
    # columns sorted by name: BREAD 0, EGGS 1, MILK 2
    assert oh == {1: ([0, 2], 3), 2: ([1, 2], 3)}
    wide = B.onehot_wide(pairs, ["BREAD", "EGGS", "MILK"]).orderBy("basket_num").collect()
    assert [(r["BREAD"], r["MILK"]) for r in wide] == [(True, True), (False, True)]


def brute_force_rules(baskets, min_support):
    n = len(baskets)
    sets = [frozenset(b) for b in baskets]
    items = sorted(set().union(*sets))
    count = {}
    for k in range(1, len(items) + 1):
        found = False
        for combo in itertools.combinations(items, k):
            c = sum(1 for s in sets if set(combo) <= s)
            if c >= math.ceil(min_support * n):
                count[frozenset(combo)] = c
                found = True
        if not found:
            break
    rules = set()
    for iset, c in count.items():
        if len(iset) < 2:
            continue
        for r in range(1, len(iset)):
            for ante in itertools.combinations(sorted(iset), r):
                a = frozenset(ante)
                cons = iset - a
                support = c / n
                confidence = support / (count[a] / n)
                lift = confidence / (count[cons] / n)
                rules.add((tuple(sorted(a)), tuple(sorted(cons)), round(support, 6),
                           round(confidence, 6), round(lift, 6)))
    return count, rules


def test_rules_match_brute_force(spark):
    baskets = [["A", "B", "C"], ["A", "B"], ["A", "C"], ["B", "C", "D"], ["A", "B", "C", "D"],
               ["D"], ["A", "D"], ["B", "C"]]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)],
                               "basket_num long, items array<string>")
    min_support = 0.25
    freq = B.frequent_itemsets(df, min_support)
    count, expected = brute_force_rules(baskets, min_support)
    got_freq = {frozenset(r["items"]): r["freq"] for r in freq.collect()}
    assert got_freq == count
    rules = B.association_rules(freq, len(baskets)).collect()
    got = {(tuple(r["antecedents"]), tuple(r["consequents"]), round(r["support"], 6),
            round(r["confidence"], 6), round(r["lift"], 6)) for r in rules}
    assert got == expected


def test_pair_rules_agree_with_fpgrowth_rules(spark):
    lines = J.lines_frame(spark, SMALL_SF)
    itemsets = B.basket_itemsets(lines)
    n = itemsets.count()
    all_rules = B.association_rules(B.frequent_itemsets(itemsets), n)
    kept = all_rules.where((F.col("lift") >= 1.0) & (F.col("confidence") >= 0.05)
                           & (F.size("antecedents") == 1) & (F.size("consequents") == 1))
    a = {(r["antecedents"][0], r["consequents"][0], r["support"], r["confidence"], r["lift"])
         for r in kept.collect()}
    pairs = B.pair_rules(itemsets, n).collect()
    b = {(r["antecedent"], r["consequent"], r["support"], r["confidence"], r["lift"]) for r in pairs}
    assert a == b and len(a) > 0


def test_item_pairs_hot_basket(spark):
    """A basket with many repeated lines yields each pair once."""
    lines = spark.createDataFrame([(1, c) for c in ["A", "B", "C"] * 500] + [(2, "A"), (2, "C")],
                                  "basket_num long, commodity string")
    got = sorted(tuple(r) for r in B.item_pairs(B.basket_itemsets(lines)).collect())
    assert got == [("A", "B"), ("A", "C"), ("A", "C"), ("B", "C")]


def test_rank_rules_orders_before_rounding(spark):
    rules = spark.createDataFrame(
        [(["BREAD"], ["MILK"], 0.02, 0.3, 1.5), (["PASTA", "PASTA SAUCE"], ["PARMESAN"], 0.01, 0.4, 4.2),
         (["EGGS"], ["BACON"], 0.015, 0.25, 2.1), (["X"], ["Y"], 0.5, 0.01, 9.0),
         (["Y"], ["X"], 0.5, 0.9, 0.99)], B.RULES_SCHEMA)
    got = [r["lift"] for r in B.rank_rules(rules).collect()]
    assert got == [4.2, 2.1, 1.5]


def test_rare_items_make_no_pairs(spark):
    """A basket of 6,000 items that no other basket holds is pruned before pairing; rules stay."""
    rows = [(0, [f"rare{i:05d}" for i in range(6000)] + ["MILK", "BREAD"])]
    rows += [(i, ["BREAD", "MILK"] if i % 2 else ["BREAD", "EGGS"]) for i in range(1, 2001)]
    itemsets = spark.createDataFrame([(b, sorted(x)) for b, x in rows], "basket_num long, items array<string>")
    singles = itemsets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    kept = B.frequent_baskets(itemsets, singles, B.min_count(2001))
    assert kept.where("basket_num = 0").first()["items"] == ["BREAD", "MILK"]
    assert B.item_pairs(kept).count() == 2001
    got = {(r["antecedent"], r["consequent"]) for r in B.pair_rules(itemsets, 2001).collect()}
    assert got == {("BREAD", "EGGS"), ("EGGS", "BREAD"), ("BREAD", "MILK"), ("MILK", "BREAD")}


def test_sparse_features_need_no_vocabulary_on_the_driver(spark):
    """Vectors equal those of a vectorizer that is given the vocabulary."""
    from pyspark.ml.feature import CountVectorizerModel
    from cartwise.session import stage
    baskets = [(1, ["A", "B", "T"]), (2, ["T"]), (3, ["B", "C"]), (4, ["A"]), (5, ["C", "T", "Z"])]
    itemsets = spark.createDataFrame(baskets, "basket_num long, items array<string>")
    rows = B.copurchase_rows(itemsets, "T")
    pairs = itemsets.select(F.explode("items").alias("item")).where("item <> 'T'")
    index = B.vocabulary_index(pairs)
    data = stage(B.sparse_features(rows, index, index.count()), "test-features", J.FEATURE_ROWS)
    vec = CountVectorizerModel.from_vocabulary(["A", "B", "C", "Z"], inputCol="other_items", outputCol="f", binary=True)
    want = {r["basket_num"]: (r["label"], r["f"]) for r in vec.transform(rows).collect()}
    assert {r["basket_num"]: (r["label"], r["features"]) for r in data.collect()} == want


def test_basket_summary_counts_lines_once(spark):
    lines = spark.createDataFrame([(1, "A"), (1, "A"), (1, None), (2, "B"), (3, None)], "basket_num long, commodity string")
    assert tuple(J.basket_summary(lines).first()) == (5, 2, 2)
    assert tuple(J.basket_summary(lines.limit(0)).first()) == (0, 0, 0)


def test_baskets_alike_are_one_weighted_row_of_the_model(spark):
    """Repeating every basket many times leaves as many rows to fit, and the same metric as rows apart."""
    from pyspark.ml.functions import vector_to_array
    from cartwise.operators import evaluate as E
    from cartwise.plans.churn_job import gbt
    from cartwise.session import stage
    baskets = [(i, [x for x, d in (("A", 2), ("B", 3), ("C", 5), ("T", 4)) if i % d == 0 or i % 7 == d]) for i in range(1, 400)]
    itemsets = spark.createDataFrame([b for b in baskets if b[1]], "basket_num long, items array<string>")
    rows = B.copurchase_rows(itemsets, "T")
    index = B.vocabulary_index(itemsets.select(F.explode("items").alias("item")).where("item <> 'T'"))
    data = E.stratified_split(stage(B.sparse_features(rows, index, 3), "test-alike"), "basket_num", "label")
    got = J.alike(data)
    assert got.count() <= 2 * 2 * 8 and got.agg(F.sum("baskets")).first()[0] == itemsets.count()
    weighted = gbt(5, "label_d", "baskets").fit(got.where("not is_test")).transform(got.where("is_test"))
    plain = stage(B.sparse_features(rows, index, 3), "test-apart", J.FEATURE_ROWS)
    plain = E.stratified_split(plain, "basket_num", "label").withColumn("label_d", F.col("label").cast("double"))
    apart = gbt(5, "label_d").fit(plain.where("not is_test")).transform(plain.where("is_test"))
    p1 = vector_to_array("probability")[1]
    a = (E.accuracy(weighted, "label_d", "prediction", "baskets").first()[0],
         E.roc_auc(weighted.withColumn("p1", F.round(p1, 9)), "label", "p1", weight_col="baskets").first()[0])
    b = (E.accuracy(apart, "label_d", "prediction").first()[0],
         E.roc_auc(apart.withColumn("p1", F.round(p1, 9)), "label", "p1").first()[0])
    assert abs(a[0] - b[0]) < 1e-9 and abs(a[1] - b[1]) < 1e-9
