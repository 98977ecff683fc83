"""Model evaluation on DataFrames: stratified split, accuracy, exact ROC-AUC, correlations.

All of these avoid a window over raw rows in one partition:

* the split finds each class's threshold key from counts per (label, md5-bucket) and
  ranks only the rows of the bucket in which the threshold lies;
* the AUC first collapses rows to distinct scores, then takes the running count
  of negatives per score range (ranges from approximate quantiles) and within
  each range, so no task holds more than one range.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.session import stage

SPLIT_SEED = 42
TEST_FRACTION = 0.25
SPLIT_BUCKET_CHARS = 4          # 16^4 = 65,536 hash buckets per class
AUC_RANGES = 1024


def _split_key(id_col: str, seed: int):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def split_thresholds(df: DataFrame, id_col: str, label_col: str,
                     test_fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED) -> DataFrame:
    """Per class, the key (md5, id) of its last test row: (_label, _last_h, _last_id).

    An order statistic by histogram: rows are counted per (class, hash bucket), the counts
    tell the bucket in which the ceil(fraction * n)-th row lies and its place there, and
    only the rows of that one bucket per class (about n / 65,536) are ranked. Repeated ids
    are counted once per bucket entry, so a hot id is one row of the ranking.
    """
    keyed = df.select(F.col(label_col).alias("_label"), F.col(id_col).alias("_id"),
                      _split_key(id_col, seed).alias("_h"))
    bucket = F.substring("_h", 1, SPLIT_BUCKET_CHARS)
    counts = keyed.groupBy("_label", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    per_class = Window.partitionBy("_label")
    to_here = F.sum("_n").over(per_class.orderBy("_b"))
    wanted = F.ceil(F.sum("_n").over(per_class) * F.lit(test_fraction))
    # One row per class; stored, so that Spark knows its size when it plans the joins.
    edge = stage(counts.withColumns({"_to": to_here, "_wanted": wanted})
                       .where((F.col("_to") - F.col("_n") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_to")))
                       .select(F.col("_label").alias("_class"), F.col("_b").alias("_edge"),
                               (F.col("_wanted") - F.col("_to") + F.col("_n")).alias("_place")), "split-edge")
    inside = keyed.join(edge, F.col("_label").eqNullSafe(F.col("_class")) & (bucket == F.col("_edge")))
    each = inside.groupBy("_class", "_place", "_h", "_id").agg(F.count(F.lit(1)).alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy("_class").orderBy("_h", "_id"))
    return (each.withColumn("_so_far", so_far)
                .where((F.col("_so_far") - F.col("_n") < F.col("_place")) & (F.col("_place") <= F.col("_so_far")))
                .select(F.col("_class").alias("_label"), F.col("_h").alias("_last_h"), F.col("_id").alias("_last_id")))


def stratified_split(df: DataFrame, id_col: str, label_col: str,
                     test_fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED) -> DataFrame:
    """Adds ``is_test``: per class, the ceil(fraction * class size) rows first by
    (md5(id || ':' || seed), id) go to the test part. Exact and repeatable; rows that repeat
    an id go to the same part.

    No row is shuffled or sorted for it: each compares its own key with its class's
    threshold (``split_thresholds``). ``df`` is read three times, the first two times for
    its id and label only: store it first if it is costly to compute.
    """
    last = stage(split_thresholds(df, id_col, label_col, test_fraction, seed), "split-threshold")
    h = _split_key(id_col, seed)
    flagged = df.join(last, F.col(label_col).eqNullSafe(F.col("_label")), "left")
    is_test = (h < F.col("_last_h")) | ((h == F.col("_last_h")) & (F.col(id_col) <= F.col("_last_id")))
    return flagged.withColumn("is_test", F.coalesce(is_test, F.lit(False))).drop("_label", "_last_h", "_last_id")


def accuracy(df: DataFrame, label_col: str, prediction_col: str, weight_col: str | None = None) -> DataFrame:
    """Share of right predictions; ``weight_col`` counts the rows that a row stands for."""
    right = F.when(F.col(prediction_col) == F.col(label_col), 1.0).otherwise(0.0)
    if weight_col is None:
        return df.agg(F.avg(right).alias("accuracy"))
    return df.agg(F.try_divide(F.sum(right * F.col(weight_col)),
                               F.sum(F.col(weight_col).cast("double"))).alias("accuracy"))


def roc_auc(df: DataFrame, label_col: str, score_col: str,
            ranges: int = AUC_RANGES, weight_col: str | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count one half), as a one-row frame; NULL for one class.
    ``weight_col`` counts the rows that a row stands for."""
    n = F.lit(1) if weight_col is None else F.col(weight_col).cast("bigint")
    per_score = (df.groupBy(F.col(score_col).cast("double").alias("s"))
                   .agg(F.sum(F.when(F.col(label_col) == 1, n).otherwise(0)).alias("pos"),
                        F.sum(F.when(F.col(label_col) == 1, 0).otherwise(n)).alias("neg")))
    # Read twice (quantiles, then the sums): staged once in the shared folder
    # (one row per distinct score, so it can grow with the data).
    per_score = stage(per_score, "auc-scores")
    probs = [i / ranges for i in range(1, ranges)]
    qs = per_score.approxQuantile("s", probs, 1.0 / (4 * ranges)) if ranges > 1 else []
    cuts = sorted({q for q in qs if q is not None and not math.isnan(q)})
    splits = [-math.inf] + cuts + [math.inf]
    bucketed = Bucketizer(splits=splits, inputCol="s", outputCol="r",
                          handleInvalid="keep").transform(per_score)
    # One row per range (bounded by ``ranges``): negatives in all lower ranges.
    range_neg = bucketed.groupBy("r").agg(F.sum("neg").alias("rneg"))
    lower = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    range_off = range_neg.select("r", F.coalesce(F.sum("rneg").over(lower), F.lit(0)).alias("off"))
    within = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = (bucketed.withColumn("nb", F.coalesce(F.sum("neg").over(within), F.lit(0)))
                     .join(F.broadcast(range_off), "r"))
    pairs = F.col("pos").cast("double") * (F.col("off") + F.col("nb")).cast("double") \
        + 0.5 * F.col("pos").cast("double") * F.col("neg").cast("double")
    tot = below.agg(F.sum(pairs).alias("num"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    denom = F.col("p").cast("double") * F.col("n").cast("double")
    return tot.select(F.when(denom > 0, F.col("num") / denom).alias("roc_auc"))


def feature_correlations(df: DataFrame, features: list[str], label_col: str) -> DataFrame:
    """Pearson correlation of each feature with the label, ascending (NULL last).

    From population covariance and variances; a constant feature gives NULL
    instead of a division error.
    """
    aggs = []
    for f in features:
        x, y = F.col(f).cast("double"), F.col(label_col).cast("double")
        aggs.append(F.try_divide(F.covar_pop(x, y),
                                 F.sqrt(F.var_pop(x) * F.var_pop(y))).alias(f))
    wide = df.agg(*aggs)
    long = wide.unpivot([], features, "feature", "correlation")
    return long.orderBy(F.asc_nulls_last("correlation"), "feature")
