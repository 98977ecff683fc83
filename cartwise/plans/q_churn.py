"""Churn queries: cutoff, RFM features, split, evaluation, correlations, serving.

Keys that need a stored churn score use ``churn.heuristic_score`` (deterministic)
so an oracle exists; the model-based keys (``churn_model``, ``churn_scores``) are
rows-only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise import oracle as O
from cartwise.functions.numeric import BAND_ORDER, HIGH_RISK, MEDIUM_RISK
from cartwise.functions.text import join_list
from cartwise.operators import churn as C
from cartwise.operators import evaluate as E
from cartwise.operators import serving as V
from cartwise.plans import churn_job as J
from cartwise.plans import results as R
from cartwise.plans.registry import register
from cartwise.session import scratch_dir, stage
from cartwise.sources import raw_files
from cartwise.sources import tables as S


# ---- oracle building blocks -------------------------------------------------------

ACT = """act AS (SELECT t.hshd_num, t.basket_num, t.purchase_date, t.spend, h.loyalty_flag
        FROM transactions t JOIN households h ON h.hshd_num = t.hshd_num)"""
CUT = """cut AS (SELECT max(purchase_date) AS data_end,
               CAST(max(purchase_date) - 90 AS DATE) AS cutoff FROM act)"""
BASKET = """pb AS (SELECT a.hshd_num, a.basket_num,
         max(CASE WHEN a.purchase_date <= c.cutoff THEN 1 ELSE 0 END) AS b_pre,
         max(CASE WHEN a.purchase_date > c.cutoff THEN 1 ELSE 0 END) AS b_post,
         sum(CASE WHEN a.purchase_date <= c.cutoff THEN a.spend END) AS b_spend,
         max(CASE WHEN a.purchase_date <= c.cutoff THEN a.purchase_date END) AS b_last,
         min(CASE WHEN a.purchase_date <= c.cutoff THEN a.purchase_date END) AS b_first,
         sum(CASE WHEN a.purchase_date <= c.cutoff AND a.purchase_date > CAST(c.cutoff - 90 AS DATE)
                  THEN a.spend END) AS b_recent,
         sum(CASE WHEN a.purchase_date <= CAST(c.cutoff - 90 AS DATE) THEN a.spend END) AS b_earlier,
         max(CAST(a.loyalty_flag AS INTEGER)) AS b_loyalty
       FROM act a, cut c GROUP BY 1, 2)"""
FEAT = """f AS (SELECT hshd_num, recency_days, frequency, monetary_total, monetary_avg, tenure_days,
               recent_spend, earlier_spend, recent_spend / (earlier_spend + 1.0) AS trend_ratio,
               loyalty, churned
  FROM (SELECT p.hshd_num,
          CAST(datediff('day', max(b_last), max(c.cutoff)) AS INTEGER) AS recency_days,
          CAST(sum(b_pre) AS BIGINT) AS frequency,
          CAST(sum(b_spend) AS DOUBLE) AS monetary_total,
          CAST(sum(b_spend) AS DOUBLE) / sum(b_pre) AS monetary_avg,
          CAST(datediff('day', min(b_first), max(b_last)) AS INTEGER) AS tenure_days,
          CAST(coalesce(sum(b_recent), 0) AS DOUBLE) AS recent_spend,
          CAST(coalesce(sum(b_earlier), 0) AS DOUBLE) AS earlier_spend,
          CAST(max(b_loyalty) AS INTEGER) AS loyalty,
          CASE WHEN max(b_post) = 1 THEN 0 ELSE 1 END AS churned,
          max(b_pre) AS has_pre
        FROM pb p, cut c GROUP BY p.hshd_num) WHERE has_pre = 1)"""
SCORE = """sc AS (SELECT *, CAST(recency_days AS DOUBLE)
                  / (CAST(recency_days AS DOUBLE) + CAST(tenure_days AS DOUBLE) + 1.0) AS score
        FROM f)"""
SPLIT = """sp AS (SELECT *, row_number() OVER (PARTITION BY churned
                     ORDER BY md5(CAST(hshd_num AS VARCHAR) || ':42'), hshd_num)
                   <= ceil(count(*) OVER (PARTITION BY churned) * 0.25) AS is_test
        FROM sc)"""
STORED = f"""hc AS (SELECT hshd_num, {O.round4('score')} AS churn_probability,
               CASE WHEN score >= {HIGH_RISK} THEN '{BAND_ORDER[0]}'
                    WHEN score >= {MEDIUM_RISK} THEN '{BAND_ORDER[1]}'
                    ELSE '{BAND_ORDER[2]}' END AS risk_band FROM sc)"""


def churn_sql(*extra: str) -> str:
    return O.with_views(ACT, CUT, BASKET, FEAT, *extra)


def auc_sql(rows: str, label: str, score: str) -> str:
    """Exact ROC-AUC over ``rows`` (a CTE name) with mid-rank ties."""
    return f"""per AS (SELECT CAST({score} AS DOUBLE) AS s, sum(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS pos,
                sum(CASE WHEN {label} = 1 THEN 0 ELSE 1 END) AS neg FROM {rows} GROUP BY 1),
cum AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
                                                  AND 1 PRECEDING), 0) AS nb FROM per),
auc AS (SELECT CASE WHEN sum(pos) * sum(neg) > 0 THEN
           sum(CAST(pos AS DOUBLE) * CAST(nb AS DOUBLE) + 0.5 * CAST(pos AS DOUBLE) * CAST(neg AS DOUBLE))
           / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS roc_auc FROM cum)"""


# ---- Spark builders ------------------------------------------------------------------

def _features(spark, sf):
    features, _ = J.features_frame(spark, sf)
    if features is None:
        raise ValueError("no activity: nothing to frame")
    return features


def _scored(spark, sf):
    return C.heuristic_score(_features(spark, sf))


_RESULTS: dict[tuple[str, str], str] = {}


def results_root(spark, sf: str) -> str:
    """The result folder of this session and scale. The first query that needs stored scores
    writes them there (laid out by household); all others only read them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RESULTS:
        root = scratch_dir(spark, "results")
        R.replace_result(C.scores_table(_scored(spark, sf)), root, "household_churn", cluster_by="hshd_num")
        _RESULTS[key] = root
    return _RESULTS[key]


def stored_scores(spark, sf):
    """The stored score table: lookups of households prune it by ``hshd_num``."""
    return R.read_result(spark, results_root(spark, sf), "household_churn").drop("created_at")


def _split(spark, sf):
    # One row per household; the split reads it three times.
    scored = stage(_scored(spark, sf), "churn-scored")
    return E.stratified_split(scored, "hshd_num", "churned")


@register("churn_cutoff", "AGG-14", churn_sql() + "SELECT data_end, cutoff FROM cut")
def q_churn_cutoff(spark, sf):
    # Last purchase of a known household: basket totals (one row per order) are
    # enough for a max over dates, and the household check is a semi join.
    days = S.basket_totals(spark, sf).join(S.households(spark, sf).select("hshd_num"),
                                            "hshd_num", "left_semi")
    return C.churn_cutoff(days)


@register("churn_features", "RFM-1..10 FLT-3 JN-7 SC-15", churn_sql() + "SELECT * FROM f")
def q_churn_features(spark, sf):
    return _features(spark, sf)


@register("churn_base_rate", "AGG-15", churn_sql() + """
SELECT avg(CAST(churned AS DOUBLE)) AS churn_rate, count(*) AS households FROM f""")
def q_churn_base_rate(spark, sf):
    return C.base_rate(_features(spark, sf))


@register("label_class_count", "AGG-16", churn_sql() + """
SELECT count(DISTINCT churned) AS classes, count(DISTINCT churned) >= 2 AS trainable FROM f""")
def q_label_class_count(spark, sf):
    return C.label_class_count(_features(spark, sf))


@register("churn_correlations", "AGG-17 SNK-3", churn_sql() + """
SELECT feature, """ + O.round6("correlation") + """ AS correlation FROM (
  UNPIVOT (SELECT """ + ",\n".join(
    f"CASE WHEN var_pop(CAST({c} AS DOUBLE)) * var_pop(CAST(churned AS DOUBLE)) > 0 THEN "
    f"covar_pop(CAST({c} AS DOUBLE), CAST(churned AS DOUBLE)) / sqrt(var_pop(CAST({c} AS DOUBLE))"
    f" * var_pop(CAST(churned AS DOUBLE))) END AS {c}" for c in C.FEATURE_COLUMNS) + """
  FROM f) ON """ + ", ".join(C.FEATURE_COLUMNS) + """ INTO NAME feature VALUE correlation)""")
def q_churn_correlations(spark, sf):
    corr = E.feature_correlations(_features(spark, sf), C.FEATURE_COLUMNS, "churned")
    path = f"{scratch_dir(spark, 'report')}/churn_correlations"
    R.write_report_csv(corr.coalesce(1), path)     # a row per feature; read back from the file
    report = spark.read.option("header", "true").schema("feature string, correlation double").csv(path)
    return report.select("feature", F.round("correlation", 6).alias("correlation"))


@register("stratified_split", "SPL-1", churn_sql(SCORE, SPLIT) + """
SELECT hshd_num, churned, is_test FROM sp""")
def q_stratified_split(spark, sf):
    return _split(spark, sf).select("hshd_num", "churned", "is_test")


@register("eval_accuracy", "AGG-18", churn_sql(SCORE, SPLIT) + """
SELECT avg(CASE WHEN (CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) = churned THEN 1.0 ELSE 0.0 END)
       AS accuracy FROM sp WHERE is_test""")
def q_eval_accuracy(spark, sf):
    test = _split(spark, sf).where("is_test").withColumn(
        "prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    return E.accuracy(test, "churned", "prediction")


@register("eval_roc_auc", "AGG-19", churn_sql(SCORE, SPLIT, "tst AS (SELECT * FROM sp WHERE is_test)",
                                              auc_sql("tst", "churned", "score"))
          + f"SELECT {O.round6('roc_auc')} AS roc_auc FROM auc")
def q_eval_roc_auc(spark, sf):
    test = _split(spark, sf).where("is_test")
    return E.roc_auc(test, "churned", "score").select(F.round("roc_auc", 6).alias("roc_auc"))


@register("risk_band", "SC-14 SC-11 ML-8", churn_sql(SCORE, STORED) + "SELECT * FROM hc")
def q_risk_band(spark, sf):
    return stored_scores(spark, sf)


@register("at_risk", "SRT-4 PRJ-5 ML-10", churn_sql(SCORE, STORED) + """
SELECT hshd_num, churn_probability, risk_band FROM hc
ORDER BY churn_probability DESC, hshd_num LIMIT 25""")
def q_at_risk(spark, sf):
    return V.at_risk(stored_scores(spark, sf))


@register("risk_band_counts", "AGG-11 JN-8 SRT-8 ML-10", churn_sql(SCORE, STORED) + """,
bands AS (SELECT * FROM (VALUES ('High', 0), ('Medium', 1), ('Low', 2)) b(band, position))
SELECT b.band, CAST(coalesce(n.households, 0) AS BIGINT) AS households, b.position
FROM bands b LEFT JOIN (SELECT risk_band, count(*) AS households FROM hc GROUP BY 1) n
  ON n.risk_band = b.band""")
def q_risk_band_counts(spark, sf):
    return V.risk_band_counts(stored_scores(spark, sf))


@register("churn_scores_valid", "SNK-7", churn_sql(SCORE, STORED) + f"""
SELECT hc.* FROM hc WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = hc.hshd_num
                                  AND c.c_mktsegment <> '{raw_files.MISSING_SEGMENT}')""")
def q_churn_scores_valid(spark, sf):
    """The stored scores that outlive a reload with the load's households file, which lacks a segment."""
    reloaded = raw_files.listed_households(S.households(spark, sf), S.read_table(spark, sf, "customer"))
    return V.valid_scores(stored_scores(spark, sf), reloaded)


def _metric_sql(select: str = "", *extra: str) -> str:
    """Metric-row CTEs (split, AUC, drivers) + ``extra`` CTEs + ``select``."""
    select = select or METRIC_ROW
    drivers = (f"""drv AS (SELECT string_agg(feature, ', ' ORDER BY abs(correlation) DESC, feature)
               AS top_drivers FROM (SELECT feature, correlation FROM (UNPIVOT (SELECT """
               + ",\n".join(
                   f"CASE WHEN var_pop(CAST({c} AS DOUBLE)) * var_pop(CAST(churned AS DOUBLE)) > 0 THEN "
                   f"covar_pop(CAST({c} AS DOUBLE), CAST(churned AS DOUBLE)) / sqrt(var_pop(CAST({c} AS DOUBLE))"
                   f" * var_pop(CAST(churned AS DOUBLE))) END AS {c}" for c in C.FEATURE_COLUMNS)
               + " FROM f) ON " + ", ".join(C.FEATURE_COLUMNS)
               + """ INTO NAME feature VALUE correlation) WHERE correlation IS NOT NULL
               ORDER BY abs(correlation) DESC, feature LIMIT 6))""")
    return churn_sql(SCORE, SPLIT, "tst AS (SELECT * FROM sp WHERE is_test)",
                     auc_sql("tst", "churned", "score"), drivers, *extra) + select


METRIC_ROW = f"""
SELECT {O.round4('(SELECT avg(CASE WHEN (CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) = churned '
                 'THEN 1.0 ELSE 0.0 END) FROM tst)')} AS accuracy,
       {O.round4('(SELECT roc_auc FROM auc)')} AS roc_auc,
       {O.round4('(SELECT avg(CAST(churned AS DOUBLE)) FROM f)')} AS churn_rate,
       (SELECT top_drivers FROM drv) AS top_drivers"""


METRIC_RUNS = 3      # metric rows in the history from which the latest is read


@register("latest_metric", "SRT-7 SRT-9 ML-9 ML-10 SNK-2 SNK-4", "SELECT *, 3 AS id, true AS stamped FROM ("
          + _metric_sql() + ")")
def q_latest_metric(spark, sf):
    """The newest row of a metric table with a history: runs with longer holdouts wrote theirs
    before, each a version of its own with the next id."""
    root = scratch_dir(spark, "metrics")
    for run in range(METRIC_RUNS, 0, -1):
        features, _ = J.features_frame(spark, sf, holdout_days=C.HOLDOUT_DAYS * run)
        if features is None:
            raise ValueError("no activity: nothing to frame")
        metric = V.heuristic_metric(C.heuristic_score(features), features, C.FEATURE_COLUMNS)
        R.replace_result(metric, root, "churn_model_metric", id_order=["accuracy"])
    last = V.latest(R.read_history(spark, root, "churn_model_metric"))
    return last.select("accuracy", "roc_auc", "churn_rate", "top_drivers", F.col("id").cast("int").alias("id"),
                       F.col("created_at").isNotNull().alias("stamped"))


_MODELS: dict[tuple[str, str], str] = {}
_LABELS: dict = {}     # of the households that the model was made from, stored


def model_root(spark, sf: str) -> str | None:
    """The folder with the trained model's scores and metric row, written by the first query of
    a session and scale that asks for either (None: nothing to train on)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        features, _ = J.features_frame(spark, sf)
        if features is None:
            return None
        features = stage(features, "model-features")
        scores, metric = J.fit_churn_model(features)
        if scores is None:
            return None
        root = scratch_dir(spark, "model")
        R.replace_result(scores, root, "household_churn", cluster_by="hshd_num")
        R.replace_result(metric, root, "churn_model_metric", id_order=["accuracy"])
        _MODELS[key] = root
        _LABELS[key] = features.select("hshd_num", "churned")
    return _MODELS[key]


@register("churn_model", "ML-6 ML-9 SRT-9 SNK-2")
def q_churn_model(spark, sf):
    root = model_root(spark, sf)
    if root is None:
        return J.empty_metric(spark)
    metric = R.read_result(spark, root, "churn_model_metric").drop("id", "created_at")
    return metric.withColumn("top_drivers", join_list("top_drivers", sort=False))


@register("churn_scores", "ML-8 SC-14 SNK-2")
def q_churn_scores(spark, sf):
    root = model_root(spark, sf)
    return J.empty_scores(spark) if root is None else R.read_result(spark, root, "household_churn").drop("created_at")


@register("churn_model_checks", "ML-6 ML-8 ML-9 SRT-9 SNK-2 SNK-4", churn_sql() + f"""
SELECT * FROM (
SELECT 'households_scored' AS check_name, (SELECT count(*) FROM f) AS value
UNION ALL SELECT 'households_scored_once', (SELECT count(*) FROM f)
UNION ALL SELECT 'unknown_households', 0 UNION ALL SELECT 'outside_0_1', 0 UNION ALL SELECT 'wrong_band', 0
UNION ALL SELECT 'churners_rank_higher', 1 UNION ALL SELECT 'metric_rows', 1
UNION ALL SELECT 'metric_rate_in_10000', (SELECT CAST(round(10000 * avg(CAST(churned AS DOUBLE))) AS BIGINT) FROM f)
UNION ALL SELECT 'auc_of_stored_scores', 1 UNION ALL SELECT 'accuracy_of_stored_scores', 1
UNION ALL SELECT 'drivers', {J.TOP_DRIVERS} UNION ALL SELECT 'unknown_drivers', 0)""")
def q_churn_model_checks(spark, sf):
    """What must hold of any trained model, from its stored scores and metric row and the features."""
    root = model_root(spark, sf)
    if root is None:
        raise ValueError("nothing to train on")
    scores, metric = (R.read_result(spark, root, n) for n in ("household_churn", "churn_model_metric"))
    features = _LABELS[spark.sparkContext.applicationId, sf]
    test = E.stratified_split(features, "hshd_num", "churned").where("is_test").drop("is_test")
    p = F.col("churn_probability")
    known = scores.join(features.withColumnRenamed("churned", "label"), "hshd_num", "left")
    counts = known.agg(
        F.count(F.lit(1)).alias("households_scored"), F.count_distinct("hshd_num").alias("households_scored_once"),
        F.count_if(F.col("label").isNull()).alias("unknown_households"),
        F.count_if(p.isNull() | (p < 0) | (p > 1)).alias("outside_0_1"),
        # Stored probabilities are rounded to 4 places, bands come from the unrounded ones.
        F.count_if(F.col("risk_band") != F.when(p >= HIGH_RISK + 1e-4, BAND_ORDER[0]).when(p < MEDIUM_RISK - 1e-4, BAND_ORDER[2])
                   .when((p >= MEDIUM_RISK + 1e-4) & (p < HIGH_RISK - 1e-4), BAND_ORDER[1])
                   .otherwise(F.col("risk_band"))).alias("wrong_band"),
        (F.avg(F.when(F.col("label") == 1, p)) > F.avg(F.when(F.col("label") == 0, p))).alias("churners_rank_higher")).first()
    judged = stage(scores.join(test, "hshd_num"), "model-judged")
    auc = E.roc_auc(judged, "churned", "churn_probability").first()["roc_auc"]
    held = judged.agg(F.avg(((p >= 0.5).cast("int") == F.col("churned")).cast("double"))).first()[0]
    m = metric.collect()
    row = m[0]
    checks = {**counts.asDict(), "metric_rows": len(m), "metric_rate_in_10000": round(10000 * row["churn_rate"]),
              "auc_of_stored_scores": abs((auc or 0.0) - (row["roc_auc"] or 0.0)) < 0.02, "accuracy_of_stored_scores": abs(held - row["accuracy"]) < 0.005,
              "drivers": len(row["top_drivers"]), "unknown_drivers": len(set(row["top_drivers"]) - set(C.FEATURE_COLUMNS))}
    return spark.createDataFrame([(k, int(v)) for k, v in checks.items()], "check_name string, value long")


@register("churn_summary", "ML-10 AGG-11 JN-8 SRT-7", _metric_sql(
    """
SELECT 'band' AS section, b.band AS name,
       CAST(coalesce((SELECT count(*) FROM hc WHERE hc.risk_band = b.band), 0) AS DOUBLE) AS value,
       CAST(NULL AS VARCHAR) AS text FROM bands b
UNION ALL SELECT 'metric', 'accuracy', accuracy, NULL FROM met
UNION ALL SELECT 'metric', 'roc_auc', roc_auc, NULL FROM met
UNION ALL SELECT 'metric', 'churn_rate', churn_rate, NULL FROM met
UNION ALL SELECT 'metric', 'top_drivers', NULL, top_drivers FROM met""",
    STORED, "bands AS (SELECT * FROM (VALUES ('High', 0), ('Medium', 1), ('Low', 2)) b(band, position))",
    "met AS (" + METRIC_ROW + ")"))
def q_churn_summary(spark, sf):
    features = _features(spark, sf)
    metric = V.stamp(V.heuristic_metric(C.heuristic_score(features), features, C.FEATURE_COLUMNS))
    return V.churn_summary(stored_scores(spark, sf), metric)
