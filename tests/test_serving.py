"""Serving over stored results (F5): rankings, band histogram with zeros, empty state."""

from cartwise.operators import serving as V
from cartwise.operators import baskets as B
from cartwise.functions.text import join_list, split_list


def test_top_rules(spark):
    rules = spark.createDataFrame(
        [(["BREAD"], ["MILK"], 0.02, 0.3, 1.5), (["PASTA", "PASTA SAUCE"], ["PARMESAN"], 0.01, 0.4, 4.2),
         (["EGGS"], ["BACON"], 0.015, 0.25, 2.1)], B.RULES_SCHEMA)
    assert [r["lift"] for r in V.top_rules(rules).collect()] == [4.2, 2.1, 1.5]
    top = V.top_rules(rules, 1).collect()
    assert len(top) == 1 and top[0]["antecedents"] == ["PASTA", "PASTA SAUCE"]
    text = rules.select(join_list("antecedents").alias("t")).select(split_list("t").alias("a"))
    assert sorted(r["a"] for r in text.collect())[2] == ["PASTA", "PASTA SAUCE"]
    assert V.top_rules(rules.limit(0)).count() == 0


def test_churn_serving(spark):
    scores = spark.createDataFrame([(10, 0.92, "High"), (20, 0.1, "Low"), (30, 0.5, "Medium")],
                                   "hshd_num long, churn_probability double, risk_band string")
    assert [r["hshd_num"] for r in V.at_risk(scores).collect()] == [10, 30, 20]
    assert [tuple(r[:2]) for r in V.risk_band_counts(scores).collect()] == \
        [("High", 1), ("Medium", 1), ("Low", 1)]
    empty = scores.limit(0)
    assert V.at_risk(empty).count() == 0
    assert [tuple(r[:2]) for r in V.risk_band_counts(empty).collect()] == \
        [("High", 0), ("Medium", 0), ("Low", 0)]


def test_limits_clamped():
    assert V.clamp_limit(None) == 25 and V.clamp_limit(0) == 25
    assert V.clamp_limit(1000) == 200 and V.clamp_limit(-5) == 1


def test_latest_metric(spark):
    import datetime as dt
    m = spark.createDataFrame([(0.9, dt.datetime(2026, 1, 1)), (0.8, dt.datetime(2026, 2, 1))],
                              "accuracy double, created_at timestamp")
    assert V.latest(m).first()["accuracy"] == 0.8


def test_scale_settings():
    from cartwise.session import scale_settings
    s = scale_settings(100 * 2**40, executor_cores=8, executors=1000)
    assert int(s["spark.sql.shuffle.partitions"]) == 819_200  # 100 TB / 128 MB
    small = scale_settings(2**30, executor_cores=8, executors=10)
    assert int(small["spark.sql.shuffle.partitions"]) == 160  # two waves of 80 cores


def test_stage_and_scratch_use_the_shared_root(spark):
    from cartwise.session import scratch_dir, shared_root, stage
    root = shared_root(spark)
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b and a.startswith(root) and b.startswith(root)
    df = spark.range(10).withColumnRenamed("id", "k")
    staged = stage(df, "unit")
    assert sorted(r["k"] for r in staged.collect()) == list(range(10))
    assert root.split(":")[-1] in staged.inputFiles()[0]
