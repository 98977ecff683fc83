"""The stratified split: exact per class against a plain sort, without a shuffle of the rows."""

import hashlib
import math
import random

from cartwise.operators import evaluate as E
from cartwise.session import stage


def brute(rows, fraction=0.25):
    out = {}
    for label in {y for _, y in rows}:
        own = sorted(((hashlib.md5(f"{i}:42".encode()).hexdigest(), i) for i, y in rows if y == label))
        out |= {(i, label): k < math.ceil(fraction * len(own)) for k, (_, i) in enumerate(own)}
    return out


def test_exact_per_class(spark):
    rng = random.Random(9)
    for n, fraction in ((1, 0.25), (5, 0.25), (3000, 0.25), (3000, 0.5), (701, 0.01), (10, 1.0)):
        rows = [(i * 7 + 1, rng.choice([0, 1, 1, None])) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, y int").repartition(5)
        got = {(r["id"], r["y"]): r["is_test"] for r in E.stratified_split(df, "id", "y", fraction).collect()}
        assert got == brute(rows, fraction)
    assert E.stratified_split(df.limit(0), "id", "y").count() == 0


def test_repeated_ids_stay_together(spark):
    df = spark.createDataFrame([(i % 40, 1, k) for k, i in enumerate(range(400))] + [(7, 1, -1)] * 500, "id long, y int, k int")
    got = E.stratified_split(df, "id", "y").groupBy("id").agg({"is_test": "max"}).collect()
    both = E.stratified_split(df, "id", "y").select("id", "is_test").distinct().count()
    assert both == len(got) == 40


def test_rows_are_not_shuffled(spark):
    """What is left of the plan for the rows is a scan, one join with a row per class, a comparison."""
    rows = stage(spark.range(20_000).selectExpr("id", "cast(id % 3 as int) as y", "id * 2 as payload"), "test-split")
    split = E.stratified_split(rows, "id", "y")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert split.where("is_test").count() == sum(math.ceil(n / 4) for n in (6667, 6667, 6666))
