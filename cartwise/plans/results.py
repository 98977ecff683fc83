"""Result tables and report sinks.

``replace_result`` replaces one result table (basket_rules, basket_model_metric,
household_churn, churn_model_metric): the rows are written to a fresh version
folder with ``created_at`` stamped at write time, then the version is appended
to the table's ``_versions`` log; readers take the newest version, so a failed
write leaves the previous result in place. The row count comes from an
``observe`` in the writing stage. ``read_history`` reads every version that is kept.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cartwise.operators.numbering import dense_index
from cartwise.session import folder_names, retire_versions

LOG = "version string, path string, rows long, source string, last_id long"


def _log(spark: SparkSession, root: str, name: str) -> list:
    """The version log of a result, oldest first; empty if nothing was written yet."""
    if "_versions" not in folder_names(spark, f"{root}/{name}"):
        return []
    return spark.read.schema(LOG).json(f"{root}/{name}/_versions").orderBy("version").collect()


def replace_result(df: DataFrame, root: str, name: str, source: str | None = None,
                   id_order: list[str | Column] | None = None, cluster_by: str | None = None,
                   keep: int | None = None, grace_s: float = 86_400) -> int:
    """Write a new version of result ``name``; return its rows.

    ``source`` names the loaded dataset version it was computed from (see ``read_result``).
    With ``id_order`` rows get a serial ``id`` in that order, going on after the last id the
    table has given out. ``cluster_by`` lays the rows out by a key, so that lookups of it
    read few row groups. With ``keep`` older versions are retired (``session.retire_versions``).
    """
    spark = df.sparkSession
    log = _log(spark, root, name)
    last = max((r["last_id"] or 0 for r in log), default=0)
    version = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    path = f"{root}/{name}/v={version}"
    if id_order:
        df = dense_index(df, id_order, "id").withColumn("id", F.col("id") + F.lit(last + 1))
    if cluster_by:
        df = df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    obs = Observation(f"{name}-{version}")
    (df.withColumn("created_at", F.current_timestamp())
       .observe(obs, F.count(F.lit(1)).alias("n"))
       .write.mode("errorifexists").parquet(path))
    n = int(obs.get.get("n") or 0)
    spark.createDataFrame([(version, path, n, source, last + n if id_order else last)], LOG) \
        .coalesce(1).write.mode("append").json(f"{root}/{name}/_versions")
    if keep is not None:
        retire_versions(spark, f"{root}/{name}", [*(r["version"] for r in log), version], keep, grace_s)
    return n


def read_result(spark: SparkSession, root: str, name: str,
                current_source: str | None = None) -> DataFrame:
    """The newest version of a result table; FileNotFoundError when none was written.

    With ``current_source`` (the loaded dataset version now current), a result
    computed from an older load reads as empty: reloading the data invalidates
    stored scores, as the cascade on the household table does in the reference.
    """
    log = _log(spark, root, name)
    if not log:
        raise FileNotFoundError(f"no result {name} under {root}")
    df = spark.read.parquet(log[-1]["path"])
    if current_source is not None and log[-1]["source"] != current_source:
        return df.limit(0)
    return df


def read_history(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of all versions of a result table whose versions are all kept (metrics)."""
    log = _log(spark, root, name)
    if not log:
        raise FileNotFoundError(f"no result {name} under {root}")
    return spark.read.parquet(*[r["path"] for r in log])


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report as CSV with a header, one file for each partition of the frame; a
    caller whose frame is small by construction makes it one."""
    df.write.mode("overwrite").option("header", "true").csv(path)
