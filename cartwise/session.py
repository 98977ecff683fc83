"""Session helpers: building a session for jobs/tests and finding the shared folder.

Jobs never pick a machine-local folder on a cluster. Anything that must outlive a
task (scratch CSV renders, staged loads, stream checkpoints, lineage cuts) goes under
the folder the cluster names in ``spark.checkpoint.dir``. Only when that is unset and
Spark runs in local mode (tests, the bench) do we create one under the system temp
folder.
"""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "cartwise",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings every job here assumes: AQE on, UTC, no UI."""
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    master = master or os.environ.get("CARTWISE_MASTER")
    if master:      # else the submitted master stays
        b = b.master(master)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The cluster-shared folder for lineage cuts and job scratch.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint
    folder). Only a local-mode session without one gets a fresh temp folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; jobs need a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="cartwise-ckpt-")
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def output_partitions(spark: SparkSession) -> int:
    """Partition count for a range-partitioned write of the whole fact: the
    session's shuffle partition count, which ``scale_settings`` sizes from the
    input volume (not the core count, which does not grow with the data)."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh, never-reused folder under the shared root for one job run."""
    return f"{shared_root(spark)}/cartwise-{purpose}-{uuid.uuid4().hex[:12]}"


def scale_settings(input_bytes: int, executor_cores: int, executors: int,
                   partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of Parquet.

    Shuffle partitions start at about one per ``partition_bytes`` of input (at
    least two waves of the cluster's cores) and AQE coalesces them down to the
    advisory size after each stage, so no reducer holds more than it can sort in
    memory; skewed partitions over 4x the median (and 256 MB) are split.
    """
    cores = max(1, executor_cores * executors)
    shuffle = max(2 * cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


def stage(df, purpose: str, schema=None):
    """Cut the lineage of a large intermediate by writing it as Parquet to a fresh
    folder under the shared root and reading it back.

    For intermediates that grow with the fact (parsed lines, basket-days,
    itemsets) this is smaller than an RDD checkpoint (columnar, compressed) and
    is read back with column pruning; small reused frames use ``checkpoint()``.
    A lost executor only loses shuffle files: the staged copy is on shared
    storage and later stages restart from it. ``schema`` reads it back with other types of
    the same layout (vectors).
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def folder_names(spark, path: str) -> list[str]:
    """Names of the folders directly under ``path``, on whatever file system it is."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(jpath) if f.isDirectory())


def delete_folder(spark, path: str) -> None:
    """Deletes a folder that a job of this library wrote and no reader needs any more."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def retire_versions(spark, root: str, published: list[str], keep: int, grace_s: float) -> list[str]:
    """Deletes version folders ``v=<milliseconds>-<tag>`` under ``root``; returns their names.

    The newest ``keep`` published versions stay, and so does every version younger than
    ``grace_s`` seconds, published or not: a reader may have resolved it, a writer may be
    at work in it. What a failed load left behind goes once it is older than that.
    """
    now = time.time() * 1000
    kept = set(sorted(published)[-keep:])
    gone = []
    for folder in folder_names(spark, root):
        version = folder.removeprefix("v=")
        if folder == version or version in kept or not version[:15].isdigit():
            continue
        if now - int(version[:15]) >= grace_s * 1000:
            delete_folder(spark, f"{root}/{folder}")
            gone.append(version)
    return gone
