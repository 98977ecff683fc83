"""Incremental transaction load with Structured Streaming.

Transaction files are picked up as they arrive in a folder (file source,
``maxBytesPerTrigger`` bounds a micro-batch), joined to the static dimension
keys (stream-static left joins), and each micro-batch is written by
``foreachBatch``: the valid lines into ``lines/b=<id>`` and the
batch's loaded / skipped counts into ``report/b=<id>``. Both writes
overwrite their batch folder, so a batch replayed after a failure (the sink is
at-least-once) replaces its own output instead of adding to it. Stateless: no
watermark or state store is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cartwise.plans.load import clean_transactions, flag_transactions
from cartwise.schema import RAW_TRANSACTION_COLUMNS
from cartwise.session import output_partitions
from cartwise.sources.raw_files import CSV_READ


def file_header(spark: SparkSession, source_dir: str) -> list[str]:
    """Header names exactly as written in the files (padding kept)."""
    return spark.read.options(**CSV_READ).csv(source_dir).columns


def _scan_bytes(spark: SparkSession) -> int:
    """spark.sql.files.maxPartitionBytes in bytes."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()
    number, unit = size.rstrip("bkmgt"), size[len(size.rstrip("bkmgt")):].removesuffix("b")
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def transaction_stream(spark: SparkSession, source_dir: str, header: list[str],
                       max_bytes_per_trigger: int | None = None) -> DataFrame:
    """The files of a folder as a stream; a micro-batch takes files of ``max_bytes_per_trigger``
    together (at least one file), by default what one task per shuffle partition reads."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    most = max_bytes_per_trigger or output_partitions(spark) * _scan_bytes(spark)
    stream = (spark.readStream.schema(schema).options(**CSV_READ)
              .option("maxBytesPerTrigger", str(most)).csv(source_dir))
    renamed = stream.toDF(*[c.strip() for c in header])
    missing = [c for c in RAW_TRANSACTION_COLUMNS if c not in renamed.columns]
    if missing:
        raise ValueError(f"{source_dir}: missing columns {missing}")
    return renamed.select(*RAW_TRANSACTION_COLUMNS)


def start_incremental_load(spark: SparkSession, source_dir: str, households: DataFrame,
                           products: DataFrame, out_root: str, checkpoint: str,
                           max_bytes_per_trigger: int | None = None,
                           available_now: bool = True) -> StreamingQuery:
    header = file_header(spark, source_dir)
    # The static sides are read by every micro-batch: keep the key sets cached
    # (recomputable from their lineage if an executor is lost).
    hk = households.select("hshd_num").distinct().persist()
    pk = products.select("product_num").distinct().persist()
    flagged = flag_transactions(transaction_stream(spark, source_dir, header,
                                                   max_bytes_per_trigger), hk, pk)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        obs = Observation(f"load-batch-{batch_id}")
        counted = batch.observe(obs, F.count_if(~F.col("orphan")).alias("loaded"),
                                F.count_if(F.col("orphan")).alias("skipped"))
        (clean_transactions(counted).write.mode("overwrite")
            .parquet(f"{out_root}/lines/b={batch_id}"))
        m = obs.get
        batch.sparkSession.createDataFrame(
            [(batch_id, int(m.get("loaded") or 0), int(m.get("skipped") or 0))],
            "batch_id long, loaded long, skipped long") \
            .coalesce(1).write.mode("overwrite").json(f"{out_root}/report/b={batch_id}")

    writer = (flagged.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")
    query = writer.start()
    _CACHED[query.id] = (hk, pk)
    return query


_CACHED: dict = {}


def finish(query: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait for the stream to end (an ``availableNow`` run ends by itself), release
    the cached key sets, and raise if the stream failed."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        for df in _CACHED.pop(query.id, ()):
            df.unpersist()
        raise TimeoutError(f"stream load did not finish in {timeout_s} s")
    for df in _CACHED.pop(query.id, ()):
        df.unpersist()
    if query.exception() is not None:
        raise RuntimeError(f"stream load failed: {query.exception()}")


def stream_report(spark: SparkSession, out_root: str) -> DataFrame:
    """Totals over all committed batches."""
    rep = spark.read.schema("batch_id long, loaded long, skipped long").json(
        f"{out_root}/report")
    return rep.agg(F.coalesce(F.sum("loaded"), F.lit(0)).cast("bigint").alias("transactions"),
                   F.coalesce(F.sum("skipped"), F.lit(0)).cast("bigint").alias("skipped_transactions"))
