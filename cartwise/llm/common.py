"""Helpers shared by the training-data operators.

Every operator selects the columns it needs under private names first, so extra
columns (whatever they are called) pass by it. A row is identified by its id and
a hash of its text, never by the id alone: rows that repeat an id with another
text are answered separately, fully repeated rows get the same answer each.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows stay below this (rows of a few longs).
BROADCAST_ROWS = 1_000_000
#: Rows of whole texts that go to Python at a time: Spark and Python each hold a batch, or two, in every task.
TEXT_ROWS = 1_000
#: Stands for a null id inside keys.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, extra...) with null texts read as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *[F.col(c) for c in extra])


def row_key(df: DataFrame) -> DataFrame:
    """Adds the row identity: ``_id`` (null as NO_ID) and ``_th`` (text hash)."""
    return df.withColumns({"_id": F.coalesce("doc_id", F.lit(NO_ID)), "_th": F.xxhash64("text")})


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored frame for broadcast if its counted rows are few; else leaves the
    join to Spark, which shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df


@contextmanager
def batches_of(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """What is run inside sends at most so many rows to Python at a time (or the session's number, if smaller)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
