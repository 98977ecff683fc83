"""Numbering rows in a global order without a window over all of them.

Rows are range-partitioned and sorted by the order, and stored with their range
(``_part``) and place in it (``_pos``, from 0). The number of a row is its place plus the
rows of the ranges before, and those are counted per range: one row per range, whatever
the input. The stored copy makes the numbers repeatable, also after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.session import output_partitions, stage

_PLACE = (1 << 33) - 1      # row bits of monotonically_increasing_id


def in_ranges(df: DataFrame, order: list[str | Column], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with ``_part`` and ``_pos``; to be
    stored before it is read, as the ranges are sampled anew in each run."""
    n = partitions or output_partitions(df.sparkSession)
    return (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumns({"_part": F.spark_partition_id(),
                            "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}))


def range_starts(stored: DataFrame, *keys: str) -> DataFrame:
    """Per key and range (without keys: per range): the first place, the rows, and the
    key's rows in the ranges before (``_first``, ``_rows``, ``_before``)."""
    per = stored.groupBy(*keys, "_part").agg(F.min("_pos").alias("_first"),
                                             F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part")
    return per.withColumn("_before", F.sum("_rows").over(earlier) - F.col("_rows"))


def dense_index(df: DataFrame, order: list[str | Column], name: str = "index") -> DataFrame:
    """``df`` with 0, 1, 2, ... in ``order`` (which should be total) as column ``name``."""
    stored = stage(in_ranges(df, order), "numbered")
    starts = F.broadcast(range_starts(stored).select("_part", "_before"))   # one row per range
    return (stored.join(starts, "_part")
                  .select(*df.columns, (F.col("_before") + F.col("_pos")).alias(name)))


def with_line_id(df: DataFrame, line: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` laid out as by ``in_ranges`` on ``line`` (all of its columns), with ``line_id``:
    the md5 of the line's text and of its number among equal lines.

    The id depends on nothing but the lines: not on files, partitions or the order in which
    they are read. Equal lines share a range, and the range's sort numbers them on the way.
    """
    n = partitions or output_partitions(df.sparkSession)
    equal = Window.partitionBy(*line).orderBy(line[-1])
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in line],
                       F.col("_copy").cast("string"))
    return (df.repartitionByRange(n, *line).withColumn("_copy", F.row_number().over(equal))
              .withColumn("line_id", F.md5(text)).drop("_copy").sortWithinPartitions(*line)
              .withColumns({"_part": F.spark_partition_id(),
                            "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}))
