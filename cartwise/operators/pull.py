"""Household data pull: a household's lines joined to products, in the six-key order.

The household filter is an equality on ``hshd_num`` that Catalyst pushes into the
Parquet scan (row groups are skipped by min/max), so the join and the sort only
see one household's lines. The full pull (every household) is range-partitioned
on the sort key and sorted within partitions: no single-task global sort.

Pages are read by position. ``page_index`` counts a key's lines per sorted range of a
stored, range-sorted copy; a page is then a seek: the ranges that overlap it come from the
index, and the scan is filtered to its places in them. The cost of a page does not depend
on its number, and neither a task nor the driver holds the pages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.text import decimal_text
from cartwise.operators.numbering import in_ranges, range_starts
from cartwise.session import output_partitions, stage

DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 200
# The required sort keys, then our tie-break on the rest of the line
# (the six keys are not unique when a product appears twice in a basket).
PULL_SORT = ["hshd_num", "basket_num", "purchase_date", "product_num", "department",
             "commodity"]
TIE_BREAK = ["spend", "units", "store_region", "week_num", "year"]
PULL_COLUMNS = ["hshd_num", "basket_num", "purchase_date", "product_num", "department",
                "commodity", "spend", "units", "store_region", "week_num", "year"]


def clamp_page(page: int | None, size: int | None) -> tuple[int, int]:
    """page at least 1; size defaults to 50 and is clamped to 1..200."""
    p = max(1, int(page or 1))
    s = int(size or DEFAULT_PAGE_SIZE)
    return p, min(MAX_PAGE_SIZE, max(1, s))


def pull_lines(tx: DataFrame, products: DataFrame, hshd_num: int | None = None) -> DataFrame:
    """Lines (one household, or all when ``hshd_num`` is None) with product attributes."""
    lines = tx if hshd_num is None else tx.where(F.col("hshd_num") == F.lit(hshd_num))
    joined = lines.join(products.select("product_num", "department", "commodity"), "product_num")
    return joined.select(*PULL_COLUMNS)


def _ordered(lines: DataFrame) -> list:
    return [F.col(c).asc() for c in PULL_SORT + TIE_BREAK]


def shape_rows(lines: DataFrame) -> DataFrame:
    """The pull row: spend rendered as text without trailing zeros."""
    return lines.withColumn("spend", decimal_text("spend"))


def household_pull(tx: DataFrame, products: DataFrame, hshd_num: int,
                   scores: DataFrame | None = None) -> DataFrame:
    """All pages of one household, sorted; with ``scores`` its churn score beside the lines."""
    lines = pull_lines(tx, products, hshd_num)
    if scores is not None:      # joined before the sort, which a shuffle join would undo
        lines = attach_risk(lines, scores)
    return shape_rows(lines.orderBy(*_ordered(tx)))


def page_index(stored: DataFrame, key: str = "hshd_num") -> DataFrame:
    """(key, _part, _first, _rows, _before): where each key's lines lie in a stored table that
    ``numbering.in_ranges`` laid out with ``key`` first in its order. One row per key and range."""
    return range_starts(stored, key)


def read_page(stored: DataFrame, index: DataFrame, value: int, page: int = 1,
              page_size: int = DEFAULT_PAGE_SIZE, key: str = "hshd_num") -> DataFrame:
    """The lines of page ``page`` of one key, in order, from the stored table and its index.
    At most ``page_size`` ranges overlap a page; they become a filter on range and place."""
    p, s = clamp_page(page, page_size)
    skip = (p - 1) * s
    here = index.where((F.col(key) == F.lit(value)) & (F.col("_before") < skip + s)
                       & (F.col("_before") + F.col("_rows") > skip)).collect()
    wanted = F.lit(False)
    for r in here:
        start = r["_first"] + max(0, skip - r["_before"])
        stop = r["_first"] + min(r["_rows"], skip + s - r["_before"])
        wanted = wanted | ((F.col("_part") == r["_part"]) & F.col("_pos").between(start, stop - 1))
    return stored.where(wanted & (F.col(key) == F.lit(value))).orderBy("_part", "_pos")


def household_pull_page(tx: DataFrame, products: DataFrame, hshd_num: int,
                        page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page of a household's pull: its lines are laid out and indexed once (the whole
    fact, where the load has done that: ``service.household_pull``), then the page is read."""
    lines = pull_lines(tx, products, hshd_num)
    stored = stage(in_ranges(lines, _ordered(tx)), "pull-pages")
    return shape_rows(read_page(stored, page_index(stored), hshd_num, page, page_size).select(*PULL_COLUMNS))


def data_pull_all(tx: DataFrame, products: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every household's pull: range-partitioned on the sort prefix, sorted within
    partitions, so the partitions in order are the whole pull in order.

    Boundaries come from Spark's sampling of the whole sort key: no task sorts
    more than its range, and a household or a single basket with a huge share of the
    lines is split over several ranges instead of landing in one task.
    """
    lines = pull_lines(tx, products)
    n = partitions or output_partitions(lines.sparkSession)
    ranged = lines.repartitionByRange(n, *PULL_SORT, *TIE_BREAK)
    return shape_rows(ranged.sortWithinPartitions(*_ordered(tx)))


def household_line_counts(tx: DataFrame, households: DataFrame,
                          page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Lines per household (0 when none) and page count max(1, ceil(total / size)).

    ``tx`` is the line-level fact, or pre-counted rows carrying a ``lines`` column
    (e.g. one row per basket), which are summed instead of counted.
    """
    n = F.sum("lines") if "lines" in tx.columns else F.count(F.lit(1))
    counts = tx.groupBy("hshd_num").agg(n.alias("total"))
    out = households.select("hshd_num").join(counts, "hshd_num", "left")
    total = F.coalesce(F.col("total"), F.lit(0)).cast("bigint")
    return out.select(
        "hshd_num", total.alias("total"),
        F.greatest(F.lit(1), F.ceil(total / F.lit(page_size))).cast("bigint").alias("pages"))


def household_exists(households: DataFrame, scores: DataFrame, requested: list[int]) -> DataFrame:
    """For each requested household number: does it exist, and its churn score or NULL. The
    numbers (a request's few) filter the scans of both stored tables."""
    spark = households.sparkSession
    numbers = sorted(set(requested))
    known = (households.where(F.col("hshd_num").isin(numbers))
             .select("hshd_num", F.lit(True).alias("exists")).distinct())
    s = scores.where(F.col("hshd_num").isin(numbers)).select("hshd_num", "churn_probability", "risk_band")
    return (spark.createDataFrame([(n,) for n in numbers], "hshd_num bigint")
            .join(known, "hshd_num", "left")
            .join(s, "hshd_num", "left")
            .select("hshd_num", F.coalesce("exists", F.lit(False)).alias("exists"),
                    "churn_probability", "risk_band"))


def attach_risk(pull: DataFrame, scores: DataFrame) -> DataFrame:
    """Pull rows with the household's churn score beside them (NULL when not scored)."""
    return pull.join(scores.select("hshd_num", "churn_probability", "risk_band"),
                     "hshd_num", "left")
