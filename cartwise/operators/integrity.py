"""Integrity: the constraint report and the fact's referential split.

Spark does not enforce keys, so the load checks them as queries: one aggregate
per dimension for NOT NULL / range checks, a grouped count for duplicate keys, and
one pass over the fact: its row checks and line counts per *distinct key*
(pre-aggregated, so the parents' join sees one row per key, never the raw
lines, and a hot key costs one row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT32_MIN, INT32_MAX = -(2 ** 31), 2 ** 31 - 1


def _out_of_int32(c: str) -> Column:
    return (F.col(c) < INT32_MIN) | (F.col(c) > INT32_MAX)


def _checks(df: DataFrame, table: str, checks: dict[str, Column]) -> DataFrame:
    wide = df.agg(*[F.count_if(cond).alias(name) for name, cond in checks.items()])
    return (wide.unpivot([], list(checks), "check_name", "violations")
                .select(F.lit(table).alias("table_name"), "check_name",
                        F.col("violations").cast("bigint").alias("violations")))


def _duplicates(df: DataFrame, table: str, key: str) -> DataFrame:
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return dup.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit("pk_duplicate").alias("check_name"),
        F.col("violations").cast("bigint").alias("violations"))


def _transaction_report(tx: DataFrame, households: DataFrame, products: DataFrame) -> DataFrame:
    """Row checks and foreign keys of the fact, from one pass over it.

    Each line counts once for its household, with its row checks, and once for its product;
    the counts are combined map-side, so the parents meet one row per distinct key."""
    checks = transaction_checks()
    key = F.struct(F.lit("fk_household").alias("fk"), F.col("hshd_num").cast("bigint").alias("key"))
    other = F.struct(F.lit("fk_product").alias("fk"), F.col("product_num").cast("bigint").alias("key"))
    lines = tx.select(F.explode(F.array(key, other)).alias("k"),
                      *[F.coalesce(c, F.lit(False)).alias(name) for name, c in checks.items()])
    per_key = lines.groupBy("k.fk", "k.key").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(name) & (F.col("k.fk") == "fk_household")).alias(name) for name in checks])
    known = (households.select(F.lit("fk_household").alias("fk"), F.col("hshd_num").cast("bigint").alias("key"))
             .unionByName(products.select(F.lit("fk_product").alias("fk"),
                                          F.col("product_num").cast("bigint").alias("key")))
             .distinct().withColumn("known", F.lit(True)))
    wide = per_key.join(known, ["fk", "key"], "left").agg(
        *[F.sum(name).alias(name) for name in checks],
        *[F.sum(F.when(F.col("known").isNull() & (F.col("fk") == fk), F.col("n"))).alias(fk)
          for fk in ("fk_household", "fk_product")])
    return (wide.unpivot([], [*checks, "fk_household", "fk_product"], "check_name", "violations")
                .select(F.lit("transactions").alias("table_name"), "check_name",
                        F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations")))


def transaction_checks() -> dict[str, Column]:
    """Row checks of the fact; the load takes their counts in the job that writes it."""
    return {
        "not_null": (F.col("basket_num").isNull() | F.col("hshd_num").isNull()
                     | F.col("product_num").isNull() | F.col("purchase_date").isNull()
                     | F.col("spend").isNull() | F.col("units").isNull()
                     | F.col("store_region").isNull() | F.col("week_num").isNull()
                     | F.col("year").isNull()),
        "int_range": (_out_of_int32("basket_num") | _out_of_int32("hshd_num")
                      | _out_of_int32("product_num")),
        "spend_range": F.abs(F.col("spend")) >= F.lit(100000000),
    }


def dimension_report(households: DataFrame, products: DataFrame) -> DataFrame:
    """Key, NULL, range and duplicate checks of the two dimensions."""
    return (_checks(households, "households", {
        "pk_null": F.col("hshd_num").isNull(),
        "not_null": F.col("loyalty_flag").isNull(),
        "int_range": _out_of_int32("hshd_num"),
    }).unionByName(_duplicates(households, "households", "hshd_num"))
        .unionByName(_checks(products, "products", {
            "pk_null": F.col("product_num").isNull(),
            "not_null": (F.col("department").isNull() | F.col("commodity").isNull()
                         | F.col("brand_type").isNull() | F.col("is_organic").isNull()),
            "int_range": _out_of_int32("product_num"),
        })).unionByName(_duplicates(products, "products", "product_num")))


def constraint_report(households: DataFrame, products: DataFrame, tx: DataFrame,
                      parents: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(table_name, check_name, violations); a clean dataset has zero everywhere. ``parents``
    are the households and products that the foreign keys refer to, if not the checked ones."""
    known_h, known_p = parents or (households, products)
    return (dimension_report(households, products)
            .unionByName(_transaction_report(tx, known_h, known_p)))


def referential_split(tx: DataFrame, households: DataFrame, products: DataFrame) -> DataFrame:
    """The fact with two flags: household known, product known (one pass, outer joins)."""
    hk = households.select("hshd_num", F.lit(True).alias("household_known")).distinct()
    pk = products.select("product_num", F.lit(True).alias("product_known")).distinct()
    return (tx.join(hk, "hshd_num", "left").join(pk, "product_num", "left")
              .withColumn("household_known", F.coalesce("household_known", F.lit(False)))
              .withColumn("product_known", F.coalesce("product_known", F.lit(False))))


def valid_transactions(tx: DataFrame, households: DataFrame, products: DataFrame) -> DataFrame:
    """Lines whose household and product both exist (two semi joins)."""
    return (tx.join(households.select("hshd_num"), "hshd_num", "left_semi")
              .join(products.select("product_num"), "product_num", "left_semi"))


def orphan_counts(tx: DataFrame, households: DataFrame, products: DataFrame) -> DataFrame:
    """Orphan lines counted by what is missing."""
    flagged = referential_split(tx, households, products)
    orphans = flagged.where(~(F.col("household_known") & F.col("product_known")))
    return orphans.groupBy(
        (~F.col("household_known")).alias("household_missing"),
        (~F.col("product_known")).alias("product_missing")).agg(
        F.count(F.lit(1)).alias("lines"))
