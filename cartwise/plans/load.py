"""The load job: raw CSVs -> typed, referentially clean tables + a load report.

Shape: CSV scan (strings, bound by header) -> cleaning expressions -> the fact
is flagged against the dimension keys with outer joins (one pass, no collected
key sets) -> orphans counted and dropped -> only the surviving lines are parsed
further (a bad value on an orphan line is not an error) -> Parquet.

Replace semantics: every load writes a fresh version folder; readers see a
version only after all three tables are written and the version is appended
to the ``_versions`` log, so a failed load never leaves a cleared or half
loaded dataset behind.

The report numbers come from ``observe`` placed in the final stage of each job
(the dimension writes, the staged write of the parsed fact), where Spark applies a
task's metrics once, also when tasks are retried.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cartwise.functions import clean as C
from cartwise.operators.integrity import dimension_report, transaction_checks
from cartwise.operators.numbering import with_line_id
from cartwise.operators.pull import page_index
from cartwise.session import delete_folder, output_partitions, retire_versions
from cartwise.sources.raw_files import RAW_COLUMNS, read_raw_csv

TABLES = ("households", "products", "transactions")
# All columns of a line, in the pull's order (department and commodity follow from the product).
LINE = ["hshd_num", "basket_num", "purchase_date", "product_num", "spend", "units",
        "store_region", "week_num", "year"]


# (output column, raw column, parser, what the value must be); ``None`` parser = text.
Spec = tuple


def strict(df: DataFrame, specs: list[Spec], keep: list[str] | None = None) -> DataFrame:
    """Parse columns, then fail on the first value that did not parse.

    Two projections: the parsed values are computed once, and the check reads
    them as columns (Spark keeps an expensive expression that is read twice in
    its own projection instead of inlining it), so no parse runs twice per row.
    """
    keep = keep or []
    raws = sorted({raw for _, raw, _, _ in specs})
    # 1. trim every raw field once, in two steps; 2. parse from the trimmed values; 3. check.
    # Separate projections keep each generated expression small (one huge
    # projection falls out of whole-stage codegen's fast path).
    spaced = df.select(*keep, *raws, *[C.trim_spaces(r).alias(f"_s_{r}") for r in raws])
    trimmed = spaced.select(*keep, *raws, *[C.trim_rest(f"_s_{r}").alias(f"_t_{r}") for r in raws])
    parsed = trimmed.select(*keep, *raws,
                            *[(parser(f"_t_{raw}", trimmed=True) if parser is not None
                               else F.col(f"_t_{raw}")).alias(f"_p_{out}")
                              for out, raw, parser, _ in specs])
    checked = []
    for out, raw, parser, what in specs:  # raw text kept only for the messages
        p = F.col(f"_p_{out}")
        if parser is not None and what is not None:
            msg = F.concat(F.lit(f"Expected {what} in {raw} but got \""),
                           F.coalesce(F.col(raw), F.lit("<missing>")), F.lit("\""))
            checked.append(F.when(p.isNull(), F.raise_error(msg)).otherwise(p).alias(out))
        else:
            checked.append(p.alias(out))
    return parsed.select(*keep, *checked)


def clean_households(raw: DataFrame) -> DataFrame:
    return strict(raw, [
        ("hshd_num", "HSHD_NUM", C.parse_int, "an integer"),
        ("loyalty_flag", "L", C.parse_yes_no, "Y or N"),
        ("age_range", "AGE_RANGE", C.clean_optional_text, None),
        ("marital", "MARITAL", C.clean_optional_text, None),
        ("income_range", "INCOME_RANGE", C.clean_optional_text, None),
        ("homeowner", "HOMEOWNER", C.clean_optional_text, None),
        ("hshd_composition", "HSHD_COMPOSITION", C.clean_optional_text, None),
        ("hh_size", "HH_SIZE", C.clean_optional_text, None),
        ("children", "CHILDREN", C.clean_optional_text, None)])


def clean_products(raw: DataFrame) -> DataFrame:
    return strict(raw, [
        ("product_num", "PRODUCT_NUM", C.parse_int, "an integer"),
        ("department", "DEPARTMENT", C.clean_text, None),
        ("commodity", "COMMODITY", C.clean_text, None),
        ("brand_type", "BRAND_TY", C.clean_text, None),
        ("is_organic", "NATURAL_ORGANIC_FLAG", C.parse_yes_no, "Y or N")])


def flag_transactions(raw: DataFrame, households: DataFrame, products: DataFrame) -> DataFrame:
    """Raw lines with parsed keys and an ``orphan`` flag (household or product unknown).

    The key sets are joined, not collected: Spark broadcasts them when their
    size is under the broadcast threshold and shuffles otherwise.
    """
    rest = [c for c in raw.columns if c not in ("HSHD_NUM", "PRODUCT_NUM")]
    keyed = strict(raw, [("hshd_num", "HSHD_NUM", C.parse_int, "an integer"),
                         ("product_num", "PRODUCT_NUM", C.parse_int, "an integer")], keep=rest)
    hk = households.select("hshd_num", F.lit(True).alias("_known_h")).distinct()
    pk = products.select("product_num", F.lit(True).alias("_known_p")).distinct()
    flagged = keyed.join(hk, "hshd_num", "left").join(pk, "product_num", "left")
    return flagged.withColumn(
        "orphan", F.col("_known_h").isNull() | F.col("_known_p").isNull()).drop(
        "_known_h", "_known_p")


def _as_int(parser):
    return lambda c, trimmed=False: parser(c, trimmed=trimmed).cast("int")


def clean_transactions(flagged: DataFrame) -> DataFrame:
    """Parse the surviving lines strictly (orphans are dropped first)."""
    out = strict(flagged.where(~F.col("orphan")), [
        ("basket_num", "BASKET_NUM", C.parse_int, "an integer"),
        ("purchase_date", "PURCHASE_", C.parse_oracle_date, "a DD-MON-YY date"),
        ("spend", "SPEND", C.parse_money, "a money value"),
        ("units", "UNITS", _as_int(C.parse_int), "an integer"),
        ("store_region", "STORE_R", C.clean_text, None),
        ("week_num", "WEEK_NUM", _as_int(C.parse_int), "an integer"),
        ("year", "YEAR", _as_int(C.parse_int), "an integer")], keep=["hshd_num", "product_num"])
    return out.select("basket_num", "hshd_num", "purchase_date", "product_num", "spend", "units",
                      "store_region", "week_num", "year")


def read_inputs(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The input files that ``paths`` names, by table."""
    return {name: read_raw_csv(spark, path, RAW_COLUMNS[name]) for name, path in paths.items()}


def load_dataset(spark: SparkSession, paths: dict[str, str], target_root: str,
                 partitions: int | None = None, keep: int = 2, grace_s: float = 86_400) -> dict:
    """Load the three files into a new version under ``target_root``; return the report.

    A missing file, a NULL or out-of-range value and a repeated household or product
    number reject the load; the version before stays current. After publishing, the
    staged copy of the fact goes, and so do versions before the last ``keep`` once they
    are ``grace_s`` seconds old (``session.retire_versions``).
    """
    absent = [t for t in TABLES if not paths.get(t)]
    if absent:
        raise ValueError(f"missing input files: {', '.join(absent)}")
    raw = read_inputs(spark, paths)
    version = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    vdir = f"{target_root}/v={version}"

    obs_h = Observation("households")
    (clean_households(raw["households"]).observe(obs_h, F.count(F.lit(1)).alias("n"))
        .write.mode("errorifexists").parquet(f"{vdir}/households"))
    obs_p = Observation("products")
    (clean_products(raw["products"]).observe(obs_p, F.count(F.lit(1)).alias("n"))
        .write.mode("errorifexists").parquet(f"{vdir}/products"))

    # Flag against what was written (stable input, no second CSV parse of the dims).
    households = spark.read.parquet(f"{vdir}/households")
    products = spark.read.parquet(f"{vdir}/products")
    flagged = flag_transactions(raw["transactions"], households, products)
    # One pass over the CSV: count, drop orphans, parse, check, and stage the parsed lines
    # as Parquet in the version folder (all counts are taken in that job's final, writing
    # stage). The staged copy is what the range sample below reads, not the CSV again.
    staged = f"{vdir}/_staged_transactions"
    obs_t, obs_c = Observation("transactions"), Observation("checks")
    counted = flagged.observe(obs_t, F.count_if(~F.col("orphan")).alias("loaded"),
                              F.count_if(F.col("orphan")).alias("skipped"))
    checks = transaction_checks()
    (clean_transactions(counted)
        .observe(obs_c, *[F.count_if(c).alias(name) for name, c in checks.items()])
        .write.mode("errorifexists").parquet(staged))
    broken = [f"{r['table_name']}.{r['check_name']}: {r['violations']}" for r in
              dimension_report(households, products).where("violations > 0").collect()]
    broken += [f"transactions.{name}: {n}" for name in checks if (n := obs_c.get.get(name))]
    if broken:      # before anything is published
        delete_folder(spark, staged)
        raise ValueError(f"load rejected, constraint violations: {', '.join(broken)}")
    # Range-partitioned on the whole line in the pull's order, household first: files are
    # clustered by household for pruned pulls, a household or a single basket with a huge
    # share of the lines is split over several ranges, and pages are read by range and place.
    lines = with_line_id(spark.read.parquet(staged), LINE, partitions or output_partitions(spark))
    lines.write.mode("errorifexists").parquet(f"{vdir}/transactions")
    (page_index(spark.read.parquet(f"{vdir}/transactions")).repartitionByRange("hshd_num")
        .sortWithinPartitions("hshd_num", "_part").write.mode("errorifexists").parquet(f"{vdir}/page_index"))

    report = {
        "households": int(obs_h.get["n"]),
        "products": int(obs_p.get["n"]),
        "transactions": int(obs_t.get["loaded"] or 0),
        "skippedTransactions": int(obs_t.get["skipped"] or 0),
    }
    # Publish: append one row to the version log (a single committed file).
    spark.createDataFrame([(version, vdir, report["households"], report["products"],
                            report["transactions"], report["skippedTransactions"])],
                          "version string, path string, households long, products long, "
                          "transactions long, skipped long") \
        .coalesce(1).write.mode("append").json(f"{target_root}/_versions")
    delete_folder(spark, staged)
    published = [r["version"] for r in spark.read.json(f"{target_root}/_versions").select("version").collect()]
    retire_versions(spark, target_root, published, keep, grace_s)
    return report


def current_version(spark: SparkSession, target_root: str) -> str:
    log = spark.read.json(f"{target_root}/_versions")
    row = log.orderBy(F.desc("version")).select("path").first()
    if row is None:
        raise FileNotFoundError(f"no loaded dataset under {target_root}")
    return row["path"]


def read_loaded(spark: SparkSession, target_root: str) -> dict[str, DataFrame]:
    """The three tables of the current version (the fact with its ``line_id``)."""
    vdir = current_version(spark, target_root)
    tables = {t: spark.read.parquet(f"{vdir}/{t}") for t in TABLES}
    return {**tables, "transactions": tables["transactions"].drop("_part", "_pos")}


def read_pages(spark: SparkSession, target_root: str) -> tuple[DataFrame, DataFrame]:
    """The current version's fact with range and place, and its page index."""
    vdir = current_version(spark, target_root)
    return spark.read.parquet(f"{vdir}/transactions"), spark.read.parquet(f"{vdir}/page_index")


def report_frame(spark: SparkSession, report: dict) -> DataFrame:
    return spark.createDataFrame(
        [(report["households"], report["products"], report["transactions"],
          report["skippedTransactions"])],
        "households long, products long, transactions long, skipped_transactions long")
