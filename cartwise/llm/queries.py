"""The registered queries of the numbered operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartwise.llm.common import table
from cartwise.llm.decontaminate import contaminated
from cartwise.llm.fingerprints import fingerprint_documents
from cartwise.llm.html_extract import extract_pages
from cartwise.llm.jaccard_join import jaccard_components
from cartwise.llm.language import identify_languages
from cartwise.llm.licenses import scan_licenses
from cartwise.llm.oracles import CONTAMINATED, JACCARD, LICENSES, PREFIX_TRIE, RESAMPLING
from cartwise.llm.packing import pack_documents
from cartwise.llm.prefix_trie import conversation_trie
from cartwise.llm.resampling import resample
from cartwise.llm.sanitise import digest, find_personal_data
from cartwise.llm.sharding import shard_documents
from cartwise.llm.suffix_dedup import remove_repeats
from cartwise.llm.toxicity import score_documents

Builder = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90, count_links=False).drop("_id", "_th")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Builder] = {f.__name__: f for f in (
    op1_html_extraction, op2_minhash_fingerprints, op3_toxicity, op4_histogram_sharding, op5_ngram_jaccard_join,
    op6_suffix_dedup, op7_license_scan, op8_personal_data, op9_decontamination, op10_best_fit_packing,
    op11_language_id, op12_conversation_trie, op13_importance_resampling)}

ORACLES: dict[str, str] = {
    "op5_ngram_jaccard_join": JACCARD, "op7_license_scan": LICENSES, "op9_decontamination": CONTAMINATED,
    "op12_conversation_trie": PREFIX_TRIE, "op13_importance_resampling": RESAMPLING}
