"""Corpus pipeline over the documents table: each stage's Parquet output is the next one's input.

Toxic documents go, one document of each near-duplicate group stays, documents that
overlap the benchmark go, personal data are replaced, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartwise.llm.common import table
from cartwise.llm.decontaminate import decontaminate
from cartwise.llm.jaccard_join import drop_near_duplicates
from cartwise.llm.packing import pack_documents
from cartwise.llm.sanitise import sanitise
from cartwise.llm.toxicity import fit, reject
from cartwise.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    return reject(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles, Jaccard 0.8 or more."""
    return drop_near_duplicates(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what reveals them replaced."""
    return sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placements of the kept documents' pieces in bins."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", replace_personal_data),
    ("packing", pack),
]

#: The fitted and iterative stages cannot be stated in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
