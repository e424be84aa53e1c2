"""A corpus pipeline of five stages; each works on all rows that its predecessor kept.

Quality rules, exact dedup and near-dedup drop rows, secret scans rewrite texts; these four return the columns of
documents. The last stage packs what is left into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import common, cuckoo_dedup, near_texts, packing, quality_rules, secret_scans


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go."""
    return quality_rules.kept_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return cuckoo_dedup.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with 0.8 or more of their five-word shingles in common, the row with the smallest doc_id stays.
    The SimHash index finds the nearest copies, prefix filtering the others; an exact check follows both."""
    return near_texts.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes [SECRET]; n_chars follows the text where it changed."""
    before = common.unused(docs, "__before")
    clean = secret_scans.redact(docs.withColumn(before, F.length("text")))
    return clean.withColumn("n_chars", (F.col("n_chars") - F.col(before) + F.length("text")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: the sequence that it is in, and its place there."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", good_quality),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: Tokenizing and fingerprinting have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents; what a stage returns is written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, name)
    return docs
