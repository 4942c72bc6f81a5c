"""A pipeline over documents: quality rules, language, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
A stage works on all rows that the one before it kept, read again from Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, near_copies, packing, quality, secret_scan
from millrace.llm.common import drop_written, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep. Null and empty texts go; ids aren't read, so null and repeated ones stay or go by their texts."""
    return quality.kept_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told. Null texts and those without a letter go; without any label all go; ids aren't read."""
    return langid.kept_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts whose sets of five-word shingles have a similarity of 0.8.

    The one of the least id stays, repeated rows once; documents without an id stay; null, empty and wordless texts are one group.
    """
    return near_copies.kept_documents(docs, words=5, similarity=0.8, distance=3)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark, and n_chars counted anew. Null and empty texts stay as they are."""
    redacted = secret_scan.redacted_documents(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in training sequences. Null and empty texts are the end id; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the language model nor fingerprints, tokens and packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir; none where there are none."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
