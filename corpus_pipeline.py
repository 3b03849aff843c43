"""From raw documents to token ids: five stages, each a table of its own.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the docs of the next. All but the last
keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ondula.llm import byte_bpe, classifier, decontaminate, secrets, similar
from ondula.llm.common import bounded_batches, stored

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant accepts."""
    bounded_batches(spark)
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return similar.first_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.without_secrets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, exact, ids."""
    return byte_bpe.encode_checked(
        docs,
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", unlike),
    ("benchmark decontamination", unleaked),
    ("secret scans", redacted),
    ("byte-level BPE", encoded),
]

# The classifier and the merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
