"""The corpus pipeline: toxic documents go, one document of each group of near copies stays,
documents with benchmark passages go, personal data is replaced, and what is left is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.llm import bpe, decontaminate, near_copies, severity, surrogates
from gridtally.llm.queries import SURROGATE_KEY, graded_labels, table
from gridtally.llm.words import bounded_batches
from gridtally.sources.shared import settle


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a probable grade above 0. Without labels all stay; null and empty texts
    get the base rate."""
    model = severity.fit_severity(docs, graded_labels(spark, sf_dir), "grade")
    return severity.drop_severe(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group on five-word shingles at a similarity of 0.8.
    Null and empty texts stay; a document with a null id is not told apart and stays."""
    bounded_batches(spark)
    return near_copies.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words in a row of a benchmark item occur. Null texts stay."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates, ``n_chars`` counted anew where it is known."""
    out = surrogates.replace_entities(docs, SURROGATE_KEY).drop("n_entities")
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.col("n_chars")))
        out = out.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in place of their text. A null text has none."""
    bounded_batches(spark)
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.drop("text").withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL cannot express the fitted model, the surrogates and the token ids; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
