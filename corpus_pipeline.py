"""The training-corpus pipeline over ``documents``: quality rules, near-dedup, secret scan, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gives back what the next one reads; a stage's result is
written before the next one starts, so a lost executor repeats a stage's tasks at most. All stages but
the last return the columns of ``documents``.

Rows: a document with a null text fails the quality rules; repeated rows are one document for the
near-dedup; an empty table passes through as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrove.llm import bpe, near_copies, quality_rules, secrets, source_mixing
from evalgrove.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A document is not dropped for its length alone.
RULES = tuple(r for r in quality_rules.RULES if r.name != "max_words")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule, however long."""
    return quality_rules.keep(docs, RULES)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity of 0.8 or more over five-word shingles."""
    return near_copies.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by marks; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return source_mixing.emit(source_mixing.mix(docs)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    path = public_tokenizers.path(VOCABULARY)
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN).select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", mixing),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs


#: The stages' models and hashes have no SQL form; tests/llm compares run() with a plain version.
ORACLE_SQL = None
