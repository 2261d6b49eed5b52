"""From raw documents to packed batches: five stages over all documents.

Each stage takes what the one before kept. Language identification drops documents
without a clear language, the Jaccard join keeps one document of each group of near
copies, decontamination drops those that hold benchmark passages, the secret scan
blanks what it finds, and packing gives each document its place in a batch.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnwell.llm import language_id
from tarnwell.llm.common import settle
from tarnwell.llm.decontamination import drop_contaminated
from tarnwell.llm.jaccard_join import keep_first
from tarnwell.llm.packing import pack
from tarnwell.llm.secret_scan import blank_secrets
from tarnwell.sources import read_table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; learned from their own labels."""
    return language_id.keep_identified(docs, language_id.train(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Copies share 0.8 of their shingles of five words.
    """
    return keep_first(docs, percent=80, width=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return blank_secrets(docs, length_column="n_chars")


def packed(
    spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer_path: str | None = None
) -> DataFrame:
    """The pieces of all documents with their bucket and batch, by the token store's ids."""
    return pack(docs, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identified),
    ("jaccard_join", without_copies),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: The stages learn, hash and pack in ways that SQL can't express; tests/llm has the check.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
