"""The corpus pipeline: stages over the documents table, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns documents with their own columns, but for
the last, which writes token files and returns what it reads back from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomline.llm.common import load, written
from loomline.llm.decontaminate import clean
from loomline.llm.minhash import without_duplicates
from loomline.llm.mixing import mixture, repeated
from loomline.llm.quality import keep_good, sites_of_documents
from loomline.llm.token_files import stored_tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return keep_good(docs, load(spark, sf_dir, "labels"), *sites_of_documents())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return without_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return clean(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their targets."""
    return repeated(docs, mixture(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files: (doc_id, start, n_tokens, ids_crc32)."""
    return stored_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_ids),
]
#: The first stage is a fitted model, the fourth is drawn by hashes: no SQL gives the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
