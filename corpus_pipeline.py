"""A training corpus from `documents`: each stage works on all that the one before kept.

1. languages: documents whose language is rejected go, all others stay.
2. near_duplicates: one document of each group linked at a similarity of 0.8 over five-word shingles stays, the one of smallest doc_id.
3. secrets: all documents stay; the characters of secrets become a mark.
4. mixture: documents stay as often as the mix takes them, up to three times; those it takes no copy of, and those without words, go.
5. pieces: the corpus as piece ids, with the text that these decode to.

Stages 1 to 4 return the columns of their input. Rows alike in every column are rows of their own.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coldwatch.llm import languages, minhash, mixing, pieces, secrets
from coldwatch.llm.tables import short_batches
from coldwatch.session import freeze

VOCABULARY = "piece_bpe_32k.model"
ROWS = 500  # whole texts that a Python worker is handed at once


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out, keeps those near enough to a language."""
    model = languages.train(languages.learnt_from(docs))
    with short_batches(spark, ROWS):
        return freeze(languages.known_only(docs, model), "known")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copies(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, decoded: what a trainer reads, and the text it stands for."""
    with short_batches(spark, ROWS):
        return freeze(pieces.encoded_and_decoded(docs.select("doc_id", "source", "text"), public_tokenizers.path(VOCABULARY)), "encoded")


STAGES = [
    ("languages", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixture", mixture_stage),
    ("pieces", piece_stage),
]

# SQL expresses neither the language model nor the vocabulary; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = freeze(stage(spark, docs, sf_dir), name)
    return docs
