"""From raw documents to packed training sequences, one operator per stage.

A stage takes what its predecessor kept and returns the columns of ``documents``;
only the last returns pieces. Between stages the rows are written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.llm import ngram_join, packing, quality, secret_scan, toxicity
from zoneflow.llm.common import read_table, remainder, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = read_table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    scored = quality.score_documents(docs, quality.train(docs, labels))
    return scored.where("predicted = 1").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not find toxic."""
    labels = read_table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1)
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels))
    return scored.where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of a secret in its place; ``n_chars`` follows."""
    cleaned = secret_scan.redact(secret_scan.find_secrets(docs)).select(docs.columns)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", hide_secrets),
    ("packing", pack),
]

# Learned scores and a tokenizer are not SQL; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
