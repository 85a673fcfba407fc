"""The operators over the given tables, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.llm import (
    chat,
    nearest,
    ngram_join,
    packing,
    prefix_trie,
    quality,
    secret_scan,
    sentence_pieces,
    substrings,
    toxicity,
    url_filter,
    whitening,
    winnowing,
)
from zoneflow.llm.common import read_table, remainder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; learned from labels outside the held-out third."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 3) == 1
    model = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "matches")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents; counts and digest of the base kinds."""
    docs = read_table(spark, sf_dir, "documents")
    found = secret_scan.find_secrets(docs)
    spans = F.col("spans")
    base = [r.kind for r in secret_scan.BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    of_base = F.filter(spans, lambda s: s["kind"].isin(base))
    digest = F.sha2(secret_scan.span_list(of_base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secret_scan.span_list(spans).alias("spans"))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: size, score and digest of the ids."""
    docs = read_table(spark, sf_dir, "documents")
    return sentence_pieces.encoding_summary(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; learned from labels outside the held-out fifth."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    model = quality.train(docs, labels.where(~held_out))
    scored = quality.score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, compared."""
    return winnowing.compare_with_edited(read_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five words, Jaccard 0.8 or more."""
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all others."""
    return nearest.search(read_table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of all pages' urls."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations but those that another begins with, rendered."""
    return chat.render(read_table(spark, sf_dir, "conversations"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that occur more than once."""
    cut = substrings.remove_repeats(read_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256)
    return cut.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every beginning of the rebuilt conversations, with members, leaves and savings."""
    lists = prefix_trie.sequences(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.spliced(lists))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sound vectors, whitened along their eight leading components."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=8)


OPERATORS = (
    op1_toxicity,
    op2_secret_scan,
    op3_sentence_pieces,
    op4_quality_classifier,
    op5_winnowing,
    op6_ngram_jaccard_join,
    op7_nearest_neighbours,
    op8_url_filter,
    op9_chat_formatting,
    op10_best_fit_packing,
    op11_substring_dedup,
    op12_prefix_trie,
    op13_whitening,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f.__name__: f for f in OPERATORS},
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    "op2_secret_scan": secret_scan.SQL,
    "op6_ngram_jaccard_join": ngram_join.SQL,
    "op9_chat_formatting": chat.SQL,
    "op11_substring_dedup": substrings.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
