"""The registered queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskrank.llm import (
    byte_bpe, chat, hard_negatives, lexical, line_dedup, near_dup, packing, piece_bpe, quality, secrets, sharding,
    toxicity, vector_dup)
from riskrank.llm.common import table
from riskrank.llm.sql import SQL

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(SQL)

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(build: Callable[[SparkSession, str], DataFrame]):
    REGISTRY[build.__name__] = build
    return build


@query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    scanned = secrets.scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "secret_spans").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(spans).alias("spans"))


@query
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.link_documents(table(spark, folder, "documents"), near_dup.NearDup(words=2))


@query
def op3_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judge_documents(docs, quality.fit_references(docs))


@query
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, folder, "documents"), BYTE_VOCABULARY, public_tokenizers.PATTERN)


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    weights = toxicity.fit_toxicity(docs, table(spark, folder, "labels"))
    scored = toxicity.score_toxicity(docs, weights)
    return scored.withColumn("held_out", toxicity.held_out()).select(
        "doc_id", "held_out", "score", "predicted", "n_offending", "worst_start", "worst_end", "worst_score")


@query
def op6_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


@query
def op7_boilerplate_lines(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(
        table(spark, folder, "documents").select("doc_id", "source", "text"), removed_col="n_removed")
    return cleaned.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_kept"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query
def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.maximal_conversations(table(spark, folder, "conversations"))


@query
def op9_vector_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dup.link_vectors(table(spark, folder, "embeddings"))


@query
def op10_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), WORD_VOCABULARY)


@query
def op11_piece_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return piece_bpe.round_trip(table(spark, folder, "documents"), PIECE_MODEL)


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings").withColumn("label", moved))


@query
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
