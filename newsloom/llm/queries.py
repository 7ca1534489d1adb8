"""The named queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (decontamination, fill_in_middle, importance, licenses, multi_index, ngram_join, pii, quality, segmentation, sharding,
               token_store, toxicity, transcripts)
from ..session import scratch_path
from .common import fold, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn=None, sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f
    return register(fn) if fn else register


def judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


@query(sql=decontamination.ORACLE)
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_hash")


@query
def op2_token_store(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tokenizer, store = public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-store")
    token_store.write_store(docs, store, tokenizer)
    width = len(token_store.Encoder(tokenizer, token_store.END).end)
    return token_store.read_back(spark, token_store.keys_of(docs), store, width)


@query
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_classes(table(spark, folder, "documents"), width=4, part=85, whole=100)


@query
def op4_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, folder, "embeddings"))


@query
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find_private(table(spark, folder, "documents")))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train_toxicity(docs, table(spark, folder, "labels"))
    return judged(toxicity.score_toxicity(docs.select("doc_id", "text"), model), toxicity.THRESHOLD)


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train_quality(docs, table(spark, folder, "labels"))
    return judged(quality.score_quality(docs.select("doc_id", "text", "n_chars"), model), quality.THRESHOLD)


@query
def op8_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    drawn = segmentation.sample_segmentations(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return drawn.select("doc_id", "sample", (F.length("ids") / 4).cast("long").alias("n_pieces"),
                        F.crc32("ids").alias("ids_crc32"), "log_prob", "log_inclusion", "restored")


@query
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.find_licenses(table(spark, folder, "documents"))


# How a transcript shows its speakers, by conversation: system, user, assistant; the last style shows none.
STYLES = [("System: ", "User: ", "Assistant: "), ("Instructions: ", "Human: ", "AI: "), ("### System\n", "### User\n", "### Assistant\n"),
          ("[system]: ", "[user]: ", "[bot]: "), ("**System**: ", "**User 1**: ", "**Speaker2:** "),
          ("<|im_start|>system\n", "<|im_start|>user\n", "<|im_start|>assistant\n"),
          ("[12:01] Admin: ", "[12:02] John Smith: ", "12:03 - Customer Service: "), ("\n", "\n", "\n")]


def raw_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as a transcript in one of the styles; roles are known outside the held-out fold."""
    turns = table(spark, folder, "conversations")
    style = F.crc32(F.concat(F.lit("style "), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).cast("binary")) % len(STYLES)
    shown = F.lit("")
    for k, marks in enumerate(STYLES):
        for role, mark in zip(transcripts.ROLES, marks):
            shown = F.when((style == k) & (F.col("role") == role), mark).otherwise(shown)
    return turns.select("conv_id", "turn", F.concat(shown, F.coalesce("text", F.lit(""))).alias("text"),
                        F.when(fold(F.col("conv_id")) != 0, F.col("role")).alias("role"))


@query
def op10_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    lines = transcripts.lines_of(raw_transcripts(spark, folder))
    turns = transcripts.canonical(transcripts.recover(lines, transcripts.train(lines)))
    return turns.select("conv_id", "turn", "line", "role", "n_lines", "rendered")


@query(sql=importance.ORACLE)
def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    ranked = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


@query(sql=fill_in_middle.ORACLE)
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    done = fill_in_middle.restore(fill_in_middle.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text")))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


@query(sql=sharding.ORACLE)
def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.shard_documents(table(spark, folder, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
