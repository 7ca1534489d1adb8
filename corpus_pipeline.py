"""A training corpus from raw documents: each stage applies one operator to all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm import decontamination, ngram_join, pii, segmentation, toxicity
from newsloom.llm.common import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; the model learns from the labelled originals."""
    model = toxicity.train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, "__toxic").filter(F.col("__toxic") < toxicity.THRESHOLD).drop("__toxic")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose sets of five-word shingles overlap to 0.8 or more."""
    return ngram_join.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced in their texts."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document: ``(doc_id, sample, ids, log_prob, log_inclusion, restored)``."""
    drawn = segmentation.sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return drawn.select("doc_id", "sample", "ids", "log_prob", "log_inclusion", "restored")


STAGES = [("toxicity", drop_toxic), ("n-gram join", drop_near_copies), ("decontamination", drop_leaks),
          ("personal data", hide_private), ("segmentation", segment)]

# A fitted model, a corpus statistic and a sampler: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
