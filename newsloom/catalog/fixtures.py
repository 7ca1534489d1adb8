"""Tables the queries derive from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.urls import skinny_url
from ..sources.config import CONFIG_SCHEMA
from .base import Tables

FIELDS = "URL,skinnyURL,domain,title,body,sentences,contentLength"


def known_pages(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All pages, and those already in the main, newbies and errors tables."""
    pages = t.pages.select("page_id", F.col("url").alias("URL"), skinny_url(F.col("url")).alias("skinnyURL"))
    return (pages, pages.filter(F.contains("URL", F.lit("?page"))), pages.filter(F.contains("URL", F.lit("#"))),
            pages.filter(F.contains("URL", F.lit(".html"))))


def site_config(t: Tables) -> DataFrame:
    rows = [("http://spam-farm.example.org", "spam", r".*spam-farm\.example\.org/.*"),
            ("http://www.example.com", "com", r".*example\.com/.*"),
            ("http://www.example.net", "net", r".*example\.net/.*")]
    full = [(d, c, FIELDS, "body", "", rgx, i) for i, (d, c, rgx) in enumerate(rows)]
    return t.spark.createDataFrame(full, CONFIG_SCHEMA + ", row_no int")


# A screening model for the test pages.
SCREENING = {"intercept": -3.0, "leanPct": 2.5, "length": 0.02, "nDash": 0.4, "nTokens": 0.3,
             "spam-farm.example.org": 2.0, "en": -0.5}


def article_sentences(t: Tables) -> DataFrame:
    """``(doc_id, n_chars, title, sentences)``: the first line is the title."""
    from ..functions import text

    return t.documents.select(
        "doc_id", "n_chars", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        text.split_sentences(text.clean_text(F.col("text"))).alias("sentences"))


def weights(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vec"))


def word_model(t: Tables):
    """The most frequent words, one for each weight vector there is."""
    from ..functions import text
    from ..operators.ranking import top_ranked
    from ..sources.model import WordModel, load_model

    tokens = text.tokenise_text(text.clean_text(F.col("text")))
    # an outer explode: for an inner one the optimizer tests the array first and so tokenises again
    counts = (t.documents.select(F.explode_outer(text.words_of(tokens)).alias("word"))
              .filter(F.col("word").rlike("[A-Za-z]")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    size = t.embeddings.count()
    vocab = top_ranked(counts, [F.col("n").desc(), F.col("word")], size, "idx").select("word", "idx")
    # stands for the stored model: derived once, read by every step
    return WordModel(load_model(vocab, weights(t)).table.checkpoint())


def pivots(t: Tables) -> DataFrame:
    """One pivot per label: its first vector."""
    first = t.embeddings.groupBy(F.col("label").cast("long").alias("partition")).agg(
        F.min_by("embedding", "vec_id").alias("vec"), F.count(F.lit(1)).alias("nDocs"))
    return first.select("partition", F.col("vec").cast("array<double>").alias("vec"), "nDocs")


def corpus(t: Tables, model) -> DataFrame:
    """Understood articles with mean vector and partition."""
    from ..operators.embed import score_docs
    from ..operators.nearest import nearest_pivot

    scored = score_docs(article_sentences(t), model, "mean", key="doc_id")
    return nearest_pivot(scored.filter(F.col("vec").isNotNull()), pivots(t)).drop("similarity")
