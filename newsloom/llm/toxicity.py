"""Toxicity: a factorisation machine over the hashed words of a text.

Linear weights catch an insult by itself; the factors add what a pair of words
means together, such as an insult next to the mention of a group.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from . import factorization
from .common import fold

WORD = re.compile(r"[^\W_]+")
THRESHOLD = 0.5


def words(text: str | None) -> Iterable[str]:
    """Distinct words in lower case; null has none."""
    return set(WORD.findall(text.lower())) if text else ()


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = factorization.SAMPLE_ROWS):
    """A model from ``documents(doc_id, text)`` and ``labels(doc_id, toxic)``, without the rows of the held-out fold.

    At most ``sample_rows`` labelled rows are read.  No labelled row at all
    gives the constant model with score 0.5.
    """
    usable = labels.filter(fold(F.col("doc_id")) != 0).select("doc_id", "toxic")
    return factorization.train(docs.select("doc_id", "text"), usable, "toxic", ["text"], words, sample_rows, factors=4)


def score_toxicity(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity in ``name``.

    Every row keeps its columns; one called ``name`` is replaced.  Null, empty
    and unknown texts get the score of a text without known words.
    """
    return factorization.score(docs, model, ["text"], words, name)
