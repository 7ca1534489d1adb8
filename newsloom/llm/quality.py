"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Statistics of the text's structure enter as bins, so that pairs of them, and
pairs of a bin and a word, get weights of their own.  Scoring is linear in the
number of features through the sum-of-squares identity.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from . import factorization
from .common import fold

WORD = re.compile(r"[^\W_]+")
THRESHOLD = 0.3


def _bin(x: float, step: float) -> int:
    return int(x / step)


def structure(text: str) -> Iterable[str]:
    """Bins of length, symbols, repetition, line and word shape."""
    n = max(1, len(text))
    tokens = text.split()
    m = max(1, len(tokens))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    shapes = {
        "chars": int(math.log2(n)),
        "letters": _bin(sum(map(len, WORD.findall(text))) / n, .05),
        "symbols": min(20, _bin(sum(text.count(c) for c in "#$%&*|<>{}[]\\^~=_@") / m, .1)),
        "bars": min(10, _bin(text.count("|") / m, .1)),
        "digits": min(20, _bin(sum(text.count(c) for c in "0123456789") / n, .05)),
        "stops": min(20, _bin(sum(text.count(c) for c in ".!?") / m, .02)),
        "commas": min(20, _bin(text.count(",") / m, .02)),
        "distinct": _bin(len(set(tokens)) / m, .05),
        "runs": min(20, _bin(sum(a == b for a, b in zip(tokens, tokens[1:])) / m, .05)),
        "lines": _bin(len(set(lines)) / k, .1),
        "wordlen": min(20, int(sum(map(len, tokens)) / m)),
        "linelen": int(math.log2(1 + n / k)),
    }
    return (f"\x00{name}:{value}" for name, value in shapes.items())


def features(text: str | None, n_chars) -> Iterable[str]:
    """Words, structure, and the stated length against the real one; null is the empty text."""
    text = text or ""
    out = set(WORD.findall(text.lower()))
    out.update(structure(text))
    stated = -1 if n_chars is None or n_chars != n_chars else int(n_chars)
    out.add(f"\x00stated:{'none' if stated < 0 else 'same' if stated == len(text) else 'other'}")
    return out


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = factorization.SAMPLE_ROWS):
    """A model from ``documents(doc_id, text, n_chars)`` and ``labels(doc_id, quality)``, without the held-out fold."""
    usable = labels.filter(fold(F.col("doc_id")) != 0).select("doc_id", "quality")
    return factorization.train(docs.select("doc_id", "text", "n_chars"), usable, "quality", ["text", "n_chars"],
                               features, sample_rows, factors=6)


def score_quality(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality in ``name``; a column of that name is replaced."""
    return factorization.score(docs, model, ["text", "n_chars"], features, name)
