"""Text normalisation as native column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

# The characters kept by cleaning and the spaced punctuation.
KEPT_CHARS = r"[^A-z 0-9.,;:!?()]"
PUNCTUATION = r"([.,;:!?()])"
SENTENCE_END = r"([A-z0-9]{2,} \.)[^A-z]"


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Two strings for ``translate``: accented letters with an ASCII base, then
    combining marks, which have no counterpart and are therefore deleted."""
    source, target, marks = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
            continue
        if not unicodedata.decomposition(ch):
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch)
                       if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base < "\x80":
            source.append(ch)
            target.append(base)
    return "".join(source + marks), "".join(target)


def strip_accents(text: Column) -> Column:
    source, target = _accent_table()
    return F.translate(text, source, target)


def trim_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Plain letters, digits and punctuation, single-spaced."""
    kept = F.regexp_replace(strip_accents(text), KEPT_CHARS, " ")
    return F.trim(F.regexp_replace(kept, r"  +", " "))


def tokenise_text(text: Column) -> Column:
    """Spaced punctuation, and no capital that only marks a sentence start."""
    spaced = F.regexp_replace(F.regexp_replace(text, PUNCTUATION, " $1 "), r" {2,}", " ")
    pieces = F.split(spaced, r"(?<=\. )", -1)
    lowered = F.transform(
        pieces,
        lambda p: F.when(p.rlike(r"^[A-Z][^A-Z]"),
                         F.concat(F.lower(F.substring(p, 1, 2)), F.substr(p, F.lit(3))))
        .otherwise(p))
    return trim_blanks(F.array_join(lowered, ""))


def split_tokenised(tokenised: Column) -> Column:
    return F.split(F.regexp_replace(tokenised, SENTENCE_END, "$1@"), "@", -1)


def split_sentences(text: Column) -> Column:
    return split_tokenised(tokenise_text(text))


def words_of(text: Column) -> Column:
    """Blank-separated tokens, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text))


def content_length(sentences: Column) -> Column:
    return F.aggregate(sentences, F.lit(0).cast("long"), lambda acc, s: acc + F.length(s))


def search_words(text: Column) -> Column:
    """Distinct lower-cased words, as the fulltext operators see them."""
    return F.array_distinct(
        F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def sample_content(pieces: Column) -> Column:
    """Pieces that read like a sentence: they end in one full stop, not in dots."""
    trimmed = F.transform(pieces, trim_blanks)
    return F.array_join(F.filter(trimmed, lambda t: t.rlike(r"^.*[^.]\.$")), " ")


def min_window_distance(a: Column, b: Column) -> Column:
    """Slide the shorter string over the longer; a struct with ``distance`` and ``offset``.

    Distance is edits per character.  Ties go to the later offset.  The scan
    ends once the best is under 0.5 and the current window exceeds it by more
    than 0.1, so only the prefix scanned so far decides.
    """
    return F.when((F.length(a) > 0) & (F.length(b) > 0), _window_distances(a, b))


@F.pandas_udf(StructType().add("distance", DoubleType()).add("offset", IntegerType()))
def _window_distances(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    found = [_closest_window(x, y) if x and y else (None, None) for x, y in zip(a, b)]
    return pd.DataFrame({"distance": pd.array([d for d, _ in found], dtype="Float64"),
                         "offset": pd.array([k for _, k in found], dtype="Int32")})


# Windows compared at a time.
WINDOWS = 4096


def _closest_window(a: str, b: str) -> tuple[float, int | None]:
    shorter, longer = (b, a) if len(b) < len(a) else (a, b)
    best, offset, n = 1.0, None, len(shorter)
    for at in range(0, len(longer) - n + 1, WINDOWS):
        for k, edits in enumerate(_edits(shorter, longer[at:at + WINDOWS + n - 1]).tolist(), at):
            d = edits / n
            if d <= best:
                best, offset = d, k
            elif best < 0.5 and d - best > 0.1:
                return best, offset
    return best, offset


def _edits(word: str, text: str) -> np.ndarray:
    """Edit distances of ``word`` to every window of its length in ``text``.

    Differences along a column of the edit matrix are the bits of 64-bit words
    (Myers; Hyyrö for whole strings), and a step moves all windows by one
    character.
    """
    n, one = len(word), np.uint64(1)
    m, blocks = len(text) - n + 1, -(-n // 64)
    letters, codes = np.unique(np.array([ord(c) for c in word + text], dtype=np.uint32), return_inverse=True)
    equal = np.zeros((blocks, len(letters)), dtype=np.uint64)
    for i, c in enumerate(codes[:n]):
        equal[i // 64, c] |= np.uint64(1 << i % 64)
    equal = equal[:, codes[n:]]
    up, down = np.full((blocks, m), ~np.uint64(0)), np.zeros((blocks, m), dtype=np.uint64)
    score, last = np.full(m, n, dtype=np.int64), np.uint64((n - 1) % 64)
    for j in range(n):
        # the row above the matrix grows by one
        more, less = np.ones(m, dtype=np.uint64), np.zeros(m, dtype=np.uint64)
        for i in range(blocks):
            eq, pv, mv = equal[i, j:j + m], up[i], down[i]
            xv = eq | mv
            eq = eq | less
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            top = last if i == blocks - 1 else np.uint64(63)
            out = (ph >> top) & one, (mh >> top) & one
            ph, mh = (ph << one) | more, (mh << one) | less
            up[i], down[i] = mh | ~(xv | ph), ph & xv
            more, less = out
        score += more.astype(np.int64) - less.astype(np.int64)
    return score
