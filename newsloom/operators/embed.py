"""Sentence and document vectors.

A document's sentences sit in one row, so with the word model on every executor
all scoring is one pass without a shuffle.  Words are looked up and vectors
summed by Arrow and numpy over whole batches.  A model too large to broadcast
is joined instead; both ways give the same vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from ..functions.text import words_of
from ..functions.vectors import sum_vectors, unit
from ..sources.model import Words, WordModel, string_array

# Word vectors gathered at a time: bounds the memory of a task, not the text.
GATHER = 1 << 14
# Sentences whose vectors a task holds at a time; a document is not cut.
SENTENCES = 1 << 14
SALTS = 16
TINY = 1e-12


def slices(batch: pa.RecordBatch, weights: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``most`` by their weights; a null weighs nothing."""
    total = np.cumsum(pc.fill_null(weights, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(total):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def by_sentences(batches: Iterator[pa.RecordBatch], sentences: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, pc.list_value_length(batch.column(sentences)), SENTENCES)


def segment_sums(rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Sum of consecutive rows with equal (ascending) ids."""
    out = np.zeros((n, rows.shape[1]))
    if len(ids):
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        out[ids[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(lengths == 0, 1.0, lengths)


def sentence_matrix(sentences: pa.Array, words: Words, weights: np.ndarray) -> np.ndarray:
    """Unit mean vector of each sentence's known words; zero if none is known."""
    tokens = pc.utf8_split_whitespace(sentences)
    owner = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
    index = words.find(tokens.flatten())
    known = index >= 0
    owner, index = owner[known], index[known]
    sums = np.zeros((len(sentences), weights.shape[1]))
    at = 0
    while at < len(index):
        # up to the end of a sentence, if one ends here: its sum does not depend on where the parts are cut
        end = at + GATHER
        if end < len(index):
            start = int(np.searchsorted(owner, owner[end]))
            end = start if start > at else end
        part = owner[at:end]
        first = part[0]
        rows = weights[index[at:end]].astype(np.float64, copy=False)
        sums[first:part[-1] + 1] += segment_sums(rows, part - first, part[-1] - first + 1)
        at = end
    return unit_rows(sums)


def core_mean(x: np.ndarray) -> np.ndarray:
    """Mean of the half of the sentences closest to what the document is about."""
    if len(x) == 1:
        return x[0]
    avg, std = x.mean(axis=0), x.std(axis=0)
    flat = std < TINY
    spread = np.where(flat, 0.0, np.abs(x - avg) / np.where(flat, 1.0, std)).mean(axis=1)
    score = x @ avg
    score = np.where(spread == 0, score, score / np.where(spread == 0, 1.0, spread))
    best = np.lexsort((np.arange(len(x)), -np.round(score, 9)))[:max(1, round(len(x) / 2))]
    return x[np.sort(best)].mean(axis=0)


def document_matrix(sent: np.ndarray, doc: np.ndarray, n: int, mode: str) -> np.ndarray:
    """One unit vector per document; rows of zeros where nothing was understood."""
    if mode == "mean":
        counts = np.maximum(np.bincount(doc, minlength=n), 1)[:, None]
        return unit_rows(segment_sums(sent, doc, n) / counts)
    out = np.zeros((n, sent.shape[1]))
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.array([], dtype=int)
    for a, b in zip(starts, np.r_[starts[1:], len(doc)]):
        out[doc[a]] = core_mean(sent[a:b])
    return unit_rows(out)


def vectors_to_arrow(m: np.ndarray, empty_is_null: bool = True) -> pa.Array:
    n, dim = m.shape
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim), type=pa.int32())
    null = ~m.any(axis=1) if empty_is_null else np.zeros(n, dtype=bool)
    return pa.ListArray.from_arrays(offsets, pa.array(m.ravel(), type=pa.float64()), mask=pa.array(null))


def matrix_of(vectors: pa.Array, dim: int | None = None) -> np.ndarray:
    """A batch of non-null vectors as a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(vectors), -1 if dim is None else dim) if len(vectors) else flat.reshape(0, dim or 0)


def _with_vec(batch: pa.RecordBatch, drop: str, arrays: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != drop]
    columns = [batch.column(n) for n in names] + list(arrays.values())
    return pa.RecordBatch.from_arrays(columns, names=names + list(arrays))


def _schema_with(df: DataFrame, drop: str, *extra: tuple[str, object]) -> StructType:
    schema = StructType([f for f in df.schema.fields if f.name != drop])
    for name, kind in extra:
        schema = schema.add(name, kind)
    return schema


def sentence_vectors(df: DataFrame, model: WordModel, sentences: str = "sentences") -> DataFrame:
    """One row per sentence: the other columns, ``pos`` and ``vec``."""
    if not model.fits:
        return _sentence_vectors_by_join(df, model, sentences)
    shared = model.broadcast()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = shared.value
        for batch in by_sentences(batches, sentences):
            lists = batch.column(sentences)
            owner = pc.list_parent_indices(lists)
            doc = owner.to_numpy(zero_copy_only=False)
            m = sentence_matrix(string_array(lists.flatten()), words, weights)
            first = np.searchsorted(doc, doc)
            names = [n for n in batch.schema.names if n != sentences]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).take(owner) for n in names]
                + [pa.array(np.arange(len(doc)) - first, type=pa.int32()), vectors_to_arrow(m, False)],
                names=names + ["pos", "vec"])

    return df.mapInArrow(run, _schema_with(df, sentences, ("pos", IntegerType()), ("vec", ArrayType(DoubleType()))))


def score_docs(df: DataFrame, model: WordModel, mode: str = "core", sentences: str = "sentences",
               key: str | None = None) -> DataFrame:
    """Add ``vec``, the unit vector of a document, in place of its sentences.

    ``mode`` is ``mean`` or ``core``; documents without a known word get null.
    ``key`` (unique) is needed only for a model too large to broadcast.
    """
    if mode not in ("mean", "core"):
        raise ValueError(f"unknown mode {mode!r}")
    if not model.fits:
        return _score_by_join(df, model, mode, sentences, key)
    shared = model.broadcast()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = shared.value
        for batch in by_sentences(batches, sentences):
            lists = batch.column(sentences)
            doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            m = sentence_matrix(string_array(lists.flatten()), words, weights)
            yield _with_vec(batch, sentences, {"vec": vectors_to_arrow(document_matrix(m, doc, len(batch), mode))})

    return df.mapInArrow(run, _schema_with(df, sentences, ("vec", ArrayType(DoubleType()))))


def _sentence_vectors_by_join(df: DataFrame, model: WordModel, sentences: str) -> DataFrame:
    """Words join the model under a salt, so that a frequent word spreads over tasks."""
    dim = model.shape[1]
    rest = [c for c in df.columns if c != sentences]
    sent = df.select(*rest, F.posexplode(sentences).alias("pos", "__sentence"))
    words = (sent.select(*rest, "pos", F.explode(words_of(F.col("__sentence"))).alias("word"))
             .withColumn("__salt", F.pmod(F.xxhash64(*rest, "pos"), F.lit(SALTS))))
    spread = model.table.select("word", "vec", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt"))
    sums = sum_vectors(words.join(spread, ["word", "__salt"]), [*rest, "pos"])
    known = sums.select(*rest, "pos", unit(F.col("vec")).alias("vec"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return (sent.select(*rest, "pos").join(known, [*rest, "pos"], "left")
            .withColumn("vec", F.coalesce("vec", zero)))


def _score_by_join(df: DataFrame, model: WordModel, mode: str, sentences: str, key: str | None) -> DataFrame:
    if key is None:
        raise ValueError("a key is needed to score with a model too large to broadcast")
    # a document's sentence vectors come back together: as many as its row held before
    vectors = _sentence_vectors_by_join(df.select(key, sentences), model, sentences)
    packed = vectors.groupBy(key).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "vec"))), lambda s: s["vec"]).alias("__vecs"))
    rest = df.drop(sentences).join(packed, key, "left").withColumn(
        "__vecs", F.coalesce("__vecs", F.array().cast("array<array<double>>")))
    dim = model.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_sentences(batches, "__vecs"):
            lists = batch.column("__vecs")
            doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            m = matrix_of(lists.flatten(), dim)
            yield _with_vec(batch, "__vecs", {"vec": vectors_to_arrow(document_matrix(m, doc, len(batch), mode))})

    return rest.mapInArrow(run, _schema_with(rest, "__vecs", ("vec", ArrayType(DoubleType()))))


def embed_text(queries: DataFrame, model: WordModel, key: str, text: str = "text") -> DataFrame:
    """``(key, vec, error)`` for a table of query texts."""
    from ..functions.text import split_sentences

    scored = score_docs(queries.select(key, split_sentences(F.col(text)).alias("sentences")), model, "mean", key=key)
    return scored.withColumn("error", F.when(F.col("vec").isNull(), "Cannot understand text"))


def known_words(df: DataFrame, model: WordModel, key: str, text: str, first_sentence: bool = False) -> DataFrame:
    """``(key, pos, word, idx)`` for the words of a text the model knows."""
    from ..functions.text import split_sentences

    source = F.get(split_sentences(F.col(text)), 0) if first_sentence else F.col(text)
    words = df.select(key, F.posexplode_outer(words_of(source)).alias("pos", "word"))
    # words stay where they are: the table is a checkpoint, whose size Spark does not know
    table = model.table.select("word", "idx")
    return words.join(F.broadcast(table) if model.fits else table, "word").select(key, "pos", "word", "idx")
