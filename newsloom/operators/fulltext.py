"""Complete-word and prefix search, and the table of postings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import search_words
from ..session import drop_path, scratch_path
from ..sources.model import string_array
from .scan import page

# Ranges of words an index is cut into at least, and the rows of a range that a task sorts; the search reads one row for each range.
RANGES = 64
RANGE_ROWS = 1_000_000
# Keys in a row of the index: few enough that rows of a frequent word and of rare ones are of similar size.
GROUP = 16


class Term(NamedTuple):
    sign: str
    prefix: bool
    word: str

    def hit(self, word: Column) -> Column:
        return F.startswith(word, F.lit(self.word)) if self.prefix else word == self.word


def terms_of(query: str) -> list[Term]:
    """``foo,|bar,-baz,prefix:qu``: terms joined left to right by and, or, and not."""
    out = []
    for part in filter(None, (p.strip() for p in query.lower().split(","))):
        sign, term = (part[0], part[1:]) if part[0] in "|-+" else ("", part)
        kind, _, word = term.rpartition(":")
        if kind not in ("", "complete", "prefix"):
            raise ValueError(f"unknown kind of search {kind!r}")
        out.append(Term(sign, kind == "prefix", word))
    if not out:
        raise ValueError("empty query")
    return out


def folded(terms: Sequence[Term], hits: Sequence[Column]) -> Column:
    """The terms' hits, joined from left to right."""
    test: Column | None = None
    for term, hit in zip(terms, hits):
        if term.sign == "-":
            hit = ~hit
        test = hit if test is None else (test | hit) if term.sign == "|" else (test & hit)
    return test


def matches(words: Column, query: str) -> Column:
    terms = terms_of(query)
    return folded(terms, [F.exists(words, t.hit) if t.prefix else F.array_contains(words, t.word) for t in terms])


def fulltext(df: DataFrame, attr: str, query: str, key: str, skip: int | None = None,
             limit: int | None = None) -> DataFrame:
    found = df.filter(matches(search_words(F.col(attr)), query))
    if skip is None and limit is None:
        return found
    return page(found.orderBy(key), skip, limit)


def postings(df: DataFrame, attr: str, key: str, min_length: int = 1) -> DataFrame:
    """``(word, key)`` rows of a fulltext index.

    A frequent word stays many rows; no group ever holds all of its documents.
    """
    words = df.select(F.explode_outer(search_words(F.col(attr))).alias("word"), key)
    return words.filter(F.length("word") >= min_length)


def index_terms(index: DataFrame) -> DataFrame:
    return index.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


def write_postings(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Store postings so that a word is found in one of ``buckets`` folders, sorted within files."""
    key = next(c for c in index.columns if c != "word")
    (index.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
     .repartition("bucket", F.pmod(F.xxhash64(key), F.lit(16)))
     .sortWithinPartitions("bucket", "word").write.partitionBy("bucket").mode("overwrite").parquet(path))


def search_postings(index: DataFrame, words: list[str], key: str, buckets: int = 64) -> DataFrame:
    """Keys of documents that have all words, read from the stored index."""
    lowered = [w.lower() for w in words]
    bucket = F.pmod(F.xxhash64(F.lit(lowered[0])), F.lit(buckets))
    hit = (F.col("word") == lowered[0]) & (F.col("bucket") == bucket)
    for w in lowered[1:]:
        hit = hit | ((F.col("word") == w) & (F.col("bucket") == F.pmod(F.xxhash64(F.lit(w)), F.lit(buckets))))
    return (index.filter(hit).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == len(set(lowered))).select(key))


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, words)`` to rows ``(word, keys)`` of at most ``GROUP`` keys."""
    for batch in batches:
        lists = batch.column(1)
        coded = string_array(lists.flatten()).dictionary_encode()
        place = np.arange(len(coded))
        # by word, and in the order of the rows
        ordered = np.sort(coded.indices.to_numpy().astype(np.int64) << 32 | place)
        codes, order = ordered >> 32, ordered & 0xFFFFFFFF
        first = np.maximum.accumulate(np.where(np.diff(codes, prepend=-1) != 0, place, 0))
        starts = np.flatnonzero((place - first) % GROUP == 0)
        keys = batch.column(0).take(pc.list_parent_indices(lists).take(pa.array(order)))
        offsets = pa.array(np.append(starts, len(codes)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(codes[starts])), pa.ListArray.from_arrays(offsets, keys)],
            names=["word", batch.schema.names[0]])


def write_index(df: DataFrame, attr: str, key: str, path: str, min_length: int = 1, ranges: int = RANGES) -> None:
    """Store an index for ``search_index``: postings cut into ranges of words of about equal size, and the keys.

    There are ``ranges`` of them, or more so that none has far above ``RANGE_ROWS`` rows.

    A range is a folder, sorted by word, so one word or a prefix lies in a few
    folders and in a few stretches of their files.  A word with more postings
    than a range holds goes on in the next ones.  Words shorter than
    ``min_length`` are not stored; documents whose ``attr`` is null are in no
    result.

    A row is a word and up to ``GROUP`` keys, put together before anything is
    moved, and stored: the cut into ranges reads its rows twice.
    """
    spark = df.sparkSession
    words = F.filter(search_words(F.col(attr)), lambda w: F.length(w) >= min_length)
    schema = StructType([StructField("word", StringType()), StructField(key, ArrayType(df.schema[key].dataType))])
    draft = scratch_path(spark, "postings")
    df.select(key, words.alias("__words")).mapInArrow(_by_word, schema).write.parquet(draft)
    rows = spark.read.schema(schema).parquet(draft)
    ranges = max(ranges, -(-rows.count() // RANGE_ROWS))
    cut = rows.repartitionByRange(ranges, "word", F.xxhash64(key)).sortWithinPartitions("word")
    cut.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{path}/postings")
    drop_path(spark, draft)
    df.filter(F.col(attr).isNotNull()).select(key).write.parquet(f"{path}/keys")
    bounds = _stored(df.sparkSession, path).groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"))
    bounds.coalesce(1).write.parquet(f"{path}/bounds")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The postings ``(word, keys, part)``, keys under the name of the key, also of an index without any."""
    key = spark.read.parquet(f"{path}/keys").schema.fields[0]
    schema = StructType([StructField("word", StringType()), StructField(key.name, ArrayType(key.dataType)), StructField("part", IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/postings")


def search_index(spark: SparkSession, path: str, query: str, skip: int | None = None, limit: int | None = None) -> DataFrame:
    """Keys of the documents that match, from a stored index.

    Only ranges that can hold a term are read, and of their files the stretches
    with the term.  Every posting says which terms it meets, a document's
    postings are put together, and the query is an expression over them.  The
    table of all keys is read only if a document without any of the terms
    matches, as after a leading ``-``.
    """
    terms = terms_of(query)
    stored = _stored(spark, path)
    key = stored.columns[1]
    bounds = spark.read.parquet(f"{path}/bounds").collect()
    near = [r["part"] for r in bounds if any(
        r["first"] <= t.word <= r["last"] or t.prefix and (r["first"].startswith(t.word) or r["first"] <= t.word <= r["last"])
        for t in terms)]
    word = F.col("word")
    met = stored.filter(F.col("part").isin(near) & reduce(Column.__or__, [t.hit(word) for t in terms]))
    docs = met.select("word", F.explode(key).alias(key)).groupBy(key).agg(*[F.bool_or(t.hit(word)).alias(f"t{i}") for i, t in enumerate(terms)])
    found = docs.filter(folded(terms, [F.col(f"t{i}") for i in range(len(terms))])).select(key)
    nothing = spark.range(1).select(folded(terms, [F.lit(False)] * len(terms))).head()[0]
    if nothing:
        found = found.unionByName(spark.read.parquet(f"{path}/keys").join(docs.select(key), key, "left_anti"))
    if skip is None and limit is None:
        return found
    return page(found.orderBy(key), skip, limit)
