"""Importance resampling towards a target: array-scored weights and a distributed quickselect.

A text is runs of one to three words, hashed into buckets.  How often each
bucket occurs in the documents and in the target gives it a gain; the gains are
one array, and a document's weight is the sum of the array at its buckets.  With
Gumbel noise from the row's key, the documents of highest score are a draw
without replacement.  They are found without sorting the others: random rows
serve as pivots, one pass counts how many rows lie before, at and behind each,
and the range that holds the last place drawn is searched again until a pivot
is that row.  Only the rows up to it are sorted and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import global_rank
from .common import crc32_sql, settle

BUCKETS = 10_000
# Longest run of words, and words a document needs to be drawn.
RUN, LEAST_WORDS = 3, 20
SEED = 42
# Five in a hundred are drawn.
PART, WHOLE = 5, 100
# Random rows a round of the search compares all others with.
PIVOTS = 31
# Bytes of text split into words at a time, and hashes counted at a time.
SLICE, COUNTED = 1 << 20, 1 << 18

# Lower-case letters and digits of ASCII and all bytes of other characters stay, anything else is a space.
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_FOLD = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded length."""
    at = 0
    while at < len(text):
        # a list ends before a byte that is no part of a word
        end = min(at + SLICE, len(text))
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


def features(text: bytes) -> Iterator[tuple[int, list[int]]]:
    """Per list of words: how many, and the crc32 of every run of words that ends in it."""
    before: list[bytes] = []
    for words in word_lists(text):
        run, old = before + words, len(before)
        hashes = list(map(crc32, run))
        out = hashes[old:]
        spaced = [b" " + w for w in run]
        for k in range(1, RUN):
            # a run of one more word goes on from the hash of the run before
            hashes = list(map(crc32, spaced[k:], hashes))
            out += hashes[max(old - k, 0):]
        before = run[1 - RUN:]
        yield len(words), out


def _texts(df: DataFrame) -> Column:
    return F.coalesce("text", F.lit("")).cast("binary").alias("text")


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``(bucket, n)``: features of all texts per bucket; every task adds up its own before anything is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting = np.zeros(BUCKETS, np.int64), []
        for batch in batches:
            for text in batch.column(0):
                for _, hashes in features(text.as_py()):
                    waiting += hashes
                    if len(waiting) >= COUNTED:
                        total += np.bincount(np.array(waiting, np.int64) % BUCKETS, minlength=BUCKETS)
                        waiting = []
        total += np.bincount(np.array(waiting, np.int64) % BUCKETS, minlength=BUCKETS)
        there = np.flatnonzero(total)
        if len(there):
            yield pa.record_batch({"bucket": pa.array(there.astype(np.int32)), "n": pa.array(total[there])})

    return (texts.select(_texts(texts)).mapInArrow(count, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, in thousandths: the log of its smoothed share in the target over that in ``docs``.

    The driver holds BUCKETS numbers, however large the tables are.
    """
    spark = docs.sparkSession
    both = (spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
            .join(bucket_counts(docs).withColumnRenamed("n", "s"), "bucket", "left")
            .join(bucket_counts(target).withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"]))
    rows = settle(both, "bucket-counts").toPandas().sort_values("bucket")
    s, t = rows["s"].to_numpy(np.float64), rows["t"].to_numpy(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the row's key; a null id draws like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """Per row: ``(doc_id, text_hash, n_words, n_features, weight, score)``, without its text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for row, text in enumerate(batch.column(batch.num_columns - 1)):
                for words, hashes in features(text.as_py()):
                    out[:, row] += words, len(hashes), of[np.array(hashes, np.int64) % BUCKETS].sum()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *map(pa.array, out)], ["doc_id", "text_hash", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _texts(docs)).mapInArrow(
        weigh, f"doc_id {kind}, text_hash long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def _key(score: Column, doc_id: Column) -> Column:
    """The composite key: higher scores first, then smaller ids, null ids last."""
    return F.struct((-score).alias("a"), doc_id.isNull().alias("b"), doc_id.alias("c"))


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS, seed: int = SEED) -> Column | None:
    """The key of the row at place ``k`` of ``rows(score, doc_id)``, counted from 1; None if there are fewer.

    Every round takes the rows of least hash in the range left as pivots, and
    counts the rows between and at them in one pass.  The driver sees the
    pivots and one count for each and each gap.  The pivots themselves leave
    the range, so the search always ends; the range shrinks by about the number
    of pivots each time.  The order of the pivots follows a hash of the key, so
    a key that many rows share is drawn no sooner than others.
    """
    kind = rows.schema["doc_id"].dataType
    rows = rows.select("score", "doc_id").withColumn("key", _key(F.col("score"), F.col("doc_id")))
    left, before, turn = rows, 0, 0
    while True:
        turn += 1
        drawn = (left.select("score", "doc_id")
                 .orderBy(F.xxhash64("score", "doc_id", F.lit(seed + turn)), "score", "doc_id").limit(pivots).collect())
        if not drawn:
            return None
        drawn = sorted(set(drawn), key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"]))
        keys = [_key(F.lit(r["score"]), F.lit(r["doc_id"]).cast(kind)) for r in drawn]
        # 2 i: between pivots i - 1 and i, 2 i + 1: at pivot i
        known = F.array(*keys)
        place = F.size(F.filter(known, lambda p: p < F.col("key"))) + F.size(F.filter(known, lambda p: p <= F.col("key")))
        counts = dict(left.groupBy(place.alias("place")).count().collect())
        for at in range(2 * len(keys) + 1):
            if before + counts.get(at, 0) >= k:
                break
            before += counts.get(at, 0)
        else:
            return None
        if at % 2:
            return keys[at // 2]
        lo, hi = at // 2 - 1, at // 2
        if lo >= 0:
            left = left.filter((F.col("key") > keys[lo]) & (F.col("score") <= drawn[lo]["score"]))
        if hi < len(keys):
            left = left.filter((F.col("key") < keys[hi]) & (F.col("score") >= drawn[hi]["score"]))


def draw(rows: DataFrame, part: int = PART, whole: int = WHOLE, least_words: int = LEAST_WORDS,
         pivots: int = PIVOTS) -> DataFrame:
    """``scored`` rows with ``rank``: 1, 2, 3 ... for those drawn, null for the others.

    Of the N rows with ``least_words`` words, ``part * N // whole`` are drawn.
    Rows alike in score and id stand in the order of their text's hash; of rows
    alike in that too, just as many are drawn as there is room for.
    """
    rows = settle(rows.drop("rank"), "scored")
    able = rows.filter(F.col("n_words") >= least_words)
    k = part * able.count() // whole
    last = kth_key(able, k, pivots) if k else None
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    first = (F.col("n_words") >= least_words) & (_key(F.col("score"), F.col("doc_id")) <= last)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash"), F.col("__tie")]
    won = global_rank(rows.filter(first).withColumn("__tie", F.monotonically_increasing_id()), order, "rank").drop("__tie")
    won = won.withColumn("rank", F.when(F.col("rank") < k, F.col("rank").cast("long") + 1))
    return won.unionByName(rows.filter(~first).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, part: int = PART, whole: int = WHOLE, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: ``(doc_id, text_hash, n_words, n_features, weight, score, rank)``.

    ``rank`` is null for rows that are not drawn.  Null and empty texts have no
    features, weight 0, and are never drawn; they count in neither table.  A
    repeated row is a row of its own with the same score.  An empty target
    gives every bucket the gain of a smoothed nothing.  Other columns are
    ignored, whatever their names.
    """
    return draw(scored(docs, gains(docs, target), seed), part, whole)


def drawn_documents(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of ``docs`` that were drawn, with all their columns; of repeated rows as many as were drawn."""
    won = ranked.filter("rank IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("__n"))
    won = won.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__n")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(won, same).drop("__id", "__hash", "__n")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUNS = ("unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), "
         "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))")

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT r, f, count(*) AS n FROM (SELECT r, {_RUNS} AS f FROM d) GROUP BY r, f),
bf AS (SELECT f, count(*) AS n FROM (SELECT {_RUNS} AS f FROM b) GROUP BY f),
h AS MATERIALIZED (SELECT f, {crc32_sql("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bf JOIN h USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS} AS DOUBLE)
  / (CAST(s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY r),
z AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS x FROM d LEFT JOIN w USING (r)),
y AS (SELECT doc_id, n_words >= {LEAST_WORDS} AS able, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((x + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {PART} * (SELECT count(*) FROM y WHERE able) // {WHOLE} THEN place END AS rank FROM o
"""
