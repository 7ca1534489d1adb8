"""Sharding by a permutation of row numbers.

Rows are numbered by their key.  A Feistel network permutes the numbers below
the next power of two, and walking along its cycle until a number of a row comes
up makes that a permutation of the rows.  The new number modulo the shards is
the shard, the quotient the slot: shards differ by one row at most, and where a
row went, or which row a slot holds, is computed without looking anything up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ranking import global_rank
from .common import crc32_sql

SHARDS = 40
SEED = 13
ROUNDS = 8
# The round function works modulo a prime below 2 ** 31, so that products fit a signed 64-bit number anywhere.
PRIME, FACTORS = 2147483647, (1103515245, 1664525)
# Bytes a row takes besides its text.
OVERHEAD = 16


def _keys(seed: int) -> list[int]:
    return [int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:8], 16) % PRIME for k in range(ROUNDS)]


class Permutation:
    """A keyed permutation of 0 to n - 1 and its inverse, for whole arrays; n up to 2 ** 62."""

    def __init__(self, n: int, seed: int = SEED):
        self.n, self.keys = n, _keys(seed)
        bits = max(2, (max(n, 1) - 1).bit_length())
        if bits > 62:
            raise ValueError("more rows than a round can mix")
        self.low, self.high = bits // 2, bits - bits // 2

    def _round(self, half: np.ndarray, k: int) -> np.ndarray:
        x = (half + self.keys[k]) % PRIME * FACTORS[0] % PRIME
        x ^= x >> 15
        x = x * FACTORS[1] % PRIME
        return x ^ (x >> 13)

    def _network(self, x: np.ndarray) -> np.ndarray:
        left, right = self.high, self.low
        for k in range(ROUNDS):
            a, b = x >> right, x & ((1 << right) - 1)
            x = (b << left) | (a ^ (self._round(b, k) & ((1 << left) - 1)))
            left, right = right, left
        return x

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = (self.high, self.low) if ROUNDS % 2 == 0 else (self.low, self.high)
        for k in reversed(range(ROUNDS)):
            # the round before had its halves the other way round
            left, right = right, left
            b, mixed = x >> left, x & ((1 << left) - 1)
            x = ((mixed ^ (self._round(b, k) & ((1 << left) - 1))) << right) | b
        return x

    def _walk(self, x, step) -> np.ndarray:
        x = step(np.array(x, np.int64))
        while len(out := np.flatnonzero(x >= self.n)):
            x[out] = step(x[out])
        return x

    def forward(self, rows) -> np.ndarray:
        """The new number of every row."""
        return self._walk(rows, self._network)

    def backward(self, numbers) -> np.ndarray:
        """The row that got every number."""
        return self._walk(numbers, self._back)


def place(rows, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers below ``n``."""
    new = Permutation(n, seed).forward(rows)
    return new % shards, new // shards


def row_at(shard, slot, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row numbers that lie in the given shards and slots."""
    return Permutation(n, seed).backward(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64))


def shuffled(rows: DataFrame, order: Sequence[Column], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``(row, shard int, slot long)``; columns of these names are replaced.

    ``row`` numbers the rows by ``order`` over range partitions.  Rows that
    ``order`` cannot tell apart are numbered as they come, over many tasks
    however many there are; with an order that tells different rows apart, the
    same rows, seed and number of shards give the same table.  No rows give an
    empty table.  Only the columns of ``rows`` move, so keep them few.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    tied = rows.drop("row", "shard", "slot").withColumn("__tie", F.monotonically_increasing_id())
    numbered = global_rank(tied, [*order, F.col("__tie")], "row").drop("__tie")
    permutation = Permutation(numbered.count(), seed)

    @F.pandas_udf("long")
    def renumbered(row: pd.Series) -> pd.Series:
        return pd.Series(permutation.forward(row.to_numpy()))

    new = renumbered(F.col("row").cast("long"))
    return (numbered.withColumn("__new", new).withColumn("shard", (F.col("__new") % shards).cast("int"))
            .withColumn("slot", F.expr(f"__new div {shards}")).drop("__new"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: ``(doc_id, size, text_crc32, text_hash, row, shard, slot)``, without its text.

    ``size`` is the bytes of the text and OVERHEAD; a null text has none and
    the checksum of nothing.  Rows are numbered by id (nulls first) and text;
    every repeated row has a place of its own.
    """
    raw = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
                         F.crc32(raw).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    return shuffled(narrow, [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("text_hash")], shards, seed)


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """``docs`` with ``row`` and ``slot`` as Parquet under ``folder/shard=K``, each file in the order of slots.

    Columns called ``row``, ``shard`` or ``slot`` are replaced.  A shard is cut
    into as many tasks as its share of the shuffle partitions, by slot, so
    few shards of a large table are not few tasks.
    """
    order = [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.xxhash64("text")]
    dealt = shuffled(docs, order, shards, seed)
    (dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(folder))


def read_shard(spark: SparkSession, folder: str, shard: int) -> DataFrame:
    """One shard in the order of its slots; only its files are read."""
    return spark.read.parquet(folder).filter(F.col("shard") == shard).orderBy("slot")


def _network_sql(left: str = "hi", right: str = "lo") -> str:
    """The rounds as nested queries over ``k(row, x, n, hi, lo)``."""
    sql = "k"
    for key in _keys(SEED):
        sql = (f"(SELECT row, n, hi, lo, ((x & ((1::BIGINT << {right}) - 1)) << {left}) | xor(x >> {right}, xor(m, m >> 13) & ((1::BIGINT << {left}) - 1)) AS x "
               f"FROM (SELECT *, xor(y, y >> 15) * {FACTORS[1]} % {PRIME} AS m FROM "
               f"(SELECT *, ((x & ((1::BIGINT << {right}) - 1)) + {key}) % {PRIME} * {FACTORS[0]} % {PRIME} AS y FROM {sql})))")
        left, right = right, left
    return sql


ORACLE = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) + {OVERHEAD} AS size,
  {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row, count(*) OVER () AS n FROM d),
w AS (SELECT row, row AS x, n, len - len // 2 AS hi, len // 2 AS lo, 0 AS steps
  FROM (SELECT row, n, greatest(2, length(ltrim(bin(n - 1), '0'))) AS len FROM r)
  UNION ALL SELECT row, x, n, hi, lo, 1 AS steps FROM (WITH k AS (SELECT row, x, n, hi, lo FROM w WHERE steps = 0 OR x >= n)
    SELECT * FROM {_network_sql()})),
p AS (SELECT row, x FROM w WHERE steps = 1 AND x < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {SHARDS} AS INT) AS shard, x // {SHARDS} AS slot, CAST(NULL AS INT) AS grown_shard
FROM r JOIN p USING (row)
"""
