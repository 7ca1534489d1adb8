"""What several operators of this package share: settled tables, connected components, folds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import prepare, scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


# Spark's setting that a query's shuffle files go when it has ended, not when the driver has collected its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read again.

    Cuts the lineage with files every executor can read; a lost executor costs
    only the tasks it ran.  The shuffles behind the table are deleted once it
    is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


# Keys of two numbers up to this many rows (under 64 MB as a hash table) are sent to every task.
FEW_KEYS = 500_000


def few(keys: DataFrame, name: str, limit: int = FEW_KEYS) -> DataFrame:
    """A settled table of keys, to be broadcast if it has at most ``limit`` rows, so that texts stay where they are."""
    keys = settle(keys, name)
    return F.broadcast(keys) if keys.count() <= limit else keys


# Bits of a sieve for each hash in it, and the fewest and most (8 MB, which every task gets) that a sieve has, as powers of two.
SIEVE_SPACE, SIEVE_LEAST, SIEVE_MOST = 32, 16, 26


def sieve(hashes: DataFrame, rows: int) -> Callable[[Column], Column]:
    """A test that all of ``hashes``, a settled column of ``rows`` 64-bit hashes, pass, and few other hashes do.

    Two bits a hash in one array of fixed size, which tasks get with their
    code; so rows of a large table that meet none of the hashes are left where
    they are, however many hashes there are.
    """
    bits = 1 << min(SIEVE_MOST, max(SIEVE_LEAST, (SIEVE_SPACE * rows).bit_length()))

    def slots(h: Column) -> list[Column]:
        return [h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1)]

    word, bit = lambda slot: F.shiftright(slot, 6), lambda slot: slot.bitwiseAND(63).cast("int")
    spark = hashes.sparkSession
    held = hashes.select(F.explode(F.array(*slots(F.col(hashes.columns[0])))).alias("slot"))
    held = held.select(word(F.col("slot")).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("slot"))).alias("bits"))
    words = (spark.range(bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")).unionByName(held)
             .groupBy("word").agg(F.bit_or("bits").alias("bits")))
    # put together in two levels, as structs of many words at once would take far more than the words
    pieces = words.groupBy(F.shiftright("word", 10).alias("piece")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))
    whole = pieces.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "words"))), lambda p: p["words"]))).scalar()
    return lambda h: reduce(Column.__and__, [F.getbit(F.get(whole, word(x).cast("int")), bit(x)) == 1 for x in slots(h)])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out.  A null id counts as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def _starred(links: DataFrame) -> bool:
    """True if every node is the larger end of one link and no smaller end, or a smaller end only."""
    ends = links.select("u").unionByName(links.select(F.col("v").alias("u")).distinct())
    return not ends.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").head(1)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges(a, b)``: the smallest id it reaches.

    Large star and small star in turn: each round moves all links of a node to
    its smallest neighbour, so a chain of any length ends after a number of
    rounds logarithmic in its length.  Links stay in tables; the driver learns
    once a round whether it was the last.  Self links name a node of its own.
    """
    links = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .filter(F.col("u").isNotNull() & F.col("v").isNotNull()).distinct())
    nodes = settle(links, "links")
    current = nodes.filter("u <> v")
    while not _starred(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # every larger neighbour is moved to the smallest one
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, "large-stars")
        # of the smaller neighbours all but the smallest are moved to it
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        current = settle(small, "small-stars")
    # settled: every larger node has one link, to the smallest of its component
    linked = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = nodes.select(F.col("v").alias("node")).unionByName(nodes.filter("u = v").select(F.col("u").alias("node")))
    return (roots.distinct().join(linked.select("node"), "node", "left_anti")
            .select("node", F.col("node").alias("component")).unionByName(linked))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of the UTF-8 bytes of a text; DuckDB has no such function."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    half = f"xor(c >> 4, {table}[(c & 15) + 1])"
    # a byte is two steps of four bits
    step = f"list_reduce([xor(c, y), 0, 0], lambda c, z: {half})"
    byte = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, y: {step}), 4294967295::BIGINT)"
