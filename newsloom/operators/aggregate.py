"""Counts, breakdowns, checksums and partition bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

MODULUS = 1 << 32


def count_docs(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per group; null is a group of its own."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def pivot_drift(pivots: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recount the documents of every pivot.

    Returns the pivots with corrected ``nDocs`` and one row: share of pivots
    that were off and, over those, the mean relative error.
    """
    actual = docs.groupBy("partition").agg(F.count(F.lit(1)).alias("actual"))
    joined = (pivots.join(actual, "partition", "left")
              .withColumn("actual", F.coalesce("actual", F.lit(0))))
    off = F.col("nDocs") != F.col("actual")
    error = F.when(off & (F.col("actual") > 0), F.abs(F.col("nDocs") - F.col("actual")) / F.col("actual"))
    report = joined.agg(F.count(F.lit(1)).alias("n_pivots"), F.count_if(off).alias("n_off"),
                        F.coalesce(F.avg(error), F.lit(0.0)).alias("mean_err"))
    report = report.select("n_pivots", "n_off", (F.col("n_off") / F.col("n_pivots")).alias("pct_off"),
                           "mean_err")
    fixed = joined.withColumn("nDocs", F.col("actual")).select(*pivots.columns)
    return fixed, report


def partition_increments(pivots: DataFrame, batch: DataFrame) -> DataFrame:
    """New size of every partition the batch touches."""
    added = batch.groupBy("partition").agg(F.count(F.lit(1)).alias("added"))
    return (pivots.select("partition", "nDocs").join(added, "partition")
            .select("partition", "added", (F.col("nDocs") + F.col("added")).alias("nDocs")))


def oversize_partitions(counts: DataFrame, partition_size: int) -> DataFrame:
    return counts.filter(F.col("nDocs") > 2 * partition_size)


def table_stats(df: DataFrame, text_columns: Sequence[str]) -> DataFrame:
    """Alive count, the count as shown in millions, filled values, text bytes."""
    alive = F.count(F.lit(1))
    size = sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in text_columns), F.lit(0))
    return df.agg(alive.alias("alive"),
                  ((alive - alive % 100000) / F.lit(1000000.0)).alias("millions"),
                  *[F.count(c).alias(f"n_{c}") for c in df.columns],
                  size.alias("text_bytes"))


def table_checksum(df: DataFrame, columns: Sequence[str], rev: str | None = None, with_rev: bool = False,
                   with_data: bool = True) -> DataFrame:
    """Order-independent checksum of the given columns, the first of which is the key.

    A value is written with its length before it and a null as ``n``, so no two
    rows read alike.  Without ``with_data`` only the key counts, and with
    ``with_rev`` the column ``rev`` does too.  Decimal sums cannot overflow,
    however many rows there are.
    """
    if with_rev and rev is None:
        raise ValueError("name the revision column")
    chosen = [*columns[:None if with_data else 1], *([rev] if with_rev else [])]
    text = [F.col(c).cast("string") for c in dict.fromkeys(chosen)]
    parts = [F.when(t.isNull(), "n").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in text]
    word = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("decimal(12,0)")
    total = F.sum(word)
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.coalesce(total % F.lit(MODULUS).cast("decimal(12,0)"), F.lit(0))
                  .cast("long").alias("checksum"))
