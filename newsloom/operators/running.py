"""What came before, per key, without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import global_rank

# Rows ordered by one task.
WIDTH = 1 << 20


def previous_max(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str = "before",
                 width: int = WIDTH) -> DataFrame:
    """Add the largest ``value`` of the earlier rows of the same keys.

    Rows are ranked over range partitions by key and order, and cut into
    buckets of ``width`` ranks, whatever their values are; the maxima of earlier
    buckets come from one row per key and bucket.  A key with most of the rows
    is thus cut into many windows.
    """
    rows = global_rank(df.withColumn("__value", value), [*[F.col(k) for k in keys], *order], "__rank")
    rows = rows.withColumn("__bucket", F.floor(F.col("__rank") / F.lit(width)))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.max("__value").over(inside))
    tops = rows.groupBy(*keys, "__bucket").agg(F.max("__value").alias("__top"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__earlier", F.max("__top").over(earlier)).drop("__top")
    # greatest passes over nulls
    return (rows.join(tops, [*keys, "__bucket"]).withColumn(name, F.greatest("__inside", "__earlier"))
            .drop("__bucket", "__value", "__inside", "__earlier", "__rank"))
