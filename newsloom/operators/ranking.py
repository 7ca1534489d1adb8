"""Global ranks without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir

# Up to this many rows a top-k is ranked directly.
DIRECT = 100_000


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 0-based rank of every row, sorted over many tasks.

    Rows are range-partitioned and sorted, and the result is written to the
    checkpoint folder, so the positions do not change if a task is rerun.  The
    rank is the position inside a partition plus the sizes of those before it:
    one number per partition, not per row.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("__id", F.monotonically_increasing_id()).checkpoint())
    part, local = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
            .withColumn(name, F.col("__offset") + local).drop("__id", "__part", "__offset"))


def top_ranked(df: DataFrame, order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows with their 0-based rank."""
    if k > DIRECT:
        ranked = global_rank(df, order, name)
        return ranked.filter(F.col(name) < k)
    top = df.orderBy(*order).limit(k)
    return top.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
