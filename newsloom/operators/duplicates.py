"""Documents with the same vector, without comparing all pairs."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import dot
from ..session import ensure_checkpoint_dir

# Unit vectors whose product rounds to 1 at 12 decimals lie this close, along every direction.
TOLERANCE = 1.01e-6
# Width of grid cells along a direction, and directions that make the first grid.
CELL, FIRST = 1e-4, 4
# Cells with more rows are cut along further directions, down to this width.
MOST, FINEST = 64, 2e-5
# Cutting goes on while the rows of cells too large shrink to this share in a round.
LEAST_GAIN = 0.95


def _same(a: Column, b: Column) -> Column:
    return F.round(dot(a, b), 12) == 1


def _direction(dim: int, number: int) -> list[float]:
    """A fixed random unit vector."""
    r = np.random.default_rng(1000 + number).normal(size=dim)
    return (r / np.linalg.norm(r)).tolist()


def _cells(vec: Column, direction: list[float], width: float) -> Column:
    """The cell along a direction, and the next one where an edge is close."""
    x = dot(vec, F.lit(direction)) / F.lit(width)
    cell = F.floor(x)
    edge = F.lit(TOLERANCE / width)
    return (F.when(x - cell <= edge, F.array(cell - 1, cell))
            .when(cell + 1 - x <= edge, F.array(cell, cell + 1)).otherwise(F.array(cell)))


def _in_cells(groups: DataFrame, dim: int) -> DataFrame:
    """``(own, vec, bucket)``: rows that are the same share a bucket, and buckets are small wherever rows can be told apart.

    Rows are put into a grid of a few directions.  Buckets of more than MOST
    rows are cut along one more direction at a time; whatever some coordinates
    hold, rows further apart than a cell part company after a few rounds.  Rows
    as close as the finest cells stay together, and cutting them ends.
    """
    members = groups.select("own", "vec", F.lit(0).cast("long").alias("bucket"))
    for number in range(FIRST):
        members = members.withColumn("__c", F.explode(_cells(F.col("vec"), _direction(dim, number), CELL)))
        members = members.withColumn("bucket", F.xxhash64("bucket", "__c")).drop("__c")
    members, settled, number, before, width = members.checkpoint(), [], FIRST, None, CELL
    while True:
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.filter(F.col("n") > MOST)
        rows = large.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).head()[0]
        if rows == 0 or width <= FINEST and before is not None and rows > LEAST_GAIN * before:
            return reduce(DataFrame.unionByName, [*settled, members])
        before, width = rows, max(FINEST, width / 2)
        settled.append(members.join(large.select("bucket"), "bucket", "left_anti").select(*members.columns))
        cut = members.join(large.select("bucket"), "bucket").withColumn(
            "__c", F.explode(_cells(F.col("vec"), _direction(dim, number), width)))
        members = cut.select("own", "vec", F.xxhash64("bucket", "__c").alias("bucket")).checkpoint()
        number += 1


def flag_vector_duplicates(df: DataFrame, seq: str, url: str, dim: int) -> DataFrame:
    """``(seq, dupliURL)`` of every row whose unit ``vec`` an earlier row has too.

    ``dupliURL`` is that of the earliest such row.  Identical vectors first fall
    together in a partial aggregate, so a vector shared by a third of all rows
    is one row from there on.  The others meet in cells: each is compared with
    the first of its cell, and only those unlike it with the rest of it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(seq).alias("seq"), F.col(url).alias("url"), "vec")
    groups = (rows.groupBy("vec").agg(F.min(F.struct("seq", "url")).alias("own"), F.count(F.lit(1)).alias("n")).checkpoint())
    members = _in_cells(groups, dim)
    leaders = members.groupBy("bucket").agg(
        F.min("own").alias("head"), F.min_by("vec", "own").alias("head_vec"),
        F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1).drop("size")
    behind = members.join(leaders, "bucket").filter(F.col("own") > F.col("head"))
    behind = behind.withColumn("hit", _same(F.col("vec"), F.col("head_vec")))
    by_leader = behind.filter("hit").select("own", F.col("head").alias("orig"))
    unlike = behind.filter(~F.col("hit")).select("bucket", "own", "vec", "head")
    others = members.select("bucket", F.col("own").alias("orig"), F.col("vec").alias("orig_vec"))
    by_rest = (unlike.join(others, "bucket")
               .filter((F.col("orig") < F.col("own")) & (F.col("orig") > F.col("head"))
                       & _same(F.col("vec"), F.col("orig_vec"))).select("own", "orig"))
    earlier = by_leader.unionByName(by_rest).groupBy("own").agg(F.min("orig").alias("orig"))
    # groups that flag any row: several members, or an earlier group of the same vector
    flags = (groups.join(earlier, "own", "left").filter((F.col("n") > 1) | F.col("orig").isNotNull())
             .select(F.col("vec").alias("__vec"), F.coalesce("orig", "own").alias("orig")))
    # joined by 128 bits, and compared as a whole
    hashes = [F.xxhash64("vec").alias("__h0"), F.xxhash64("vec", F.lit(1)).alias("__h1")]
    flags = flags.withColumns({"__h0": F.xxhash64("__vec"), "__h1": F.xxhash64("__vec", F.lit(1))})
    return (rows.select("*", *hashes).join(flags, ["__h0", "__h1"])
            .filter((F.col("vec") == F.col("__vec")) & (F.col("seq") > F.col("orig.seq")))
            .select(F.col("seq").alias(seq), F.col("orig.url").alias("dupliURL")))
