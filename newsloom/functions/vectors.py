"""Small vector expressions for arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scale(v: Column, k: Column) -> Column:
    return F.transform(v, lambda x: x * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(v: Column) -> Column:
    """The vector over its norm; null for a zero vector."""
    # a one-element transform names the norm, so that it is not computed per coordinate
    return F.when(norm(v) > 0, F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / n)), 0))


def round6(x: Column) -> Column:
    """Six decimals, with minus zero folded into zero."""
    return F.round(x, 6) + F.lit(0.0)


def fingerprint(v: Column) -> Column:
    """Position-weighted sum: one number that tells vectors apart."""
    return round6(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0),
                              lambda acc, x: acc + x))


def sum_vectors(df: DataFrame, by: list[str], vec: str = "vec", weight: str | None = None) -> DataFrame:
    """``(*by, size, vec)``: number and sum of the vectors of each group.

    ``weight`` names a column that says how many vectors a row already sums.

    Coordinates are summed as rows, combined per task before they move, and put
    together again: one row per group and coordinate crosses the network.
    """
    n = F.lit(1).cast("long") if weight is None else F.col(weight)
    # outer: the optimizer would compute the vector again to test it before an inner explode
    rows = df.select(*by, n.alias("__n"), F.posexplode_outer(vec).alias("__d", "__x"))
    parts = (rows.filter(F.col("__d").isNotNull()).groupBy(*by, "__d")
             .agg(F.sum("__x").alias("__x"), F.sum("__n").alias("__n")))
    ordered = F.sort_array(F.collect_list(F.struct("__d", "__x")))
    return parts.groupBy(*by).agg(F.max("__n").alias("size"), F.transform(ordered, lambda s: s["__x"]).alias("vec"))
