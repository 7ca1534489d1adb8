"""Set operations on columns of values."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def subtract_keys(values: DataFrame, *tables: DataFrame) -> DataFrame:
    """Values in none of the tables, without repeats."""
    name = values.columns[0]
    out = values.distinct()
    for table in tables:
        out = out.join(table.select(table[table.columns[0]].alias(name)), name, "left_anti")
    return out


def intersect_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
