"""Column and key naming."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def capital_parts(name: str) -> list[str]:
    """A name cut before every run of capitals but a leading one."""
    cuts = [i for i in range(1, len(name)) if "A" <= name[i] <= "Z" and not "A" <= name[i - 1] <= "Z"]
    return [name[i:j] for i, j in zip([0, *cuts], [*cuts, len(name)])]


LETTERS = re.compile(r"[^\W\d_]+")


def camel(name: str) -> str:
    """Behind the first underscore every run of letters starts with its only capital; underscores go."""
    if "_" not in name:
        return name
    kept = name.index("_")
    return name[:kept] + LETTERS.sub(lambda run: run.group().capitalize(), name[kept:]).replace("_", "")


def snake(name: str) -> str:
    return "_".join(capital_parts(name)).lower()


def rename_camel(df: DataFrame) -> DataFrame:
    return df.toDF(*[camel(c) for c in df.columns])


def rename_snake(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


def keys_to_camel(attributes: Column) -> Column:
    """Map keys ``a_b`` to ``aB``."""
    def convert(key):
        parts = F.split(key, "_")
        rest = F.transform(F.slice(parts, 2, F.size(parts)), F.initcap)
        return F.concat(F.get(parts, 0), F.array_join(rest, ""))

    return F.transform_keys(attributes, lambda k, _: convert(k))


def strip_keys(df: DataFrame, pattern: str = r"^$", private: bool = True) -> DataFrame:
    """Drop columns whose name matches ``pattern`` at its start, and private ones."""
    gone = [c for c in df.columns
            if re.match(pattern, c) or (private and c.startswith("__"))]
    return df.drop(*gone)


def keep_keys(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in set(wanted)])
