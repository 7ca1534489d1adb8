"""Reading documents: pages of a table, query by example, ranges, key lookups."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Key lists up to this length go into the filter (and so into the scan).
INLINE_KEYS = 1000

# Log levels by name.
LOG_LEVELS = {"fatal": 0, "error": 1, "warning": 2, "info": 3, "debug": 4}


def page(df: DataFrame, skip: int | None = None, limit: int | None = None) -> DataFrame:
    if skip:
        df = df.offset(skip)
    return df if limit is None else df.limit(limit)


def scan_all(df: DataFrame, key: str, skip: int | None = None, limit: int | None = None) -> DataFrame:
    """All documents; a page of them is taken in key order."""
    if skip is None and limit is None:
        return df
    return page(df.orderBy(key), skip, limit)


def matches(example: Mapping[str, object]) -> Column:
    """Equality on every attribute of the example; dotted paths reach into structs."""
    tests = [F.col(name).eqNullSafe(F.lit(value)) for name, value in example.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def by_example(df: DataFrame, example: Mapping[str, object], key: str,
               skip: int | None = None, limit: int | None = None) -> DataFrame:
    return scan_all(df.filter(matches(example)), key, skip, limit)


def first_example(df: DataFrame, example: Mapping[str, object], key: str) -> DataFrame:
    return by_example(df, example, key, limit=1)


def in_range(df: DataFrame, attr: str, left, right, key: str, closed: bool = True,
             skip: int | None = None, limit: int | None = None) -> DataFrame:
    c = F.col(attr)
    hit = (c >= F.lit(left)) & ((c <= F.lit(right)) if closed else (c < F.lit(right)))
    found = df.filter(hit)
    if skip is None and limit is None:
        return found
    return page(found.orderBy(attr, key), skip, limit)


def lookup_by_keys(df: DataFrame, key: str, keys: Sequence | DataFrame) -> DataFrame:
    """Documents with the given keys.  ``keys`` is a list or a one-column table."""
    if isinstance(keys, DataFrame):
        name = keys.columns[0]
        return df.join(keys.select(F.col(name).alias(key)), key, "left_semi")
    if len(keys) <= INLINE_KEYS:
        return df.filter(F.col(key).isin(list(keys)))
    wanted = df.sparkSession.createDataFrame([(k,) for k in keys], df.select(key).schema)
    return df.join(wanted, key, "left_semi")


def conditional_get(df: DataFrame, requests: DataFrame, key: str, rev: str,
                    columns: Iterable[str]) -> DataFrame:
    """Answer requests ``(key, want_rev, match)`` with a ``status`` column.

    ``match`` true asks for exactly the given revision, false for any other.
    """
    found = df.select(F.col(key).alias("__key"), F.col(rev).alias("__rev"),
                      *[F.col(c) for c in columns])
    asked = F.col("want_rev").isNotNull()
    same = F.col("__rev") == F.col("want_rev")
    status = (F.when(F.col("__key").isNull(), "missing")
              .when(asked & (F.col("match") != same), "revision_error")
              .otherwise("ok"))
    joined = requests.join(found, requests[key] == found["__key"], "left").withColumn("status", status)
    body = [F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in columns]
    return joined.select(key, "status", *body)


def first_n(df: DataFrame, seq: str, n: int) -> DataFrame:
    return df.orderBy(F.col(seq).asc()).limit(n)


def last_n(df: DataFrame, seq: str, n: int) -> DataFrame:
    return df.orderBy(F.col(seq).desc()).limit(n)


def docs_by_url(urls: DataFrame, docs: DataFrame, fields: Sequence[str], url: str = "URL") -> DataFrame:
    """The named fields of the documents at the given URLs, one row per document; unknown URLs give none.

    An absent field is null.  The URLs are the small side, so documents stay
    where they are if Spark can broadcast them.
    """
    wanted = urls.select(F.col(urls.columns[0]).alias(url)).filter(F.col(url).isNotNull()).distinct()
    return project(docs.join(wanted, url, "left_semi"), [url, *[f for f in fields if f != url]])


def any_doc(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One document drawn by a seeded hash, the same on every rerun."""
    return df.orderBy(drawn(key, seed), key).limit(1)


def drawn(key: str, seed: int) -> Column:
    """A hash any engine can compute, to draw rows by."""
    return F.md5(F.concat(F.lit(f"{seed} "), F.col(key).cast("string")))


def project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The named fields; an absent one is null, an empty list means all."""
    if not fields:
        return df
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f)
                       for f in fields])


def random_links(df: DataFrame, n: int, key: str = "URL", seed: int = 0) -> DataFrame:
    """Links of ``n`` random articles, drawn from all that have any."""
    pool = df.filter((F.col("partition") > 0) & F.col("links").isNotNull())
    return pool.orderBy(drawn(key, seed), key).limit(n).select("links", F.col(key).alias("ref"))


def run_query(spark: SparkSession, text: str, bind: Mapping[str, object] | None = None) -> DataFrame:
    """An ad-hoc SQL query with named parameters (``:name``)."""
    return spark.sql(text, args=dict(bind or {}))


def with_full_count(matched: DataFrame, order: Sequence[str], limit: int,
                    skip: int | None = None) -> DataFrame:
    """A page of the matches, each row carrying how many there were in all.

    The count is a scalar subquery with map-side partial counts; no window ever
    holds all matches.
    """
    total = matched.agg(F.count(F.lit(1))).scalar()
    return page(matched.orderBy(*order), skip, limit).withColumn("full_count", total)


def candidate_docs(df: DataFrame, partition: int | None = None, n_sentences: int = 10) -> DataFrame:
    """Articles the search may show: long enough, titled, with their opening sentences."""
    good = df.filter((F.col("contentLength") > 500) & F.col("title").isNotNull())
    if partition is not None:
        good = good.filter(F.col("partition") == partition)
    return good.withColumn("sentences", F.slice("sentences", 1, n_sentences))


def clean_links(df: DataFrame, link: str) -> DataFrame:
    from ..functions.urls import escape_value, usable_link

    return df.filter(usable_link(F.col(link))).withColumn(link, escape_value(F.col(link)))


def union_like(tables: Mapping[str, DataFrame], pattern: str, columns: Sequence[str]) -> DataFrame:
    """The given columns of every table whose name matches, tagged with ``src``."""
    chosen = [df.select(F.lit(name).alias("src"), *[F.col(c) for c in columns])
              for name, df in sorted(tables.items()) if re.match(pattern, name)]
    if not chosen:
        raise ValueError(f"no table matches {pattern!r}")
    return reduce(DataFrame.unionByName, chosen)


def log_query(df: DataFrame, upto: str | int | None = None, level: str | int | None = None,
              start: int | None = None, size: int | None = None, offset: int | None = None,
              search: str | None = None, sort: str = "asc") -> DataFrame:
    """Entries of a log table ``(id, level, text)``."""
    if upto is not None and level is not None:
        raise ValueError("give either upto or level")

    def number(value):
        return LOG_LEVELS[value.lower()] if isinstance(value, str) else value

    if upto is not None:
        df = df.filter(F.col("level") <= number(upto))
    if level is not None:
        df = df.filter(F.col("level") == number(level))
    if start is not None:
        df = df.filter(F.col("id") >= start)
    if search:
        df = df.filter(F.contains("text", F.lit(search)))
    order = F.col("id").desc() if sort.lower() == "desc" else F.col("id").asc()
    return page(df.orderBy(order), offset, size)


def without_flagged(df: DataFrame, flag: str = "_flag", value: str = "test") -> DataFrame:
    return df.filter(~F.col(flag).eqNullSafe(F.lit(value)))


def cleanup_flagged(tables: Mapping[str, DataFrame], flag: str = "_flag",
                    value: str = "test") -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without its flagged rows, and a report of how many went."""
    counts = [df.agg(F.lit(name).alias("table"),
                     F.count_if(F.col(flag).eqNullSafe(F.lit(value))).alias("removed"))
              for name, df in sorted(tables.items())]
    return ({name: without_flagged(df, flag, value) for name, df in tables.items()},
            reduce(DataFrame.unionByName, counts))
