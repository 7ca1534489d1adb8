"""Feed entries from JSON files, as a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import entry_ref_ts
from ..functions.urls import entry_url

ENTRY_SCHEMA = (
    "link string, feedburner_origlink string, title string, published string, updated string, "
    "published_parsed timestamp, updated_parsed timestamp, summary_detail struct<value:string>, "
    "tags array<struct<term:string>>, title_detail struct<base:string>")


def read_feed_entries(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of entries; a micro-batch takes at most ``files_per_batch`` files."""
    return (spark.readStream.schema(ENTRY_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path))


def has_link(df: DataFrame):
    return F.coalesce(df["feedburner_origlink"], df["link"]).isNotNull()


def valid_entries(entries: DataFrame) -> DataFrame:
    return entries.filter(has_link(entries))


def malformed_count(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_if(~has_link(entries)).alias("malformed"))


def entry_fields(entries: DataFrame) -> DataFrame:
    """URL, reference URL, tags and time of every entry."""
    return entries.select(
        entry_url(F.col("feedburner_origlink"), F.col("link")).alias("URL"),
        F.col("title_detail.base").alias("refURL"), "title",
        feed_tags(F.col("tags")).alias("rssTags"),
        entry_ref_ts(F.col("updated_parsed"), F.col("updated"), F.col("published_parsed"),
                     F.col("published")).alias("refTs"))


def feed_tags(tags):
    """The terms of the tags that have one."""
    return F.filter(F.transform(tags, lambda t: t["term"]), lambda term: term.isNotNull())
