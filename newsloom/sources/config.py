"""Site configuration: which domains belong to which collection, and their feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CONFIG_SCHEMA = ("domain string, collection string, fields string, useForSentences string, "
                 "rssFeeds string, domainRegex string")
# The fields an extractor exists for.
EXTRACTABLE = {"URL", "refURL", "skinnyURL", "domain", "contentLength", "parsedTs", "createdTs",
               "sentences", "rssTags", "metas", "title", "body", "links", "ampLink", "canonicalLink"}


def read_site_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=CONFIG_SCHEMA)


def required_fields(config: DataFrame) -> DataFrame:
    """``(collection, field)``: every field some site of the collection asks for."""
    return (config.select("collection", F.explode(F.split("fields", ",")).alias("field"))
            .filter(F.col("field") != "").distinct())


def ambiguous_collections(config: DataFrame) -> DataFrame:
    """Collections whose sites disagree on the field sentences come from."""
    return (config.groupBy("collection").agg(F.count_distinct("useForSentences").alias("n_sources"))
            .filter(F.col("n_sources") > 1))


def explode_feeds(config: DataFrame) -> DataFrame:
    return (config.filter(F.coalesce("rssFeeds", F.lit("")) != "")
            .select("domain", F.explode(F.split("rssFeeds", ",")).alias("feed")))


def collection_settings(config: DataFrame, collection: str) -> tuple[list[str], str]:
    """Required fields and sentence source of one collection, checked.

    Of unknown fields one is fetched to be named, so no more rows come to the
    driver than there are extractors.
    """
    mine = config.filter(F.col("collection") == collection)
    if ambiguous_collections(mine).head(1):
        raise ValueError(f"several values of useForSentences for collection {collection!r}")
    wanted = required_fields(mine)
    unknown = wanted.filter(~F.col("field").isin(*EXTRACTABLE)).orderBy("field").head()
    if unknown:
        raise NotImplementedError(f"no extractor for {unknown['field']!r}")
    fields = sorted(r["field"] for r in wanted.collect())
    source = mine.select("useForSentences").head()
    if source is None:
        raise ValueError(f"no site in collection {collection!r}")
    return fields, source[0]
