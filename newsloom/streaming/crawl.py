"""The crawl: links in, articles, errors and new links out.

Every sink owns one folder per batch id and overwrites it, so a batch that is
replayed after a failure leaves no second copy.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.urls import escape_value, skinny_url, usable_link
from ..operators.frontier import missing_from_all, new_errors, route_by_regex, screen_threshold, screen_urls
from ..operators.pages import parse_pages
from ..session import drop_path, scratch_path
from ..sources.consume import consume, pending
from ..sources.queues import publish_by_key
from . import known


def admit_links(links: DataFrame, collection: str, pending: int, pending_links: int, block: int,
                model: Mapping[str, float], main: DataFrame, newbies: DataFrame, errors: DataFrame) -> DataFrame:
    """Links with the queue they go to.

    With little pending, all pass as they are.  Otherwise they are screened and
    those already known are dropped; with a lot pending they wait in line again.
    """
    if pending <= block:
        return links.withColumn("routing_key", F.lit(collection))
    threshold = screen_threshold(F.lit(pending_links), block)
    screened = screen_urls(links, "URL", model, threshold).drop("pDodgy")
    fresh = missing_from_all(screened.select("URL"), main, newbies, errors).select("URL")
    suffix = "-links" if pending > 2 * block else ""
    return screened.join(fresh, "URL", "left_semi").withColumn("routing_key", F.lit(collection + suffix))


def frontier_stream(links: DataFrame, out: str, backlog, *args, checkpoint: str | None = None, **kwargs) -> StreamingQuery:
    """Run ``admit_links`` on every micro-batch and publish to ``out``.

    ``backlog()`` returns the two pending counts at the time of the batch.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        pending, pending_links = backlog()
        publish_by_key(admit_links(batch, *args, pending=pending, pending_links=pending_links, **kwargs), out, batch_id)

    return (links.writeStream.foreachBatch(handle).trigger(availableNow=True)
            .option("checkpointLocation", checkpoint or scratch_path(links.sparkSession, "frontier-log")).start())


@dataclass
class CrawlPaths:
    """Where the crawl writes; each is a table partitioned by batch."""

    newbies: str
    errors: str
    links: str


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.partitionBy("batch_id")
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))


# Timestamps keep their microseconds on the way through the state.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def page_sightings(parsed: DataFrame, seq: str) -> DataFrame:
    """What parsed pages tell: each an article or an error, and its links.  A page is extracted once for all of them."""
    nothing = F.lit(None)
    good = F.col("errorCode") == "allGood"
    page = F.struct(F.col("URL"), F.when(good, known.ARTICLE).otherwise(known.ERROR).alias("kind"), nothing.cast("string").alias("refURL"),
                    nothing.cast("int").alias("pos"), F.xxhash64("title", "body", "createdTs").alias("version"),
                    F.to_json(F.struct(*[F.col(c) for c in parsed.columns]), JSON).alias("row"))
    links = F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda u, i: F.struct(
        u.alias("URL"), F.lit(known.LINK).alias("kind"), F.col("URL").alias("refURL"), i.alias("pos"),
        nothing.cast("long").alias("version"), nothing.cast("string").alias("row")))
    told = parsed.select(F.col(seq).cast("long").alias("seq"), F.explode(F.concat(F.array(page), links)).alias("s")).select("s.*", "seq")
    told = told.filter((F.col("kind") != known.LINK) | usable_link(F.col("URL")))
    told = told.withColumn("URL", F.when(F.col("kind") == known.LINK, escape_value(F.col("URL"))).otherwise(F.col("URL")))
    return told.select(skinny_url(F.col("URL")).alias("skinnyURL"), "URL", "kind", "refURL", "seq", "pos", "version", "row")


def _deliver(news: DataFrame, batch_id: int, paths: CrawlPaths, page: StructType, config: DataFrame, order: str, now: Column) -> None:
    """New articles, errors and links of a micro-batch to their sinks; each owns the folder of the batch."""
    spark = news.sparkSession
    store = scratch_path(spark, "sightings")
    # the state is run once for three sinks
    news.write.partitionBy("kind").parquet(store)
    told = spark.read.schema(news.schema).parquet(store)
    pages = told.filter(F.col("kind") != known.LINK).select("kind", F.from_json("row", page, JSON).alias("page"))
    _write_batch(pages.filter(F.col("kind") == known.ARTICLE).select("page.*"), paths.newbies, batch_id)
    # what was known before is left out already
    raised = new_errors(pages.filter(F.col("kind") == known.ERROR).select("page.*"),
                        spark.createDataFrame([], "skinnyURL string"), now)
    _write_batch(raised, paths.errors, batch_id)
    links = told.filter(F.col("kind") == known.LINK).select("URL", "refURL", "skinnyURL")
    routed = route_by_regex(links, "URL", config, order)
    key = F.when(F.col("collection").isNull(), "unrouted").otherwise(F.concat("collection", F.lit("-links")))
    publish_by_key(routed.select("URL", "refURL", "skinnyURL", "domain", key.alias("routing_key")), paths.links, batch_id, "crawl")
    drop_path(spark, store)


def crawl_stream(pages: DataFrame, paths: CrawlPaths, config: DataFrame, order: str, required: Sequence[str], now: Column,
                 main: DataFrame, newbies: DataFrame, errors: DataFrame, checkpoint: str, seq: str) -> StreamingQuery:
    """Extract a stream of ``pages(URL, html, seq)``; articles, errors and new links go to their sinks.

    A link goes out once, for the first page naming it by ``seq``, unless its
    page is known: stored when the stream first started, or met by the stream
    since.  An article goes out again only if its title, text or date changed;
    ``current_articles`` gives the last of each.  ``checkpoint`` holds what is
    known, so the job must be given the same one whenever it is started.
    """
    parsed = parse_pages(pages, config, order, required, now)
    news = known.first_sightings(page_sightings(parsed, seq), known.stored_sightings(main, newbies, errors))
    page = StructType([f for f in parsed.schema.fields])

    def handle(batch: DataFrame, batch_id: int) -> None:
        _deliver(batch, batch_id, paths, page, config, order, now)

    return (news.writeStream.foreachBatch(handle).trigger(availableNow=True).option("checkpointLocation", checkpoint).start())


def current_articles(spark: SparkSession, paths: CrawlPaths) -> DataFrame:
    """The last version of every article the crawl has stored."""
    stored = spark.read.parquet(paths.newbies)
    latest = stored.groupBy("URL").agg(F.max("batch_id").alias("batch_id"))
    return stored.join(latest, ["URL", "batch_id"]).drop("batch_id")


def frontier_run(spark: SparkSession, path: str, collection: str, message: StructType, block: int, model: Mapping[str, float],
                 stored: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], crawler: str = "main",
                 consumer: str = "frontier") -> None:
    """One round of the frontier: at most ``block`` links of ``<collection>-links`` to the crawl's queue, or back in line.

    Both queues are in ``path``, so links sent back are read again by later
    rounds.  How many the ``crawler`` has not acknowledged, and how many links
    wait behind those taken, comes from the ledgers; ``stored()`` gives main,
    newbies and errors as they are now.  A screened link that comes twice in a
    round goes on once.  A round that fails is repeated.
    """
    waiting = f"{collection}-links"

    def left(key: str, reader: str) -> int:
        found = pending(spark, path, reader).filter(F.col("routing_key") == key).collect()
        return found[0]["pending"] if found else 0

    def handle(batch: DataFrame, batch_id: int) -> None:
        # what this round has taken is not acknowledged yet
        behind = left(waiting, consumer) - batch.count()
        busy = left(collection, crawler)
        if busy > block:
            batch = batch.groupBy("URL").agg(F.min(F.struct(*batch.columns)).alias("m")).select("m.*")
        publish_by_key(admit_links(batch, collection, busy, behind, block, model, *stored()), path, batch_id, consumer)

    consume(spark, path, waiting, message, handle, block, consumer)
