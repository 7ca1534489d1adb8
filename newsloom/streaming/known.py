"""Which pages are known, as keyed state.

Everything a stream learns about a page is a sighting of its address: the page
turned out to be faulty, it was stored as an article, or a link to it was found.
State is kept by the skinny address, so a link meets what is known about it
without a scan of the stored tables.  These are the state's first rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import skinny_url

# Addresses that share a skinny one are kept in so many places.
PLACES = 8
ERROR, ARTICLE, LINK = "error", "article", "link"
# What a sighting has besides its kind: who named the link, in which order, and the row it came with as JSON.
SIGHTING = "skinnyURL string, URL string, kind string, refURL string, seq long, pos int, version long, row string"
# Links a task remembers to have sent on.
REMEMBERED = 200_000


def stored_sightings(main: DataFrame, newbies: DataFrame, errors: DataFrame) -> DataFrame:
    """The stored tables as ``(skinnyURL, URL, kind)``; ``errors`` needs its skinny addresses only."""
    pages = main.select("URL").union(newbies.select("URL")).filter("URL IS NOT NULL")
    return (pages.select(skinny_url(F.col("URL")).alias("skinnyURL"), "URL", F.lit(ARTICLE).alias("kind"))
            .unionByName(errors.select("skinnyURL", F.lit(None).cast("string").alias("URL"), F.lit(ERROR).alias("kind")))
            .filter("skinnyURL IS NOT NULL"))


def _placed(sightings: DataFrame) -> DataFrame:
    """With the place of state that keeps them; an error is known in all places of its skinny address."""
    own = F.array(F.pmod(F.xxhash64("URL"), F.lit(PLACES)).cast("int"))
    everywhere = F.sequence(F.lit(0), F.lit(PLACES - 1))
    return sightings.withColumn("place", F.explode(F.when(F.col("kind") == ERROR, everywhere).otherwise(own)))


def _first_links(sightings: DataFrame) -> DataFrame:
    """Without links a task has sent on already, so a link that every page carries is no hot key.

    Tasks remember a bounded number of links; the state sorts out the rest.
    Rows come in the order of the input, and of two rows with one link the
    earlier one by ``seq`` and ``pos`` stays, if both are in one batch of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple] = {}
        for batch in batches:
            kinds, urls = batch.column("kind").to_pylist(), batch.column("URL").to_pylist()
            order = list(zip(batch.column("seq").to_pylist(), batch.column("pos").to_pylist()))
            here: dict[str, int] = {}
            for i, url in enumerate(urls):
                if kinds[i] == LINK and (url not in here or order[i] < order[here[url]]):
                    here[url] = i
            kept = []
            for i, url in enumerate(urls):
                if kinds[i] != LINK:
                    kept.append(i)
                elif here[url] == i and (url not in best or order[i] < best[url]):
                    if len(best) < REMEMBERED or url in best:
                        best[url] = order[i]
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return sightings.mapInArrow(run, sightings.schema)


def _order(r: Row) -> tuple[int, int]:
    return r["seq"] or 0, r["pos"] or 0


class KnownPages(StatefulProcessor):
    """Lets a sighting pass the first time: a link if nothing is known of it, an article if it changed, an error once.

    Pages of one micro-batch that are faulty under the same skinny address pass together.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.faulty = handle.getValueState("faulty", "since boolean")
        # of an article the version last stored; a link is known without one
        self.urls = handle.getMapState("urls", "url string", "version long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if initialState["kind"] == ERROR:
            self.faulty.update((True,))
        else:
            self.urls.updateValue((initialState["URL"],), (None,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        skinny, place = key
        errors, articles, links = [], {}, {}
        for r in rows:
            if r["kind"] == ERROR:
                errors.append(r)
            else:
                known, better = (articles, max) if r["kind"] == ARTICLE else (links, min)
                old = known.get(r["URL"])
                known[r["URL"]] = r if old is None else better(old, r, key=_order)
        # what became of pages counts before links to them
        if errors and not self.faulty.exists():
            self.faulty.update((True,))
            if place == 0:
                yield from {r["URL"]: r for r in sorted(errors, key=_order)}.values()
        for url, r in sorted(articles.items()):
            if not self.urls.containsKey((url,)) or self.urls.getValue((url,))[0] != r["version"]:
                self.urls.updateValue((url,), (r["version"],))
                yield r
        if links and not self.faulty.exists():
            for url, r in sorted(links.items()):
                if not self.urls.containsKey((url,)):
                    self.urls.updateValue((url,), (None,))
                    yield r

    def close(self) -> None:
        pass


def first_sightings(sightings: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of a stream of SIGHTING rows that say something new.

    ``stored`` is what is known when the stream first starts; later starts go
    on from the checkpoint.  Within a micro-batch errors and articles count
    before links, and of several rows the first by ``(seq, pos)`` passes for a
    link, the last for an article.  Rows without an address are dropped.
    """
    keyed = _placed(_first_links(sightings.filter("URL IS NOT NULL AND skinnyURL IS NOT NULL")))
    first = _placed(stored).groupBy("skinnyURL", "place")
    return keyed.groupBy("skinnyURL", "place").transformWithState(
        KnownPages(), outputStructType=keyed.schema, outputMode="Append", timeMode="None", initialState=first).drop("place")
