"""Similar documents and semantic search, for whole tables of queries at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.nearest import blocked_dot, rank_partitions
from ..session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Found:
    """A search as far as it went.

    ``kept(key, doc, rank, similarity)`` are the documents found so far, and
    ``cursor(key, visited, scored, found)`` says how many partitions a query has
    visited, how many documents they hold and how many of these were kept.
    """

    kept: DataFrame
    cursor: DataFrame


def search(queries: DataFrame, docs: DataFrame, pivots: DataFrame, n: int | Column, key: str = "query_id",
           doc: str = "doc_id", so_far: Found | None = None) -> Found:
    """Visit partitions until every query has found ``n`` documents or seen all.

    Partitions come by descending pivot similarity; a document whose similarity
    (10 decimals) came up in an earlier partition is left out.  ``n`` may be a
    column of ``queries``.  With ``so_far`` the search goes on behind the
    partitions visited, and does not score them again.

    Document counts per partition bound what is scored: the first round takes
    the partitions that hold twice ``n`` documents, every other one as many as
    were scored before.  A query needs at least ``n``, and one that is still
    short more than it has scored, so it scores at most twice what it needs,
    and the partition it ends in.  Queries leave when they have enough.  What a
    round keeps goes to the checkpoint folder; ``docs`` is read every round:
    pass a stored table.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    docs = docs.filter(F.col("vec").isNotNull()).select(doc, "partition", "vec")
    sizes = docs.groupBy("partition").agg(F.count(F.lit(1)).alias("nDocs"))
    sized = (pivots.select("partition", "vec").join(sizes, "partition", "left")
             .withColumn("nDocs", F.coalesce("nDocs", F.lit(0))).checkpoint())
    partitions = sized.count()
    wanted = (n if isinstance(n, Column) else F.lit(n)).cast("long")
    # read in every round, and often embedded from texts
    asked = queries.withColumn("__n", wanted).select(key, "vec", "__n").filter(F.col("vec").isNotNull()).checkpoint()
    kept = [] if so_far is None else [so_far.kept]
    zero = [F.lit(0).cast(kind).alias(c) for c, kind in (("visited", "int"), ("scored", "long"), ("found", "long"))]
    cursor = asked.select(key, *zero)
    if so_far is not None:
        cursor = (cursor.select(key).join(so_far.cursor, key, "left")
                  .select(key, *[F.coalesce(c, z).alias(c) for c, z in zip(so_far.cursor.columns[1:], zero)]))
    while True:
        short = asked.join(cursor, key).filter((F.col("found") < F.col("__n")) & (F.col("visited") < partitions))
        if not short.head(1):
            break
        short = short.withColumn("__upto", 2 * F.greatest("__n", "scored"))
        visits = rank_partitions(short, sized, key, budget="__upto", after="visited").select(key, "partition", "rank").checkpoint()
        scored = blocked_dot(docs, visits.join(asked.select(key, "vec"), key), ["partition"], doc, key, carry=["rank"])
        kept.append(_kept(scored, kept, key).checkpoint())
        moved = visits.join(sized.select("partition", "nDocs"), "partition").groupBy(key).agg(
            F.max("rank").alias("__rank"), F.sum("nDocs").alias("__docs"))
        more = kept[-1].groupBy(key).agg(F.count(F.lit(1)).alias("__found"))
        # the next round reads this, and only this
        cursor = (cursor.join(moved, key, "left").join(more, key, "left").select(
            key, F.coalesce("__rank", "visited").alias("visited"), (F.col("scored") + F.coalesce("__docs", F.lit(0))).alias("scored"),
            (F.col("found") + F.coalesce("__found", F.lit(0))).alias("found")).checkpoint())
    if not kept:
        nothing = asked.select(key).crossJoin(docs.select(doc)).limit(0)
        kept = [nothing.select(doc, key, F.lit(0).alias("rank"), F.lit(0.0).alias("similarity"))]
    return Found(reduce(DataFrame.unionByName, kept), cursor)


def similar_docs(queries: DataFrame, docs: DataFrame, pivots: DataFrame, n: int | Column, key: str = "query_id",
                 doc: str = "doc_id", so_far: Found | None = None) -> DataFrame:
    """Documents of the partitions closest to each query: ``(key, doc, rank, similarity)``.

    Of the partitions in the order of ``search`` those up to the one in which
    ``n`` documents were found.
    """
    found = search(queries, docs, pivots, n, key, doc, so_far)
    return visited(found, queries, n, key)


def visited(found: Found, queries: DataFrame, n: int | Column, key: str = "query_id") -> DataFrame:
    """What a search has kept in the partitions before ``n`` documents were found."""
    per_rank = found.kept.groupBy(key, "rank").agg(F.count(F.lit(1)).alias("__k"))
    before = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    per_rank = per_rank.withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0)))
    wanted = queries.select(key, (n if isinstance(n, Column) else F.lit(n)).alias("__n"))
    reached = per_rank.join(wanted, key).filter(F.col("__before") < F.col("__n")).select(key, "rank")
    return found.kept.join(reached, [key, "rank"], "left_semi")


def _kept(scored: DataFrame, before: list[DataFrame], key: str) -> DataFrame:
    """Without the documents whose similarity an earlier partition had."""
    columns, scored = scored.columns, scored.withColumn("__k", F.round("similarity", 10))
    first = scored.groupBy(key, "__k").agg(F.min("rank").alias("rank"))
    if before:
        # one row per query and similarity on either side
        seen = reduce(DataFrame.unionByName, before).select(key, F.round("similarity", 10).alias("__k")).distinct()
        first = first.join(seen, [key, "__k"], "left_anti")
    return scored.join(first, [key, "__k", "rank"], "left_semi").select(*columns)
