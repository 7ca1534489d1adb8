"""Keeping the corpus: scoring new articles, placing them, splitting partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.naming import strip_keys
from ..functions.vectors import dot
from ..operators.cluster import cluster_medoids, size_bounded_clusters
from ..operators.duplicates import flag_vector_duplicates
from ..operators.embed import score_docs
from ..operators.frontier import new_errors, requeue_invalid
from ..operators.mutate import delete_everywhere, retire_pivots, upsert_docs
from ..operators.nearest import nearest_pivot
from ..operators.ranking import global_rank
from ..operators.scan import drawn
from ..session import ensure_checkpoint_dir
from ..sources.model import WordModel


def clean_score(docs: DataFrame, model: WordModel, seq: str = "seq", mode: str = "core") -> tuple[DataFrame, DataFrame]:
    """Score the good documents; returns ``(survivors with vec, errors)``.

    Documents without a known word become ``cannotUnderstand``, later copies of
    a vector ``duplicated`` with the URL of the first.  The scored table is read
    by the comparison and by both results, so it is written once.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    if "errorCode" not in docs.columns:
        docs = docs.withColumn("errorCode", F.lit(None).cast("string"))
    docs = docs.withColumn("errorCode", F.coalesce("errorCode", F.lit("allGood")))
    good = F.col("errorCode") == "allGood"
    scored = score_docs(docs.filter(good), model, mode, key=seq).withColumn(
        "errorCode", F.when(F.col("vec").isNull(), "cannotUnderstand").otherwise("allGood")).checkpoint()
    copies = flag_vector_duplicates(scored.filter(F.col("vec").isNotNull()), seq, "URL", model.shape[1])
    marked = scored.join(copies, seq, "left").withColumn(
        "errorCode", F.when(F.col("dupliURL").isNotNull(), "duplicated").otherwise(F.col("errorCode")))
    survivors = marked.filter(good).drop("dupliURL")
    flagged = marked.filter(~good).drop("vec")
    faulty = docs.filter(~good).drop("sentences").withColumn("dupliURL", F.lit(None).cast("string"))
    return survivors, flagged.unionByName(faulty)


def map_coordinates(df: DataFrame, projection: list[tuple[float, float]]) -> DataFrame:
    """Place vectors on the map with a linear projection: one pair per dimension."""
    def axis(i: int) -> Column:
        return dot(F.col("vec"), F.array(*[F.lit(float(p[i])) for p in projection]))

    return df.withColumn("tsne", F.struct(axis(0).alias("x"), axis(1).alias("y")))


def train_map(df: DataFrame, trees: int = 20, depth: int = 8, seed: int = 0):
    """Two forests that predict the map position from the vector.

    ``df(vec, tsne struct<x, y>)`` holds known positions.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    known = df.select(array_to_vector("vec").alias("features"), F.col("tsne.x").alias("x"), F.col("tsne.y").alias("y"))
    return tuple(RandomForestRegressor(labelCol=c, predictionCol=f"__{c}", numTrees=trees, maxDepth=depth,
                                       seed=seed).fit(known) for c in ("x", "y"))


def map_with_forest(df: DataFrame, forests) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    placed = df.withColumn("features", array_to_vector("vec"))
    for forest in forests:
        placed = forest.transform(placed)
    return placed.withColumn("tsne", F.struct(F.col("__x").alias("x"), F.col("__y").alias("y"))).drop(
        "features", "__x", "__y")


@dataclass
class Corpus:
    """The tables of one corpus."""

    main: DataFrame
    newbies: DataFrame
    errors: DataFrame
    pivots: DataFrame


def assign_newbies(corpus: Corpus, batch: DataFrame, model: WordModel, projection: list[tuple[float, float]],
                   seq: str = "seq", raised: Column | None = None) -> tuple[Corpus, DataFrame]:
    """Move a batch of new articles into the corpus.

    Returns the new tables and ``(partition, added, nDocs)`` of the partitions
    touched.  ``batch`` rows come from ``corpus.newbies`` and have ``sentences``.
    """
    survivors, errors = clean_score(batch, model, seq)
    placed = map_coordinates(nearest_pivot(survivors, corpus.pivots), projection)
    # stored once: the article table, the counts and the removals below all read it
    placed = strip_keys(placed.drop("similarity"), r"^_").checkpoint()
    main, newbies, _ = delete_everywhere(errors, corpus.main, corpus.newbies, corpus.errors)
    main = upsert_docs(main, placed.select(*[c for c in placed.columns if c in main.columns]), "URL")
    newbies = newbies.join(placed.select("URL"), "URL", "left_anti")
    fresh = new_errors(errors, corpus.errors, raised)
    added = placed.groupBy("partition").agg(F.count(F.lit(1)).alias("added"))
    pivots = corpus.pivots.join(added, "partition", "left").withColumn(
        "nDocs", F.col("nDocs") + F.coalesce("added", F.lit(0)))
    touched = pivots.filter(F.col("added").isNotNull()).select("partition", "added", "nDocs")
    kept = [c for c in corpus.errors.columns if c in fresh.columns]
    all_errors = corpus.errors.unionByName(fresh.select(*kept), allowMissingColumns=True)
    return Corpus(main, newbies, all_errors, pivots.select(*corpus.pivots.columns)), touched


def split_partitions(docs: DataFrame, pivots: DataFrame, partition_size: int, dim: int, key: str = "doc_id",
                     url: str = "URL") -> tuple[DataFrame, DataFrame]:
    """Split every partition of more than twice ``partition_size`` documents.

    ``docs(key, url, partition, vec)`` are clean and scored; ``pivots`` have
    ``partition, vec, nDocs``.  New partitions get ids above all used so far and
    the document nearest to their centre as pivot; the other partitions only
    have their size refreshed.  Returns ``(docs with new partitions, pivots)``.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    sizes = docs.groupBy("partition").agg(F.count(F.lit(1)).alias("__n"))
    fat = sizes.filter(F.col("__n") > 2 * partition_size).select("partition")
    inside = docs.join(fat, "partition", "left_semi")
    clusters = size_bounded_clusters(inside, key, partition_size, dim, group="partition")
    labels = global_rank(clusters.select("cluster").distinct(), [F.col("cluster")], "__rank")
    top = pivots.agg(F.max("partition")).scalar()
    numbered = (clusters.join(labels, "cluster")
                .select(key, "vec", (F.coalesce(top, F.lit(0)) + 1 + F.col("__rank")).cast("long").alias("partition"))
                .checkpoint())
    fresh = cluster_medoids(numbered, key, "partition")
    moved = docs.join(numbered.select(key, F.col("partition").alias("__new")), key, "left").withColumn(
        "partition", F.coalesce("__new", "partition")).drop("__new")
    refreshed = (pivots.join(sizes, "partition", "left").withColumn("nDocs", F.coalesce("__n", F.lit(0)))
                 .select(*pivots.columns))
    columns = [c for c in pivots.columns if c in fresh.columns]
    if url in pivots.columns:
        fresh = fresh.join(docs.select(key, url), key)
        columns.append(url)
    return moved, retire_pivots(refreshed.select(*columns), fat, fresh.select(*columns))


def revalidate(corpus: Corpus, partitions: DataFrame, valid: Column, collection: str) -> tuple[Corpus, DataFrame]:
    """Check the documents of some partitions again: ``(tables, messages)``.

    The invalid ones leave all tables and go back to the queue of their
    collection.  ``valid`` is a predicate over the columns of the main table,
    such as ``valid_doc``.
    """
    ensure_checkpoint_dir(corpus.main.sparkSession)
    checked = corpus.main.join(partitions.select("partition").distinct(), "partition", "left_semi")
    messages = requeue_invalid(checked, valid, collection).checkpoint()
    main, newbies, errors = delete_everywhere(messages, corpus.main, corpus.newbies, corpus.errors)
    added = messages.join(corpus.main.select("URL", "partition"), "URL").groupBy("partition").agg(F.count(F.lit(1)).alias("__gone"))
    pivots = corpus.pivots.join(added, "partition", "left").withColumn("nDocs", F.col("nDocs") - F.coalesce("__gone", F.lit(0)))
    return Corpus(main, newbies, errors, pivots.select(*corpus.pivots.columns)), messages


def revalidate_sample(corpus: Corpus, n: int, seed: int, valid: Column, collection: str) -> tuple[Corpus, DataFrame]:
    """``revalidate`` of ``n`` partitions drawn by a seeded hash of their ids."""
    some = corpus.pivots.select("partition").distinct().orderBy(drawn("partition", seed), "partition").limit(n)
    return revalidate(corpus, some, valid, collection)
