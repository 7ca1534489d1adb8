"""Duplicates, clusters, and the jobs that keep the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import aggregate as agg, cluster, duplicates, embed
from ..plans import upkeep
from . import sql
from .base import Tables, query
from .fixtures import article_sentences, corpus, pivots, weights, word_model
from .vectors import CORE_SQL, MEAN_SQL, PIVOTS_SQL

DIM = 64
PARTITION_SIZE = 50
PROJECTION = [((i % 7 - 3) / 10, (i % 5 - 2) / 10) for i in range(DIM)]


def dupes_sql(vectors_table: str, out: str) -> str:
    return f"""{out} AS MATERIALIZED (SELECT b.doc_id, min(a.doc_id) AS orig FROM {vectors_table} a JOIN {vectors_table} b
  ON a.doc_id < b.doc_id AND round(list_dot_product(a.vec, b.vec), 12) = 1 GROUP BY b.doc_id)"""


def url_of(doc: str = "doc_id"):
    return F.concat(F.lit("http://news.example.com/"), F.col(doc).cast("string"))


def articles(t: Tables):
    """New articles; those of one source came with an error."""
    docs = article_sentences(t).withColumn("URL", url_of()).withColumn("skinnyURL", url_of())
    bad = t.documents.filter("source = 'src3'").select("doc_id", F.lit("parsingError").alias("errorCode"))
    return docs.drop("n_chars", "title").join(bad, "doc_id", "left")


@query("vector_duplicates", f"""WITH {MEAN_SQL}, {dupes_sql('dv', 'dup')}
SELECT doc_id, 'http://news.example.com/' || orig AS "dupliURL" FROM dup""")
def vector_duplicates(t: Tables):
    docs = embed.score_docs(article_sentences(t).select("doc_id", "sentences"), word_model(t), "mean", key="doc_id")
    docs = docs.filter(F.col("vec").isNotNull()).withColumn("URL", url_of()).checkpoint()
    return duplicates.flag_vector_duplicates(docs, "doc_id", "URL", DIM)


CLEAN_SQL = f"""{CORE_SQL}, good AS MATERIALIZED (SELECT doc_id FROM documents WHERE source <> 'src3'),
gv AS MATERIALIZED (SELECT doc_id, vec FROM cv JOIN good USING (doc_id)), {dupes_sql('gv', 'dup')},
judged AS MATERIALIZED (SELECT doc_id, CASE WHEN source = 'src3' THEN 'parsingError' WHEN gv.vec IS NULL THEN 'cannotUnderstand'
  WHEN orig IS NOT NULL THEN 'duplicated' ELSE 'allGood' END AS code, orig, gv.vec
  FROM documents LEFT JOIN gv USING (doc_id) LEFT JOIN dup USING (doc_id))"""


@query("clean_score", f"""WITH {CLEAN_SQL}
SELECT doc_id, code AS "errorCode", 'http://news.example.com/' || orig AS "dupliURL" FROM judged""")
def clean_score(t: Tables):
    survivors, errors = upkeep.clean_score(articles(t), word_model(t), seq="doc_id")
    good = survivors.select("doc_id", "errorCode", F.lit(None).cast("string").alias("dupliURL"))
    return good.unionByName(errors.select("doc_id", "errorCode", "dupliURL"))


def empty_corpus(t: Tables, batch):
    def none(ddl):
        return t.spark.createDataFrame([], ddl)

    main = none("URL string, doc_id long, partition long, tsne struct<x: double, y: double>")
    errors = none("URL string, skinnyURL string, errorCode string, dupliURL string, raisedTs timestamp")
    return upkeep.Corpus(main, batch.select("URL", "doc_id"), errors, pivots(t))


@query("assign_newbies", f"""WITH {CLEAN_SQL}, {PIVOTS_SQL},
pl AS (SELECT doc_id, arg_max(partition, (list_dot_product(j.vec, p.vec), -partition)) AS partition FROM judged j, pivots p
  WHERE code = 'allGood' GROUP BY doc_id)
SELECT partition::BIGINT AS partition, count(*) AS added, any_value(p."nDocs") + count(*) AS "nDocs" FROM pl JOIN pivots p USING (partition) GROUP BY 1
UNION ALL SELECT -1, count(*) FILTER (code <> 'allGood'), count(*) FILTER (code = 'allGood') FROM judged""")
def assign_newbies(t: Tables):
    """Touched partitions, and a row -1 with the number of errors and stored articles."""
    batch = articles(t)
    after, touched = upkeep.assign_newbies(empty_corpus(t, batch), batch, word_model(t), PROJECTION, seq="doc_id")
    totals = after.main.agg(F.lit(-1).cast("long").alias("partition"), F.count(F.lit(1)).alias("nDocs"))
    totals = totals.withColumn("added", after.errors.agg(F.count(F.lit(1))).scalar())
    return touched.unionByName(totals.select("partition", "added", "nDocs"))


@query("size_bounded_clusters", f"""SELECT count(*) AS n_rows, count(*) AS n_vectors, true AS within_size FROM embeddings""")
def size_bounded_clusters(t: Tables):
    """Every vector in one cluster, and no cluster above the size."""
    rows = weights(t)
    found = cluster.size_bounded_clusters(rows, "idx", PARTITION_SIZE, DIM)
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("d"))
    return sizes.agg(F.sum("n").alias("n_rows"), F.sum("d").alias("n_vectors"),
                     (F.max("n") <= PARTITION_SIZE).alias("within_size"))


# two-means from the row of lowest id and the one furthest from it, until the centres stand; a border at the median if it is uneven
D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
TWO_MEANS_SQL = f"""RECURSIVE e AS MATERIALIZED (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
s0 AS (SELECT arg_min(vec, idx) AS c FROM e), s1 AS (SELECT arg_min(vec, (-{D2.format('vec', 'c')}, idx)) AS c FROM e, s0),
it AS (SELECT 0 AS k, s0.c AS c0, s1.c AS c1, 1.0::DOUBLE AS shift FROM s0, s1
  UNION ALL SELECT k + 1, n0, n1, greatest({D2.format('n0', 'c0')}, {D2.format('n1', 'c1')}) / {D2.format('n0', 'n1')} FROM
  (SELECT k, c0, c1, coalesce(list(m ORDER BY d) FILTER (WHERE side = 0), c0) AS n0, coalesce(list(m ORDER BY d) FILTER (WHERE side = 1), c1) AS n1
   FROM (SELECT k, c0, c1, side, d, avg(vec[d]) AS m FROM (SELECT it.*, vec, ({D2.format('vec', 'c1')} < {D2.format('vec', 'c0')})::INT AS side FROM it, e WHERE shift > 1e-12),
     generate_series(1, 64) AS g(d) GROUP BY ALL) GROUP BY k, c0, c1)),
fin AS (SELECT arg_max(c0, k) AS c0, arg_max(c1, k) AS c1 FROM it),
mg AS MATERIALIZED (SELECT idx, {D2.format('vec', 'c0')} - {D2.format('vec', 'c1')} AS m FROM e, fin),
sh AS (SELECT avg((m > 0)::INT) AS share, count(*) AS n FROM mg)"""


@query("two_means_sides", f"""WITH {TWO_MEANS_SQL}
SELECT idx, CASE WHEN share BETWEEN 0.1 AND 0.9 THEN m > 0 ELSE row_number() OVER (ORDER BY m, idx) > n // 2 END AS second FROM mg, sh""")
def two_means_sides(t: Tables):
    """The side of every vector at the first split."""
    found = cluster.size_bounded_clusters(weights(t), "idx", 1, DIM, levels=1)
    return found.select("idx", (F.col("cluster") == ":1").alias("second"))


@query("medoids", f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
c AS (SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(vec[d]) AS m FROM e, unnest(generate_series(1, 64)) AS u(d) GROUP BY ALL) GROUP BY label),
x AS (SELECT c.label, vec_id, list_sum(list_transform(list_zip(c, vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM c, e)
SELECT label, arg_min(vec_id, (round(d2, 12), vec_id)) AS vec_id, {sql.r6('min(d2)')} AS distance2 FROM x GROUP BY label""")
def medoids(t: Tables):
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    centres = cluster.centres_of(rows, "label")
    found = cluster.medoids(rows, centres, "vec_id", "label")
    return found.select("label", "vec_id", vectors.round6(F.col("distance2")).alias("distance2"))


@query("split_partition", """SELECT count(*) AS n_docs, count(*) AS counted, true AS within_size, true AS fresh_ids, true AS pivot_inside
FROM embeddings""")
def split_partition(t: Tables):
    """After splitting: nothing lost, sizes kept, ids new, pivots in their own partition."""
    docs = t.embeddings.select("vec_id", F.col("label").cast("long").alias("partition"), url_of("vec_id").alias("URL"),
                               F.col("embedding").cast("array<double>").alias("vec"))
    piv = pivots(t).withColumn("URL", F.concat(F.lit("old-"), F.col("partition").cast("string")))
    size = 20
    moved, new_pivots = upkeep.split_partitions(docs, piv, size, DIM, key="vec_id")
    moved = moved.checkpoint()
    sizes = moved.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    joined = new_pivots.join(sizes, "partition", "full_outer")
    # a partition kept its id only if it was small enough to stay whole
    ids = (F.col("partition") > 9) | (F.col("n") <= 2 * size)
    home = new_pivots.filter(F.col("partition") > 9).join(
        moved.select("URL", F.col("partition").alias("home")), "URL").filter(F.col("home") == F.col("partition"))
    report = joined.agg(F.sum("n").alias("n_docs"), F.sum("nDocs").alias("counted"),
                        F.bool_and((F.col("n") <= size) | (F.col("partition") <= 9)).alias("within_size"),
                        F.bool_and(ids).alias("fresh_ids"), F.count_if(F.col("partition") > 9).alias("new"))
    return report.withColumn("pivot_inside", F.col("new") == home.agg(F.count(F.lit(1))).scalar()).drop("new")


@query("map_coordinates", f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)
SELECT vec_id, {sql.r6('list_sum(list_transform(vec, lambda v, i: v * ((i - 1) % 7 - 3) / 10))')} AS x,
  {sql.r6('list_sum(list_transform(vec, lambda v, i: v * ((i - 1) % 5 - 2) / 10))')} AS y FROM e""")
def map_coordinates(t: Tables):
    placed = upkeep.map_coordinates(weights(t).withColumnRenamed("idx", "vec_id"), PROJECTION)
    return placed.select("vec_id", vectors.round6(F.col("tsne.x")).alias("x"), vectors.round6(F.col("tsne.y")).alias("y"))


@query("map_coordinates_forest")
def map_coordinates_forest(t: Tables):
    """Forests trained on the linear map predict it back."""
    known = upkeep.map_coordinates(weights(t).withColumnRenamed("idx", "vec_id"), PROJECTION)
    forests = upkeep.train_map(known, trees=10, depth=5)
    placed = upkeep.map_with_forest(known.drop("tsne"), forests)
    return placed.select("vec_id", F.col("tsne.x").alias("x"), F.col("tsne.y").alias("y"))
