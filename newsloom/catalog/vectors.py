"""Vectors of sentences and documents, pivots and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import aggregate as agg, embed, nearest
from . import sql
from .base import Tables, query
from .fixtures import article_sentences, corpus, pivots, weights, word_model
from .text import SENTENCES_SQL

DIMS = "generate_series(1, 64)"

VOCAB_SQL = f"""vocab AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS idx FROM
  (SELECT word, count(*) AS n FROM (SELECT unnest({sql.words('tokens')}) AS word FROM k)
   WHERE regexp_matches(word, '[A-Za-z]') GROUP BY 1)
  QUALIFY idx < (SELECT count(*) FROM embeddings)),
wv AS MATERIALIZED (SELECT vocab.idx, word, CAST(embedding AS DOUBLE[]) AS vec FROM vocab JOIN embeddings ON vec_id = idx),
wd AS MATERIALIZED (SELECT word, d, vec[d] AS v FROM wv, unnest({DIMS}) AS u(d))"""


def sentence_dims(source: str, key: str, out: str) -> str:
    """``out(key, sent, d, v)``: unit sentence vectors of ``source(key, sentences)``, zeros left out."""
    return f"""{out}_w AS MATERIALIZED (SELECT {key}, sent, word, count(*) AS c FROM
  (SELECT {key}, sent, unnest({sql.words('sentence')}) AS word FROM
    (SELECT {key}, unnest(generate_series(0, len(sentences) - 1)) AS sent, unnest(sentences) AS sentence FROM {source}))
  WHERE word IN (SELECT word FROM vocab) GROUP BY ALL),
{out}_r AS (SELECT {key}, sent, d, sum(c * v) AS v FROM {out}_w JOIN wd USING (word) GROUP BY ALL),
{out} AS MATERIALIZED (SELECT {key}, sent, d, v / sqrt(sum(v * v) OVER (PARTITION BY {key}, sent)) AS v FROM {out}_r)"""


def mean_vectors(dims: str, key: str, out: str) -> str:
    """``out(key, vec)``: unit mean vectors as lists."""
    return f"""{out}_s AS (SELECT {key}, d, sum(v) AS v FROM {dims} GROUP BY ALL),
{out} AS MATERIALIZED (SELECT {key}, list(v / n ORDER BY d) AS vec FROM
  (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS n FROM {out}_s) WHERE n > 0 GROUP BY {key})"""


def core_vectors(source: str, dims: str, key: str, out: str) -> str:
    """``out(key, vec)``: unit mean of the core sentences."""
    return f"""{out}_n AS MATERIALIZED (SELECT {key}, len(sentences) AS n FROM {source}),
{out}_z AS MATERIALIZED (SELECT {key}, sent, u.d, coalesce(x.v, 0.0) AS v FROM
  (SELECT {key}, unnest(generate_series(0, n - 1)) AS sent FROM {out}_n) g CROSS JOIN (SELECT unnest({DIMS}) AS d) u
  LEFT JOIN {dims} x USING ({key}, sent, d)),
{out}_a AS (SELECT {key}, d, avg(v) AS a, stddev_pop(v) AS sd FROM {out}_z GROUP BY ALL),
{out}_k AS (SELECT {key}, sent, sum(v * a) AS num, avg(CASE WHEN sd < 1e-12 THEN 0 ELSE abs(v - a) / sd END) AS den
  FROM {out}_z JOIN {out}_a USING ({key}, d) GROUP BY ALL),
{out}_t AS (SELECT {key}, sent, n FROM (SELECT {key}, sent, n, row_number() OVER (PARTITION BY {key}
  ORDER BY round(CASE WHEN den = 0 THEN num ELSE num / den END, 9) DESC, sent) AS rn FROM {out}_k JOIN {out}_n USING ({key}))
  WHERE rn <= greatest(1, round_even(n / 2.0, 0))),
{out}_m AS (SELECT {key}, d, sum(v) AS v FROM {out}_z JOIN {out}_t USING ({key}, sent) GROUP BY ALL),
{out} AS MATERIALIZED (SELECT {key}, list(v / nn ORDER BY d) AS vec FROM
  (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS nn FROM {out}_m) WHERE nn > 0 GROUP BY {key})"""


def fingerprint(v: str) -> str:
    return sql.r6(f"list_sum(list_transform({v}, lambda x, i: x * i))")


PIVOTS_SQL = """pivots AS MATERIALIZED (SELECT label AS partition, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS vec,
  count(*) AS "nDocs" FROM embeddings GROUP BY label)"""
MODEL_SQL = f"{SENTENCES_SQL}, {VOCAB_SQL}"
SENTDIMS_SQL = f"{MODEL_SQL}, {sentence_dims('s', 'doc_id', 'sd')}"
MEAN_SQL = f"{SENTDIMS_SQL}, {mean_vectors('sd', 'doc_id', 'dv')}"
CORE_SQL = f"{SENTDIMS_SQL}, {core_vectors('s', 'sd', 'doc_id', 'cv')}"
CORPUS_SQL = f"""{MEAN_SQL}, {PIVOTS_SQL},
corpus AS MATERIALIZED (SELECT doc_id, any_value(v.vec) AS vec, arg_max(partition, (list_dot_product(v.vec, p.vec), -partition)) AS partition
  FROM dv v, pivots p GROUP BY doc_id)"""


@query("known_words", f"""WITH {MODEL_SQL}, w AS (SELECT doc_id, unnest({sql.words('sentence')}) AS word FROM (SELECT doc_id, unnest(sentences) AS sentence FROM s))
SELECT doc_id, count(*) AS n_known, CAST(sum(idx) AS BIGINT) AS idx_sum FROM w JOIN vocab USING (word) GROUP BY 1""")
def known_words(t: Tables):
    """Known words of every sentence of the whole text."""
    sentences = article_sentences(t).select("doc_id", F.explode("sentences").alias("text"))
    known = embed.known_words(sentences, word_model(t), "doc_id", "text")
    return known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_known"), F.sum("idx").alias("idx_sum"))


@query("sentence_vectors", f"""WITH {SENTDIMS_SQL}
SELECT doc_id, sent::INT AS pos, {sql.r6('sum(v * d)')} AS fingerprint FROM sd GROUP BY ALL""")
def sentence_vectors(t: Tables):
    v = embed.sentence_vectors(article_sentences(t).select("doc_id", "sentences"), word_model(t))
    return (v.filter(F.exists("vec", lambda x: x != 0))
            .select("doc_id", "pos", vectors.fingerprint(F.col("vec")).alias("fingerprint")))


@query("doc_vectors_mean", f"""WITH {MEAN_SQL}
SELECT doc_id, {fingerprint('vec')} AS fingerprint FROM s LEFT JOIN dv USING (doc_id)""")
def doc_vectors_mean(t: Tables):
    scored = embed.score_docs(article_sentences(t).select("doc_id", "sentences"), word_model(t), "mean")
    return scored.select("doc_id", vectors.fingerprint(F.col("vec")).alias("fingerprint"))


@query("doc_vectors_core", f"""WITH {CORE_SQL}
SELECT doc_id, {fingerprint('vec')} AS fingerprint FROM s LEFT JOIN cv USING (doc_id)""")
def doc_vectors_core(t: Tables):
    scored = embed.score_docs(article_sentences(t).select("doc_id", "sentences"), word_model(t), "core")
    return scored.select("doc_id", vectors.fingerprint(F.col("vec")).alias("fingerprint"))


@query("score_batch", f"""WITH {SENTDIMS_SQL}, {mean_vectors('sd', 'doc_id', 'dv')}, {core_vectors('s', 'sd', 'doc_id', 'cv')}
SELECT doc_id, {sql.r6('list_dot_product(dv.vec, cv.vec)')} AS agreement FROM s LEFT JOIN dv USING (doc_id) LEFT JOIN cv USING (doc_id)""")
def score_batch(t: Tables):
    """Mean and core vector of a document, by their similarity."""
    model = word_model(t)
    docs = article_sentences(t).select("doc_id", "sentences")
    both = embed.score_docs(docs.withColumn("again", F.col("sentences")), model, "mean").withColumnRenamed("vec", "mean")
    both = embed.score_docs(both, model, "core", sentences="again")
    return both.select("doc_id", vectors.round6(vectors.dot(F.col("mean"), F.col("vec"))).alias("agreement"))


@query("unit_dot", f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)
SELECT vec_id, {sql.r6('sqrt(list_dot_product(vec, vec))')} AS norm,
  {sql.r6('list_dot_product(list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))), list_reverse(vec))')} AS mirrored FROM v""")
def unit_dot(t: Tables):
    v = F.col("vec")
    return weights(t).select(F.col("idx").alias("vec_id"), vectors.round6(vectors.norm(v)).alias("norm"),
                             vectors.round6(vectors.dot(vectors.unit(v), F.reverse(v))).alias("mirrored"))


@query("nearest_pivot", f"""WITH {PIVOTS_SQL}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)
SELECT vec_id, CAST(arg_max(partition, (list_dot_product(v.vec, p.vec), -partition)) AS BIGINT) AS partition,
  {sql.r6('max(list_dot_product(v.vec, p.vec))')} AS similarity FROM v, pivots p GROUP BY vec_id""")
def nearest_pivot(t: Tables):
    rows = weights(t).withColumnRenamed("idx", "vec_id")
    near = nearest.nearest_pivot(rows, pivots(t))
    return near.select("vec_id", "partition", vectors.round6(F.col("similarity")).alias("similarity"))


@query("rank_partitions", f"""WITH {PIVOTS_SQL}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)
SELECT vec_id, partition::BIGINT AS partition, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(v.vec, p.vec) DESC,
  partition DESC)::INT AS rank FROM v, pivots p""")
def rank_partitions(t: Tables):
    return nearest.rank_partitions(weights(t).withColumnRenamed("idx", "vec_id"), pivots(t), "vec_id").drop("similarity")


@query("count_by_partition", "SELECT label::BIGINT AS partition, count(*) AS n FROM embeddings GROUP BY 1")
def count_by_partition(t: Tables):
    return agg.count_by(t.embeddings.select(F.col("label").cast("long").alias("partition")), "partition")


# stored counts of pivots, wrong for every label below five
STALE_SQL = """stale AS (SELECT label AS partition, count(*) + CASE WHEN label < 5 THEN label ELSE 0 END AS "nDocs"
  FROM embeddings GROUP BY label)"""


def stale_pivots(t: Tables):
    wrong = F.when(F.col("partition") < 5, F.col("partition")).otherwise(0)
    return pivots(t).withColumn("nDocs", F.col("nDocs") + wrong)


def labelled(t: Tables):
    return t.embeddings.select("vec_id", F.col("label").cast("long").alias("partition"))


@query("pivot_drift", f"""WITH {STALE_SQL}, a AS (SELECT label AS partition, count(*) AS actual FROM embeddings GROUP BY 1)
SELECT count(*) AS n_pivots, count(*) FILTER ("nDocs" <> actual) AS n_off,
  {sql.r6('count(*) FILTER ("nDocs" <> actual) / count(*)::DOUBLE')} AS pct_off,
  {sql.r6('avg(abs("nDocs" - actual) / actual::DOUBLE) FILTER ("nDocs" <> actual)')} AS mean_err FROM stale JOIN a USING (partition)""")
def pivot_drift(t: Tables):
    report = agg.pivot_drift(stale_pivots(t), labelled(t))[1]
    return report.select("n_pivots", "n_off", vectors.round6(F.col("pct_off")).alias("pct_off"),
                         vectors.round6(F.col("mean_err")).alias("mean_err"))


@query("partition_increments", f"""WITH {CORPUS_SQL}
SELECT partition::BIGINT AS partition, count(*) AS added, any_value(p."nDocs") + count(*) AS "nDocs"
FROM corpus JOIN pivots p USING (partition) GROUP BY partition""")
def partition_increments(t: Tables):
    return agg.partition_increments(pivots(t), corpus(t, word_model(t)))


@query("oversize_partitions", f"""WITH {CORPUS_SQL}
SELECT partition::BIGINT AS partition, count(*) AS "nDocs" FROM corpus GROUP BY partition HAVING count(*) > 100""")
def oversize_partitions(t: Tables):
    counts = corpus(t, word_model(t)).groupBy("partition").agg(F.count(F.lit(1)).alias("nDocs"))
    return agg.oversize_partitions(counts, 50)
