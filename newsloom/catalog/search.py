"""Similar-document and semantic search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import embed, scan
from ..operators.nearest import nearest_pivot
from ..plans import search
from . import sql
from .base import Tables, query
from .fixtures import article_sentences, pivots, word_model
from .vectors import CORPUS_SQL, MODEL_SQL, PIVOTS_SQL, fingerprint, mean_vectors, sentence_dims

QUERY_SENTENCES_SQL = f"qs AS MATERIALIZED (SELECT item_id, {sql.sentences(sql.tokenise('text'))} AS sentences FROM benchmark)"
QUERY_SQL = f"{QUERY_SENTENCES_SQL}, {sentence_dims('qs', 'item_id', 'qd')}, {mean_vectors('qd', 'item_id', 'qv')}"
N_DOCS = 100

# candidates: long articles with a title, by their first ten sentences; their partition is the corpus' own
CANDIDATES_SQL = f"""{CORPUS_SQL}, {QUERY_SQL},
cs AS MATERIALIZED (SELECT doc_id, partition, s.sentences[1:10] AS sentences FROM corpus JOIN s USING (doc_id)
  JOIN documents USING (doc_id) WHERE n_chars > 500 AND split_part(text, chr(10), 1) IS NOT NULL),
{sentence_dims('cs', 'doc_id', 'cd')}, {mean_vectors('cd', 'doc_id', 'cm')}"""

SIMILAR_SQL = f"""{CANDIDATES_SQL},
rk AS MATERIALIZED (SELECT item_id, partition, row_number() OVER (PARTITION BY item_id ORDER BY list_dot_product(q.vec, p.vec) DESC, partition DESC) AS r
  FROM qv q, pivots p),
sc AS MATERIALIZED (SELECT item_id, doc_id, r, list_dot_product(cm.vec, q.vec) AS sim FROM qv q JOIN rk USING (item_id)
  JOIN cs USING (partition) JOIN cm USING (doc_id)),
kp AS MATERIALIZED (SELECT * FROM sc QUALIFY min(r) OVER (PARTITION BY item_id, round(sim, 10)) = r),
pr AS MATERIALIZED (SELECT item_id, r, coalesce(sum(n) OVER (PARTITION BY item_id ORDER BY r
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT item_id, r, count(*) AS n FROM kp GROUP BY ALL)),
found AS MATERIALIZED (SELECT item_id, doc_id, r, sim FROM kp JOIN pr USING (item_id, r) WHERE before < {N_DOCS})"""


def candidates(t: Tables, model):
    """Articles in their partitions, with the vector of their opening sentences."""
    docs = article_sentences(t).withColumnRenamed("n_chars", "contentLength")
    whole = embed.score_docs(docs.withColumn("all", F.col("sentences")), model, "mean", sentences="all", key="doc_id")
    placed = nearest_pivot(whole.filter(F.col("vec").isNotNull()), pivots(t)).drop("vec", "similarity")
    scored = embed.score_docs(scan.candidate_docs(placed), model, "mean", key="doc_id")
    # stands for the stored corpus: computed once, read by every pass
    return scored.select("doc_id", "title", "partition", "vec").checkpoint()


def query_vectors(t: Tables, model):
    return embed.embed_text(t.benchmark, model, "item_id")


@query("candidate_docs", f"""WITH {CANDIDATES_SQL}
SELECT partition::BIGINT AS partition, count(*) AS n, CAST(sum(len(sentences)) AS BIGINT) AS n_sentences FROM cs GROUP BY 1""")
def candidate_docs(t: Tables):
    docs = article_sentences(t).withColumnRenamed("n_chars", "contentLength")
    whole = embed.score_docs(docs.withColumn("all", F.col("sentences")), word_model(t), "mean", sentences="all")
    placed = nearest_pivot(whole.filter(F.col("vec").isNotNull()), pivots(t))
    return scan.candidate_docs(placed).groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("sentences")).alias("n_sentences"))


@query("embed_text", f"""WITH {MODEL_SQL}, {QUERY_SQL}
SELECT item_id, {fingerprint('vec')} AS fingerprint, CASE WHEN vec IS NULL THEN 'Cannot understand text' END AS error
FROM benchmark LEFT JOIN qv USING (item_id)""")
def embed_text(t: Tables):
    return query_vectors(t, word_model(t)).select(
        "item_id", vectors.fingerprint(F.col("vec")).alias("fingerprint"), "error")


@query("similar_docs", f"""WITH {SIMILAR_SQL}
SELECT item_id, doc_id, r::INT AS rank, {sql.r6('sim')} AS similarity FROM found""")
def similar_docs(t: Tables):
    model = word_model(t)
    found = search.similar_docs(query_vectors(t, model), candidates(t, model), pivots(t), N_DOCS, key="item_id")
    return found.select("item_id", "doc_id", "rank", vectors.round6(F.col("similarity")).alias("similarity"))


# a page of each query's own size, and then more of it
FIRST, MORE = "10 + item_id % 7 * 20", 60


@query("similar_docs_more", f"""WITH {SIMILAR_SQL.replace(f'before < {N_DOCS}', f'before < {FIRST} + {MORE}')}
SELECT item_id, doc_id, r::INT AS rank, {sql.r6('sim')} AS similarity FROM found""")
def similar_docs_more(t: Tables):
    model = word_model(t)
    asked, docs, near = query_vectors(t, model), candidates(t, model), pivots(t)
    page = search.search(asked, docs, near, F.expr(FIRST), key="item_id")
    found = search.similar_docs(asked, docs, near, F.expr(f"{FIRST} + {MORE}"), key="item_id", so_far=page)
    return found.select("item_id", "doc_id", "rank", vectors.round6(F.col("similarity")).alias("similarity"))


PAIRS_SQL = """pairs AS MATERIALIZED (SELECT a.idx // 2 AS pair, a.word AS a, b.word AS b,
  list_transform(list_zip(b.vec, a.vec), lambda x: x[1] - x[2]) AS shift
  FROM wv a JOIN wv b ON b.idx = a.idx + 1 WHERE a.idx % 2 = 0)"""

PHRASE_SQL = f"""{QUERY_SQL}, {PAIRS_SQL},
ph AS MATERIALIZED (SELECT item_id, word, idx FROM (SELECT item_id, unnest({sql.words('sentences[1]')}) AS word FROM qs) JOIN vocab USING (word)),
fw AS MATERIALIZED (SELECT word, vec FROM wv WHERE word IN (SELECT word FROM ph)),
mv AS MATERIALIZED (SELECT word, pair, list_dot_product(vec, shift) AS rel FROM fw, pairs
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY abs(list_dot_product(vec, shift)) DESC, pair) <= 5),
tg AS MATERIALIZED (SELECT word, list(v ORDER BY d) AS u FROM (SELECT word, d, sum(-rel * (vec[d] + shift[d])) AS v
  FROM mv JOIN pairs USING (pair) JOIN fw USING (word), unnest({'generate_series(1, 64)'}) AS t(d) GROUP BY ALL) GROUP BY word),
cd5 AS MATERIALIZED (SELECT fw.word, c.word AS cand, c.vec, c.idx FROM fw, wv c
  QUALIFY row_number() OVER (PARTITION BY fw.word ORDER BY list_dot_product(fw.vec, c.vec) DESC, c.idx) <= 5000),
opp AS MATERIALIZED (SELECT word, arg_max(cand, (list_dot_product(vec, u), -idx)) AS opposite FROM cd5 JOIN tg USING (word)
  WHERE NOT starts_with(lower(word), lower(cand)) AND NOT starts_with(lower(cand), lower(word)) GROUP BY word)"""

CONTEXT_SQL = f"""{PHRASE_SQL},
seeds AS MATERIALIZED (SELECT item_id, 'pos' AS side, word FROM ph UNION ALL SELECT item_id, 'neg', opposite FROM ph JOIN opp USING (word)),
aim_s AS (SELECT item_id, side, d, sum(v) AS v FROM seeds JOIN wd USING (word) GROUP BY ALL),
aim AS MATERIALIZED (SELECT item_id, side, list(x.v / x.n + q.vec[d] / 2 ORDER BY d) AS t FROM
  (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY item_id, side)) AS n FROM aim_s) x JOIN qv q USING (item_id) GROUP BY ALL),
nr AS MATERIALIZED (SELECT item_id, side, word, idx, row_number() OVER (PARTITION BY item_id, side ORDER BY list_dot_product(t, vec) DESC, idx) AS near_rank
  FROM aim, wv QUALIFY near_rank <= 100),
cm2 AS (SELECT item_id, idx FROM nr GROUP BY ALL HAVING count(*) = 2),
cw AS MATERIALIZED (SELECT item_id, side, word, row_number() OVER (PARTITION BY item_id, side ORDER BY near_rank) AS place
  FROM nr WHERE (item_id, idx) NOT IN (SELECT (item_id, idx) FROM cm2) OR (item_id, side, word) IN (SELECT (item_id, side, word) FROM seeds)
  QUALIFY place <= 10)"""


def word_pairs(t: Tables, model):
    """Neighbours in the vocabulary stand for the list of opposites."""
    from ..sources.model import opposite_shifts

    idx = model.table.select("word", "idx", F.floor(F.col("idx") / 2).alias("pair"))
    pairs = idx.groupBy("pair").agg(F.min_by("word", "idx").alias("a"), F.max_by("word", "idx").alias("b"),
                                    F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n")
    return opposite_shifts(pairs, model)


def phrases(t: Tables, model):
    return embed.known_words(t.benchmark, model, "item_id", "text", first_sentence=True)


@query("opposite_shifts", f"""WITH {MODEL_SQL}, {PAIRS_SQL} SELECT pair, a, b, {fingerprint('shift')} AS fingerprint FROM pairs""")
def opposite_shifts(t: Tables):
    return word_pairs(t, word_model(t)).select("pair", "a", "b", vectors.fingerprint(F.col("shift")).alias("fingerprint"))


@query("find_opposite", f"WITH {MODEL_SQL}, {PHRASE_SQL} SELECT word, opposite FROM opp")
def find_opposite(t: Tables):
    from ..plans import semantic

    model = word_model(t)
    return semantic.find_opposite(phrases(t, model), model, word_pairs(t, model))


def context(t: Tables, model):
    from ..plans import semantic

    return semantic.context_words(phrases(t, model), query_vectors(t, model).filter(F.col("vec").isNotNull()), model,
                                  word_pairs(t, model), "item_id")


@query("context_words", f"WITH {MODEL_SQL}, {CONTEXT_SQL} SELECT item_id, side, place::INT AS place, word FROM cw")
def context_words(t: Tables):
    words = context(t, word_model(t))[0]
    return words.filter(F.col("place").isNotNull()).select("item_id", "side", "place", "word")


@query("intersect_context", f"""WITH {MODEL_SQL}, {CONTEXT_SQL}
SELECT item_id, word FROM nr WHERE side = 'pos' INTERSECT SELECT item_id, word FROM nr WHERE side = 'neg'""")
def intersect_context(t: Tables):
    from ..plans import semantic

    return semantic.intersect_context(context(t, word_model(t))[0], "item_id")


N_EACH, MIN_DOCS, PCT = 2, 200, 0.5

from .vectors import core_vectors  # noqa: E402

SEMANTIC_SQL = f"""{SIMILAR_SQL.replace(f'before < {N_DOCS}', f'before < {MIN_DOCS}')},
{CONTEXT_SQL.replace(QUERY_SQL + ', ', '')},
axis_s AS (SELECT item_id, side, d, sum(v) AS v FROM cw JOIN wd USING (word) GROUP BY ALL),
axis AS MATERIALIZED (SELECT item_id, side, list(v / n ORDER BY d) AS vec FROM
  (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY item_id, side)) AS n FROM axis_s) GROUP BY ALL),
{core_vectors('cs', 'cd', 'doc_id', 'cc')},
tp AS MATERIALIZED (SELECT item_id, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n,
  row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 10) DESC, doc_id) AS rn FROM found) WHERE rn <= floor({PCT} * greatest({MIN_DOCS}, n))),
ss AS MATERIALIZED (SELECT item_id, doc_id, abs(p / q) * (q - p) AS score FROM
  (SELECT tp.item_id, tp.doc_id, list_dot_product(cc.vec, a.vec) AS p, list_dot_product(cc.vec, b.vec) AS q
   FROM tp JOIN cc USING (doc_id) JOIN axis a ON a.item_id = tp.item_id AND a.side = 'pos'
   JOIN axis b ON b.item_id = tp.item_id AND b.side = 'neg'))"""


@query("semantic_rank", f"""WITH {SEMANTIC_SQL}
SELECT item_id, doc_id, side, place::INT AS place, {sql.r6('score')} AS score FROM (
  SELECT *, 'pos' AS side, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6), doc_id) AS place FROM ss
  UNION ALL SELECT *, 'neg', row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id DESC) FROM ss)
WHERE place <= {N_EACH}""")
def semantic_rank(t: Tables):
    from ..plans import semantic

    model = word_model(t)
    docs = opening_vectors(t, model)
    found = search.similar_docs(query_vectors(t, model), docs.select("doc_id", "partition", "vec"), pivots(t), MIN_DOCS,
                                key="item_id")
    top = semantic.top_of_query(found, "item_id", "doc_id", PCT, MIN_DOCS)
    axis = context(t, model)[1]
    ranked = semantic.semantic_rank(top, docs.select("doc_id", F.col("core").alias("vec")), axis, "item_id", "doc_id", N_EACH)
    return ranked.select("item_id", "doc_id", "side", "place", vectors.round6(F.col("score")).alias("score"))


def opening_vectors(t: Tables, model):
    """Mean and core vector of the opening sentences of every candidate."""
    docs = article_sentences(t).withColumnRenamed("n_chars", "contentLength")
    whole = embed.score_docs(docs.withColumn("all", F.col("sentences")), model, "mean", sentences="all", key="doc_id")
    placed = nearest_pivot(whole.filter(F.col("vec").isNotNull()), pivots(t)).drop("vec", "similarity")
    both = scan.candidate_docs(placed).withColumn("again", F.col("sentences"))
    core = embed.score_docs(both, model, "core", sentences="again", key="doc_id").withColumnRenamed("vec", "core")
    return embed.score_docs(core, model, "mean", key="doc_id").select("doc_id", "partition", "core", "vec").checkpoint()


@query("top_results", f"""WITH {SIMILAR_SQL}
SELECT item_id, doc_id, CASE WHEN starts_with(source, 'http') THEN source ELSE 'http://' || source END || '/' || doc_id AS url
FROM found JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 10) DESC, doc_id) <= 25""")
def top_results(t: Tables):
    from ..plans import semantic

    model = word_model(t)
    found = search.similar_docs(query_vectors(t, model), candidates(t, model), pivots(t), N_DOCS, key="item_id")
    urls = t.documents.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"))
    return semantic.top_results(found.join(urls, "doc_id"), "item_id", "doc_id", "url").select("item_id", "doc_id", "url")
