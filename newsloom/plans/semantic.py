"""Words of opposite meaning, context words of a phrase, ranking along that axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import add, dot, scale, sum_vectors, unit
from ..operators.nearest import best_products
from ..session import ensure_checkpoint_dir
from ..sources.model import WordModel

# How many candidates, shifts and context words are considered.
N_CANDIDATES = 5000
N_SHIFTS = 5
N_SIMILAR = 100
N_CONTEXT = 10


def _top(pairs: DataFrame, key: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return pairs.withColumn(name, place).filter(F.col(name) <= n)


def find_opposite(words: DataFrame, model: WordModel, shifts: DataFrame, n_candidates: int = N_CANDIDATES,
                  n_shifts: int = N_SHIFTS) -> DataFrame:
    """``(word, opposite)`` for distinct ``words(word)`` the model knows.

    The word is moved along the shifts (``pair, shift``) that matter most to it;
    the answer is the closest of its neighbours that is not a form of it.
    """
    known = words.select("word").distinct().join(model.table, "word").select("word", "idx", "vec")
    vocab = model.table.select(F.col("word").alias("candidate"), F.col("idx").alias("cand_idx"), "vec")
    near = best_products(known, vocab, "word", "candidate", "cand_idx", carry=["cand_idx"], top=n_candidates)
    near = _top(near, ["word"], [F.col("similarity").desc(), F.col("cand_idx")], n_candidates)
    w, c = F.lower("word"), F.lower("candidate")
    near = near.filter(~F.startswith(w, c) & ~F.startswith(c, w))

    moves = best_products(known, shifts.withColumnRenamed("shift", "vec"), "word", "pair", "pair", top=n_shifts, absolute=True)
    moves = _top(moves, ["word"], [F.abs("similarity").desc(), F.col("pair")], n_shifts)
    moved = (moves.join(shifts, "pair").join(known.select("word", "vec"), "word")
             .select("word", scale(add(F.col("vec"), F.col("shift")), -dot(F.col("vec"), F.col("shift"))).alias("vec")))
    target = sum_vectors(moved, ["word"]).select("word", unit(F.col("vec")).alias("__target"))
    scored = (near.select("word", "candidate", "cand_idx").join(target, "word")
              .join(vocab.select("candidate", "vec"), "candidate")
              .withColumn("score", dot(F.col("vec"), F.col("__target"))))
    return scored.groupBy("word").agg(
        F.max_by("candidate", F.struct("score", -F.col("cand_idx"))).alias("opposite"))


def context_words(phrases: DataFrame, contexts: DataFrame, model: WordModel, shifts: DataFrame,
                  key: str, n_similar: int = N_SIMILAR, n_context: int = N_CONTEXT) -> tuple[DataFrame, DataFrame]:
    """The words for and against each phrase, given its query's vector.

    ``phrases(key, pos, word, idx)`` are known words of the phrase and
    ``contexts(key, vec)`` query vectors.  Returns ``(key, side, place, word,
    idx, is_common)`` for the words close to either side, ``place`` null for
    those not chosen, and ``(key, side, vec)``.
    """
    vocab = model.table.select("word", "idx", "vec")
    opposite = find_opposite(phrases, model, shifts)
    pos = phrases.select(key, F.lit("pos").alias("side"), "word")
    neg = phrases.join(opposite, "word").select(key, F.lit("neg").alias("side"), F.col("opposite").alias("word"))
    # both the sides' centres and the choice of words read the seeds: a row per phrase word
    ensure_checkpoint_dir(phrases.sparkSession)
    seeds = pos.unionByName(neg).checkpoint().join(vocab, "word")

    centre = sum_vectors(seeds, [key, "side"])
    aimed = (centre.join(contexts.select(key, F.col("vec").alias("__ctx")), key)
             .select(F.struct(key, "side").alias("who"),
                     add(unit(F.col("vec")), scale(F.col("__ctx"), F.lit(0.5))).alias("vec")))
    near = best_products(aimed, vocab, "who", "word", "idx", carry=["idx"], top=n_similar)
    near = near.select(f"who.{key}", "who.side", "word", "idx", "similarity")
    order = [F.col("similarity").desc(), F.col("idx")]
    near = _top(near, [key, "side"], order, n_similar, "near_rank").checkpoint()

    both = near.groupBy(key, "idx").agg((F.count(F.lit(1)) == 2).alias("is_common"))
    marked = (near.join(both, [key, "idx"])
              .join(seeds.select(key, "side", "idx", F.lit(True).alias("__seed")).distinct(), [key, "side", "idx"], "left"))
    chosen = ~F.col("is_common") | F.coalesce("__seed", F.lit(False))
    place = F.row_number().over(Window.partitionBy(key, "side", chosen).orderBy(*order))
    words = marked.withColumn("place", F.when(chosen, place)).withColumn(
        "place", F.when(F.col("place") <= n_context, F.col("place")))
    words = words.select(key, "side", "place", "near_rank", "word", "idx", "is_common")
    chosen_words = words.filter(F.col("place").isNotNull()).join(vocab.select("idx", "vec"), "idx")
    axis = sum_vectors(chosen_words, [key, "side"]).select(key, "side", unit(F.col("vec")).alias("vec"))
    return words, axis


def intersect_context(words: DataFrame, key: str) -> DataFrame:
    """Words close to both sides of a phrase."""
    side = {s: words.filter(F.col("side") == s).select(key, "word") for s in ("pos", "neg")}
    return side["pos"].intersect(side["neg"])


def _best_first(doc: str) -> list[Column]:
    """Copies differ by rounding errors only; their ids put them in order."""
    return [F.round("similarity", 10).desc(), F.col(doc)]


def top_of_query(found: DataFrame, key: str, doc: str, pct: float, min_docs: int) -> DataFrame:
    """The share of a query's documents that is ranked: ``int(pct * max(min_docs, found))``."""
    sized = found.join(found.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key)
    place = F.row_number().over(Window.partitionBy(key).orderBy(*_best_first(doc)))
    allowed = F.floor(F.lit(pct) * F.greatest(F.lit(min_docs), F.col("__n")))
    return sized.withColumn("__place", place).filter(F.col("__place") <= allowed).drop("__place", "__n")


def semantic_rank(found: DataFrame, vectors: DataFrame, axis: DataFrame, key: str, doc: str,
                  n_each: int) -> DataFrame:
    """The ``n_each`` documents furthest to either side: ``(key, doc, side, place, score)``.

    ``found(key, doc)`` are the documents of each query, ``vectors(doc, vec)``
    their core vectors, ``axis(key, side, vec)`` the two ends.
    """
    ends = axis.groupBy(key).agg(*[
        F.max_by("vec", F.when(F.col("side") == s, 1)).alias(s) for s in ("pos", "neg")])
    rows = (found.select(key, doc).join(vectors.filter(F.col("vec").isNotNull()).select(doc, "vec"), doc)
            .join(ends, key))
    p, q = dot(F.col("vec"), F.col("pos")), dot(F.col("vec"), F.col("neg"))
    scored = rows.select(key, doc, p.alias("__p"), q.alias("__q")).withColumn(
        "score", F.abs(F.try_divide("__p", "__q")) * (F.col("__q") - F.col("__p"))).select(key, doc, "score")
    low = _top(scored, [key], [F.round("score", 6).asc(), F.col(doc)], n_each).withColumn("side", F.lit("pos"))
    high = _top(scored, [key], [F.round("score", 6).desc(), F.col(doc).desc()], n_each).withColumn("side", F.lit("neg"))
    return low.unionByName(high)


def append_phrase(history: Column, phrase: Column) -> Column:
    """A query remembers the phrases it was ranked by."""
    return F.concat(F.coalesce(history, F.array().cast("array<string>")), F.array(phrase))


def top_results(found: DataFrame, key: str, doc: str, url: str, n: int = 25) -> DataFrame:
    from ..functions.urls import web_url

    shown = _top(found, [key], _best_first(doc), n)
    return shown.withColumn(url, web_url(F.col(url)))
