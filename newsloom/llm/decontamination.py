"""Benchmark decontamination by spaced seeds.

A seed hashes the words of a window at the positions a mask keeps; the others
may differ.  Seeds of the benchmark are joined with the seeds at every position
of every document, and around each hit the words on its diagonal are compared.
All of it is DataFrame functions: positions are exploded and hashed inside
generated code, where a sieve of fixed size drops nearly all that meet no seed.
What memory a task takes does not depend on the number of items: hits are
numbers, a text is split once more if it was hit, and what is compared with an
item is no longer than the item.  Items alike in words are one until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import few, settle, sieve

# Positions a seed keeps.  The first mask alone meets every window of SPAN words with two substitutions.
MASKS = ((0, 1, 4, 6, 7), (0, 1, 3, 6, 7))
REACH = 8
# Words compared at a time, and how many of them may differ.
SPAN, SUBSTITUTIONS = 13, 2
# Items of REACH words up to SPAN have this mask too; it meets every one of them with a single substitution.
SHORT_MASK = (0, 2, 3, 5)
# Shorter items are searched as they are, those below this number of words only as whole documents.
LEAST_PASSAGE = 4
# Benchmark seeds up to this many rows (about 100 bytes each as a hash table) go to every executor; more are joined by shuffle.
BROADCAST_SEEDS = 100_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; null gives none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _masks(lengths: list[int]) -> list[tuple[int, ...]]:
    """The masks that items of the given lengths need: all positions of the short ones, and the spaced ones."""
    spaced = [*MASKS] if not lengths or lengths[-1] >= REACH else []
    short = [SHORT_MASK] if any(REACH <= n < SPAN for n in lengths) else []
    return spaced + short + [tuple(range(n)) for n in lengths if n < REACH]


def _allowed(size: Column) -> Column:
    """How many words may differ."""
    return F.when(size >= SPAN, SUBSTITUTIONS).when(size >= REACH, 1).otherwise(0)


def _seed(words: Column, pos: Column, mask: tuple[int, ...]) -> Column:
    # the hash begins with the mask, so that seeds of different masks never meet
    return F.xxhash64(F.lit(len(mask)), F.lit(sum(1 << k for k in mask)), *[F.get(words, pos + k) for k in mask])


def _fits(words: Column, pos: Column, mask: tuple[int, ...], document: bool) -> Column:
    """Whether a mask is looked up at a position, of an item or of a document."""
    size, n = F.size(words), len(mask)
    if mask in MASKS:
        return pos + REACH <= size
    if mask == SHORT_MASK:
        return (pos + mask[-1] < size) & (F.lit(True) if document else size.between(REACH, SPAN - 1))
    whole = size == n
    return whole if not document or n < LEAST_PASSAGE else pos + n <= size


def _seeds(words: Column, pos: Column, masks: list[tuple[int, ...]], document: bool) -> Column:
    """The seeds of all masks at a position, each with the number of its mask; null where a mask is not looked up."""
    return F.array(*[F.when(_fits(words, pos, mask, document), F.struct(F.lit(i).alias("mask"), _seed(words, pos, mask).alias("seed")))
                     for i, mask in enumerate(masks)])


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_SEEDS) -> DataFrame:
    """Places where a document holds a passage of a benchmark item.

    Per document and item: ``(doc_id, text_hash, item_id, n_words, n_equal,
    n_places)``; ``n_words`` is the number of words compared at a time,
    ``n_equal`` the most of them that were equal, ``n_places`` the number of
    alignments that passed.  Of SPAN words two may differ, of an item of REACH
    words or more one, of a shorter item none; an item of fewer than
    LEAST_PASSAGE words is common language and is found only where it is all a
    document says.  Items without words are not searched.  Null and empty texts
    hold nothing; rows alike in id and text are one document; a null id stays
    null.  Other columns are ignored.
    """
    items = _items(benchmark)
    ids = few(items.select("item_id", "item_hash"), "item-ids")
    found = _found(docs, items, broadcast_rows).join(ids, "item_hash")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("n_words").cast("long").alias("n_words"), F.max("n_equal").cast("long").alias("n_equal"),
        F.sum("n_places").alias("n_places"))


def _items(benchmark: DataFrame) -> DataFrame:
    """``(item_id, item_hash, item)`` of the items with an id and words."""
    return (benchmark.filter(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("item"))
            .filter(F.size("item") >= 1).dropDuplicates(["item_id", "item"]).select("item_id", F.xxhash64("item").alias("item_hash"), "item"))


def _found(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame:
    """``(doc_id, text_hash, item_hash, n_words, n_equal, n_places)`` of the documents and the words of items they hold."""
    items = settle(items.select("item_hash", "item").distinct(), "items")
    # one of a few numbers per item, so a handful of rows
    lengths = sorted(r[0] for r in items.select(F.least(F.size("item"), F.lit(SPAN))).distinct().collect())
    masks = _masks(lengths)
    positions = items.select("item_hash", "item", F.posexplode("item").alias("at", "w"))
    seeds = positions.select("item_hash", F.size("item").alias("size"), "at", F.explode(_seeds(F.col("item"), F.col("at"), masks, False)).alias("s"))
    seeds = settle(seeds.filter("s IS NOT NULL").select("item_hash", "size", "at", "s.mask", "s.seed").distinct(), "seeds")
    n_seeds = seeds.count()
    sent = F.broadcast if n_seeds <= broadcast_rows else lambda df: df

    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    places = split.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "w")).drop("w")
    probes = places.select("doc_id", "text_hash", "pos", F.explode(
        _seeds(F.col("words"), F.col("pos"), masks, True)).alias("s")).filter("s IS NOT NULL")
    probes = probes.select("doc_id", "text_hash", "pos", "s.mask", "s.seed").filter(sieve(seeds.select("seed"), n_seeds)(F.col("seed")))
    # several hits of one alignment say the same
    hits = settle(probes.join(sent(seeds), ["mask", "seed"]).select(
        "doc_id", "text_hash", "item_hash", "size", (F.col("pos") - F.col("at")).alias("start")).distinct(), "hits")

    there = settle(hits.select("text_hash").distinct(), "hit-texts")
    own = F.xxhash64("text")
    texts = (docs.filter(sieve(there, there.count())(own)).groupBy(F.col("doc_id").alias("__id"), own.alias("__hash"))
             .agg(F.first("text").alias("text")).select("__id", "__hash", words_of(F.col("text")).alias("words")))
    # what an item can meet of a text: an alignment may begin before the text, or end behind it
    before, size = F.least(F.col("start"), F.lit(0)), F.col("size")
    passages = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select(
        "doc_id", "text_hash", "item_hash", before.alias("start"),
        F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, size + before).alias("words"))
    compared = passages.join(sent(items), "item_hash").select("doc_id", "text_hash", "item_hash", *_compared())
    return compared.filter("n_equal >= n_words - allowed").groupBy("doc_id", "text_hash", "item_hash").agg(
        F.max("n_words").alias("n_words"), F.max("n_equal").alias("n_equal"), F.count(F.lit(1)).alias("n_places"))


def _compared() -> list[Column]:
    """Of an alignment of ``item`` at ``start`` of ``words``: the words compared, the most that are equal, and how many may differ."""
    item, words, n = F.col("item"), F.col("words"), F.size("item")
    span = F.least(F.lit(SPAN), n)
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.get(item, i) == F.get(words, F.col("start") + i), 1).otherwise(0))
    # equal words up to each place, so that a window is a difference of two
    sums = F.aggregate(same, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    # a one-element transform names the sums, so that they are not computed per window
    best = F.get(F.transform(F.array(sums), lambda s: F.array_max(F.transform(
        F.sequence(F.lit(0), n - span), lambda i: F.get(s, i + span) - F.get(s, i)))), 0)
    return [span.alias("n_words"), best.alias("n_equal"), _allowed(n).alias("allowed")]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no passage of the benchmark, with all their columns."""
    found = _found(docs, _items(benchmark), BROADCAST_SEEDS).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    found = few(found, "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(found, same, "left_anti")


# The same answer from runs of four equal words, which all but the shortest items leave however they may differ.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ip AS (SELECT item_id, w, p, w[p:p + 3] AS k FROM i, unnest(generate_series(1, len(w) - 3)) AS u(p) WHERE len(w) >= 4),
dp AS (SELECT doc_id, w, p, w[p:p + 3] AS k FROM d, unnest(generate_series(1, len(w) - 3)) AS u(p) WHERE len(w) >= 4),
h AS (SELECT DISTINCT dp.doc_id, ip.item_id, dp.w AS dw, ip.w AS iw, dp.p - ip.p AS s FROM dp JOIN ip USING (k)),
m AS (SELECT doc_id, item_id, s, len(iw) AS n, least(13, len(iw)) AS span,
  list_transform(generate_series(1, len(iw)), lambda x: CASE WHEN x + s >= 1 AND x + s <= len(dw) AND dw[x + s] = iw[x] THEN 1 ELSE 0 END) AS same FROM h),
b AS (SELECT doc_id, item_id, n, span, list_max(list_transform(generate_series(1, n - span + 1), lambda x: list_sum(same[x:x + span - 1]))) AS best FROM m
  UNION ALL SELECT doc_id, item_id, len(i.w), len(i.w), len(i.w) FROM d JOIN i ON d.w = i.w WHERE len(i.w) BETWEEN 1 AND 3)
SELECT doc_id, item_id, CAST(max(span) AS BIGINT) AS n_words, CAST(max(best) AS BIGINT) AS n_equal, count(*) AS n_places
FROM b WHERE best >= span - CASE WHEN n >= 13 THEN 2 WHEN n >= 8 THEN 1 ELSE 0 END GROUP BY doc_id, item_id
"""
