"""Personal data: fixed patterns, and terms that give a protected entity away.

Base spans are e-mail addresses, IP addresses, card numbers and telephone
numbers.  Beyond them, the corpus says which words disclose an entity: a word
met near an entity in several independent contexts, far more often than in the
corpus at large, and seldom without it, is generalised, or removed where the
disclosure is very strong, in every text, also where the entity itself is not
named.

All of it is DataFrame functions.  Patterns hold no repeated groups, so a match
of any length needs no stack, and a run is entered only at its start, so no
text costs quadratic time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import few, settle

KINDS = ("email", "ip", "card", "phone", "term")
# Characters on either side of an entity that make its context.
CONTEXT = 80
# A term discloses an entity if it is near it in so many different contexts,
LEAST_CONTEXTS = 3
# if it is so many times (in bits) likelier there than in any document,
LEAST_BITS = 5.0
# and if at least this share of the different texts that hold the term hold the entity too.
LEAST_SHARE = 0.5
# From this share on the term is removed, below it is generalised.
REMOVE_SHARE = 0.9
# Candidate terms up to this many rows (of about 100 bytes) go to every executor; more are joined by shuffle.
BROADCAST_TERMS = 200_000

# A separator inside a number, or a dot inside a host name, becomes this single character before matching.
_JOIN = "\u0001"
_DOM = "A-Za-z0-9-"
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+{_JOIN}-]))[A-Za-z0-9._%+{_JOIN}-]+@[{_DOM}]+{_JOIN}[{_DOM}{_JOIN}]+"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = rf"[0-9][0-9{_JOIN}]+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"


def _joined(text: Column, inner: str, around: str) -> Column:
    clean = F.translate(text, _JOIN, "\u0002")
    return F.regexp_replace(clean, f"(?<=[{around}]){inner}(?=[{around}])", _JOIN)


def _matches(text: Column, pattern: Column) -> Column:
    """``array<struct<start, end, value>>`` of all matches, from the lengths of the texts between them."""
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["value"])).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    starts = F.aggregate(pairs, empty, step, lambda acc: acc["starts"])
    return F.zip_with(starts, values, lambda s, v: F.struct(
        s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; the sum of all digits ends in 0."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _small(part: Column) -> Column:
    shown = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(shown) > 3, False).when(shown == "", True).otherwise(shown.cast("int") <= 255)


def base_spans(text: Column) -> Column:
    """``array<struct<start, rank, end, value>>`` of the base kinds, by start, then kind; null text has none."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def when(test: Column, found: Column, keep) -> Column:
        return F.when(test, F.filter(found, keep)).otherwise(none)

    kinds = [
        when(text.contains("@"), _matches(_joined(text, r"\.", _DOM), F.lit(EMAIL)), lambda m: F.lit(True)),
        when(text.rlike(r"[0-9]\.[0-9]"), _matches(text, F.lit(IP)),
             lambda m: F.forall(F.split(m["value"], r"\."), _small)),
        when(text.rlike(r"[0-9][0-9 -]{12,}[0-9]"), _matches(_joined(text, "[ -]", "0-9"), F.lit(CARD)),
             lambda m: F.length(_digits(m["value"])).between(14, 19) & _luhn(_digits(m["value"]))),
        when(text.rlike(r"\+[0-9]"), _matches(text, F.lit(PHONE)), lambda m: F.length(_digits(m["value"])).between(10, 15)),
    ]
    return F.array_sort(F.concat(*[_ranked(found, rank) for rank, found in enumerate(kinds)]))


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lower(m["value"]).alias("value")))


def _count(spans: str, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != "")


def disclosures(found: DataFrame, docs: DataFrame, broadcast_rows: int = BROADCAST_TERMS) -> DataFrame:
    """``(entity, term, bits, share)``: the terms that disclose an entity.

    ``found(text, base)`` holds the texts with base spans.  Copies of a context
    count once, so a term near an entity in one passage that is repeated in
    many documents discloses nothing.  Copies of a text count once on both
    sides of the share: a row weighs one over the copies of its text.
    """
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    copied = few(docs.groupBy(hashed.alias("__copy")).agg(F.count(F.lit(1)).alias("__copies")).filter("__copies > 1"), "copied-texts")

    def weighed(rows: DataFrame) -> DataFrame:
        return (rows.join(copied, hashed == F.col("__copy"), "left")
                .withColumn("weight", F.lit(1.0) / F.coalesce("__copies", F.lit(1))).drop("__copy", "__copies"))

    each = found.select("text", F.explode("base").alias("s"))
    from_ = F.greatest(F.col("s.start") - CONTEXT, F.lit(0))
    left = F.expr("regexp_replace(substring(text, from + 1, s.start - from), if(from > 0, '^[\\\\p{L}\\\\p{N}]+', '^$'), '')")
    right = F.expr(f"regexp_replace(substring(text, s.end + 1, {CONTEXT}), "
                   f"if(s.end + {CONTEXT} < length(text), '[\\\\p{{L}}\\\\p{{N}}]+$', '^$'), '')")
    contexts = (each.withColumn("from", from_).select(F.xxhash64("s.value").alias("entity"), F.concat_ws(
        " ", left, right).alias("around")).distinct())
    near = contexts.select("entity", F.explode(_terms(F.col("around"))).alias("term"))
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= LEAST_CONTEXTS)
    pairs = settle(pairs, "near-terms")
    entities = contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("contexts"))
    wanted, narrow = pairs.select("term").distinct(), pairs.count() <= broadcast_rows
    if narrow:
        wanted = F.broadcast(wanted)
    total = docs.count() - (copied.agg(F.sum(F.col("__copies") - 1)).first()[0] or 0)
    # counted first: a frequent word is one row per task before it meets anything
    held = (weighed(docs.select("text")).select("weight", F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term"))
            .groupBy("term").agg(F.round(F.sum("weight")).alias("texts")).join(wanted, "term"))
    # the whole text counts, not only what is near
    of = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["value"])))
    both = weighed(found.select("text", "base")).select("weight", _terms(F.col("text")).alias("terms"), F.explode(of).alias("entity"))
    if narrow:  # a bounded table of lists cuts the terms of a text down before they become rows
        candidates = F.broadcast(pairs.groupBy("entity").agg(F.collect_list("term").alias("near")))
        both = both.join(candidates, "entity").withColumn("terms", F.array_intersect("near", "terms"))
    # summed up in tasks, so an entity in a third of all texts is one row per task and term
    both = (both.select("entity", "weight", F.explode("terms").alias("term")).groupBy("entity", "term")
            .agg(F.round(F.sum("weight")).alias("shared")))
    out = pairs.join(entities, "entity").join(held, "term").join(both, ["entity", "term"])
    bits = F.log2(F.col("together") / F.col("contexts") / (F.col("texts") / F.lit(float(max(total, 1)))))
    share = F.least(F.lit(1.0), F.col("shared") / F.col("texts"))
    return (out.select("entity", "term", bits.alias("bits"), share.alias("share"))
            .filter((F.col("bits") >= LEAST_BITS) & (F.col("share") >= LEAST_SHARE)))


def _told(docs: DataFrame, telling: DataFrame, broadcast_rows: int) -> DataFrame:
    """``(__id, __hash, terms, gone, __text)`` of the rows whose texts hold telling terms, once per id and text."""
    terms = telling.groupBy("term").agg(F.max("share").alias("share"))
    terms = F.broadcast(terms) if telling.count() <= broadcast_rows else terms
    rows = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"), "text").filter(F.col("text").isNotNull())
    held = (rows.select("__id", "__hash", F.explode(_terms(F.col("text"))).alias("term")).join(terms, "term")
            .groupBy("__id", "__hash").agg(
                F.array_sort(F.collect_set("term")).alias("terms"),
                F.collect_set(F.when(F.col("share") >= REMOVE_SHARE, F.col("term"))).alias("gone")))
    held = settle(held, "telling-rows")
    keys = few(held.select(F.col("__id").alias("i"), F.col("__hash").alias("h")), "telling-keys")
    texts = (rows.join(keys, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__hash") == F.col("h")), "left_semi")
             .groupBy(F.col("__id").alias("i"), F.col("__hash").alias("h")).agg(F.first("text").alias("__text")))
    return held.join(texts, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__hash") == F.col("h"))).drop("i", "h")


def find_private(docs: DataFrame, broadcast_rows: int = BROADCAST_TERMS) -> DataFrame:
    """``(doc_id, text_hash, text, base, spans)`` for every row of ``docs(doc_id, text)``.

    ``base`` and ``spans`` are arrays of ``(start, rank, end, value)`` with
    code-point offsets, end exclusive; ``rank`` points into KINDS, ``spans``
    adds the disclosing terms of any entity outside base spans, whose ``value``
    starts with ``-`` if the term is to be removed.  ``text`` is null where ``spans`` is
    empty.  Null texts are empty texts; rows and ids may repeat or be null.
    """
    text = F.coalesce("text", F.lit(""))
    marked = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"), base_spans(text).alias("base"))
    found = settle(marked.select("doc_id", "text_hash", F.when(F.size("base") > 0, F.col("text")).alias("text"), "base"), "private")
    private = found.filter(F.size("base") > 0)
    telling = settle(disclosures(private, docs, broadcast_rows), "disclosures")
    of = _told(docs.select("doc_id", "text"), telling, broadcast_rows)
    told = found.join(of, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left").withColumn(
        "text", F.coalesce("text", "__text"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    words = F.when(F.col("terms").isNotNull(), _matches(F.lower("text"), pattern))
    outside = F.filter(words, lambda m: ~F.exists("base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    more = F.transform(outside, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index("term")).alias("rank"), m["end"].alias("end"),
        F.concat(F.when(F.array_contains("gone", m["value"]), "-").otherwise("+"), m["value"]).alias("value")))
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", more)))
    return told.select("doc_id", "text_hash", "text", "base", spans.alias("spans")).withColumn(
        "text", F.when(F.size("spans") > 0, F.col("text")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts of the base kinds, their digest and all spans."""
    counts = [_count("base", rank).alias(f"n_{name}") for rank, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind in brackets, and telling terms generalised or removed.

    Overlapping spans become one.  Other columns stay; a null text stays null.
    """
    found = find_private(docs).filter(F.size("spans") > 0)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        shown = F.when(F.substring(s["value"], 1, 1).eqNullSafe("-") & (s["rank"] == 4), "").otherwise(F.get(names, s["rank"]))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(
                F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), shown)).alias("parts")))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(
        F.col("text"), acc["at"] + 1, F.length("text") - acc["at"]))
    clean = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.aggregate(
        "spans", empty, step, rest).alias("__clean")).groupBy("__id", "__hash").agg(F.first("__clean").alias("__clean"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return (docs.join(clean, same, "left").withColumn("text", F.coalesce("__clean", "text"))
            .drop("__id", "__hash", "__clean"))
