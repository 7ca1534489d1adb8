"""The URL frontier: known-page joins, routing, screening, error intake."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.fields import is_valid
from ..functions.urls import escape_value, safe_value, skinny_url, url_features, usable_link
from ..session import ensure_checkpoint_dir

ERROR_COLUMNS = ["URL", "skinnyURL", "errorCode", "parserLog", "dupliURL", "otherErrorMessage", "usedForBody"]
ALLOWED = ["reuters", "bbc"]


def _values(values: DataFrame, what: str) -> DataFrame:
    c = F.col(what)
    return values.filter(safe_value(c)).select(escape_value(c).alias(what)).distinct()


def _keys(tables: Sequence[DataFrame], what: str) -> DataFrame:
    return reduce(DataFrame.union, [t.select(what) for t in tables])


# A batch of up to this many values goes to every task, so that stored keys are not moved to meet it.
BATCH_ROWS = 1_000_000


def _settled(batch: DataFrame) -> DataFrame:
    """A batch is read several times and may come from parsed pages: computed once."""
    ensure_checkpoint_dir(batch.sparkSession)
    return batch.checkpoint()


def _met(values: DataFrame, what: str, stored: DataFrame) -> DataFrame:
    """The values of a settled batch that are stored: at most as many rows as the batch has.

    The batch meets the stored keys where they are; only what it meets is moved.
    """
    batch = F.broadcast(values) if values.count() <= BATCH_ROWS else values
    return stored.join(batch.select(what), what, "left_semi").distinct()


def exist(values: DataFrame, what: str, tables: Sequence[DataFrame]) -> DataFrame:
    """Distinct values found in any of the tables."""
    return _met(_settled(_values(values, what)), what, _keys(tables, what))


def missing(values: DataFrame, what: str, tables: Sequence[DataFrame]) -> DataFrame:
    """Distinct values found in none of the tables."""
    fresh = _settled(_values(values, what))
    return fresh.join(_met(fresh, what, _keys(tables, what)), what, "left_anti")


def missing_from_all(urls: DataFrame, main: DataFrame, newbies: DataFrame, errors: DataFrame) -> DataFrame:
    """``(URL, skinnyURL)`` of pages neither stored nor known to be faulty."""
    fresh = _settled(_values(urls, "URL").withColumn("skinnyURL", skinny_url(F.col("URL"))))
    stored = _met(fresh.select("URL"), "URL", _keys([main, newbies], "URL"))
    faulty = _met(fresh.select("skinnyURL").distinct(), "skinnyURL", errors.select("skinnyURL"))
    return fresh.join(stored, "URL", "left_anti").join(faulty, "skinnyURL", "left_anti")


# Up to this many sites are one chain of conditions; more are joined.
CHAIN = 200
# Characters of a site's name that are compared before its regex is.
NAME = 64
IN_NAME, NOT_IN_NAME = "[A-Za-z0-9._-]", "[^A-Za-z0-9._-]"


def route_by_regex(df: DataFrame, url: str, config: DataFrame, order: str,
                   outputs: Sequence[str] = ("domain", "collection"), chain: int = CHAIN) -> DataFrame:
    """Add the config columns of the first row whose regex matches at the start.

    A few sites become one chain of conditions in generated code, and rows stay
    where they are.  More sites meet the URLs in a join: see ``_joined_route``.
    A stream cannot be regrouped, so it always takes the chain.
    """
    config = config.select("domainRegex", *outputs, order).filter(F.col("domainRegex").isNotNull())
    few = config.orderBy(order).limit(chain + 1).collect() if not df.isStreaming else config.orderBy(order).collect()
    if len(few) > chain and not df.isStreaming:
        return _joined_route(df, url, config, order, outputs)
    hit = F.lit(None).cast("int")
    for i, row in reversed(list(enumerate(few))):
        hit = F.when(F.col(url).rlike(f"^(?:{row['domainRegex']})"), F.lit(i)).otherwise(hit)
    df = df.withColumn("__site", hit)
    for name in outputs:
        known = F.array(*[F.lit(r[name]).cast("string") for r in few]) if few else F.lit(None)
        value = F.get(known, F.col("__site")) if few else known.cast("string")
        df = df.withColumn(name, value)
    return df.drop("__site")


def _site_name(regex: str | None) -> str | None:
    """A name every URL that matches must hold, and after it a character that is part of no name; null if none is sure.

    Only what is certain is read from the regex: plain and escaped characters
    outside of groups, sets and alternatives, without those that a ``?``, ``*``
    or ``{`` makes optional.
    """
    if regex is None or re.search(r"[|()\[\]]", regex.replace("\\|", "")):
        return None
    runs, at = [""], 0
    while at < len(regex):
        c, step = regex[at], 1
        if c == "\\" and at + 1 < len(regex):
            # an escaped letter or digit is a class or a boundary
            literal, step = (None if regex[at + 1].isalnum() else regex[at + 1]), 2
        else:
            literal = None if c in ".^$*+?{}" else c
        after = regex[at + step:at + step + 1]
        if literal is None:
            runs.append("")
            if c == "{":
                step = max(regex.find("}", at) - at, 0) + 1
        elif after and after in "?*{":
            runs.append("")
        else:
            runs[-1] += literal
            if after == "+":
                runs.append("")
        at += step
    names = [m.group(1) for run in runs for m in re.finditer(rf"({IN_NAME}+)(?={NOT_IN_NAME})", run)]
    return max(names, key=len)[-NAME:] if names else None


@F.pandas_udf(StringType())
def site_name(regexes: pd.Series) -> pd.Series:
    return regexes.map(_site_name)


def _joined_route(df: DataFrame, url: str, config: DataFrame, order: str, outputs: Sequence[str]) -> DataFrame:
    """Any number of sites: by the ends of the names in a URL, and then by the regexes of the sites these may be.

    A regex mostly spells a name, such as the one of its host.  A URL that
    matches has a word that ends in it, so the ends of its words, at the lengths
    there are, are joined with the names; only then is a regex tried.  Sites
    whose regex spells none are few, and are tried on every URL.  The first
    match by ``order`` is a minimum per URL, which combines before it moves.
    """
    sites = config.withColumn("__name", site_name("domainRegex")).withColumn(
        "__row", F.struct(F.col(order).alias("o"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(outputs)]))
    named = sites.filter(F.col("__name").isNotNull()).select("__name", "domainRegex", "__row")
    wild = sites.filter(F.col("__name").isNull()).select("domainRegex", "__row")
    urls = df.select(F.col(url).alias("__url")).filter(F.col("__url").isNotNull()).distinct()
    # one row: the lengths of names, at most NAME of them
    lengths = named.agg(F.collect_set(F.length("__name")).alias("__lengths"))
    words = F.array_distinct(F.filter(F.split("__url", NOT_IN_NAME + "+"), lambda w: w != ""))
    ends = F.flatten(F.transform(words, lambda w: F.transform(
        F.filter("__lengths", lambda n: n <= F.length(w)), lambda n: F.right(w, n))))
    probes = urls.join(F.broadcast(lengths)).select("__url", F.explode(F.array_distinct(ends)).alias("__name"))
    fits = F.expr("__url RLIKE concat('^(?:', domainRegex, ')')")
    hits = probes.join(named, "__name").filter(fits).select("__url", "__row").unionByName(
        urls.join(F.broadcast(wild), fits).select("__url", "__row"))
    first = hits.groupBy("__url").agg(F.min("__row").alias("__row"))
    routed = df.join(first, F.col(url) == F.col("__url"), "left")
    return routed.withColumns({c: F.col(f"__row.c{i}") for i, c in enumerate(outputs)}).drop("__url", "__row")


def new_errors(docs: DataFrame, existing: DataFrame, raised: Column | None = None) -> DataFrame:
    """Error rows to append: faulty documents not yet listed by skinny URL."""
    if "skinnyURL" not in docs.columns:
        docs = docs.withColumn("skinnyURL", F.lit(None).cast("string"))
    bad = docs.filter(F.col("errorCode").isNotNull() & (F.col("errorCode") != "allGood") & F.col("URL").isNotNull())
    bad = bad.withColumn("skinnyURL", F.coalesce("skinnyURL", skinny_url(F.col("URL"))))
    fresh = bad.join(existing.select("skinnyURL"), "skinnyURL", "left_anti")
    kept = [c for c in ERROR_COLUMNS if c in fresh.columns]
    stamp = F.current_timestamp() if raised is None else raised
    return fresh.select(*kept, stamp.alias("raisedTs"))


def links_to_frontier(docs: DataFrame, seq: str, main: DataFrame, newbies: DataFrame, errors: DataFrame,
                      config: DataFrame, order: str) -> DataFrame:
    """New links of ``docs(URL, links)``, each once, for the first page naming it.

    The first referrer is a minimum per link: it combines before the shuffle, so
    a link that every page carries costs one row per task.
    """
    exploded = docs.select(F.col(seq).alias("__seq"), F.col("URL").alias("refURL"),
                           F.posexplode_outer("links").alias("__pos", "URL"))
    usable = exploded.filter(usable_link(F.col("URL"))).withColumn("URL", escape_value(F.col("URL")))
    first = (usable.groupBy("URL").agg(F.min(F.struct("__seq", "__pos", "refURL")).alias("__first"))
             .select("URL", F.col("__first.refURL").alias("refURL")))
    fresh = missing_from_all(first.select("URL"), main, newbies, errors)
    routed = route_by_regex(first.join(fresh, "URL"), "URL", config, order)
    key = F.when(F.col("collection").isNull(), "unrouted").otherwise(F.concat("collection", F.lit("-links")))
    return routed.select("URL", "refURL", "skinnyURL", "domain", key.alias("routing_key"))


def screening_score(model: Mapping[str, float], url: Column) -> Column:
    """Probability that a URL leads to an error, from a table of coefficients.

    Names are static features, ``intercept``, or tokens of the skinny URL.
    """
    feats = url_features(url)
    z = F.lit(float(model.get("intercept", 0.0)))
    for name, weight in model.items():
        if name == "intercept":
            continue
        value = feats[name] if name in feats and name != "tokens" else \
            F.array_contains(feats["tokens"], name).cast("int")
        z = z + value * F.lit(float(weight))
    return 1 / (1 + F.exp(-z))


def screen_threshold(backlog: Column, block: int) -> Column:
    """0.5 for a busy queue, towards 1 for an idle one."""
    return F.greatest(F.lit(0.5), 1 / (1 + F.log(1 + backlog / F.lit(block))))


def screen_urls(df: DataFrame, url: str, model: Mapping[str, float], threshold: Column | float,
                allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """Keep what the model lets pass, and what is on the allow list anyway."""
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    keep = F.col("pDodgy") <= limit
    for part in allowed:
        keep = keep | F.contains(F.col(url), F.lit(part))
    return df.withColumn("pDodgy", screening_score(model, F.col(url))).filter(keep)


def train_screening(df: DataFrame, url: str, label: str, tokens: Sequence[str]):
    """Fit the coefficient table with logistic regression on labelled URLs."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from ..functions.urls import STATIC_FEATURES, url_feature_matrix

    wide = url_feature_matrix(df, url, list(tokens))
    inputs = STATIC_FEATURES + [f"tok_{t}" for t in tokens]
    # dots in column names would be read as paths into structs
    safe = {c: f"f{i}" for i, c in enumerate(inputs)}
    wide = wide.select(F.col(label).cast("double").alias("label"),
                       *[F.col(f"`{c}`").cast("double").alias(s) for c, s in safe.items()])
    rows = VectorAssembler(inputCols=list(safe.values()), outputCol="features").transform(wide)
    fitted = LogisticRegression(maxIter=50, regParam=0.01).fit(rows)
    names = STATIC_FEATURES + list(tokens)
    return {"intercept": float(fitted.intercept), **dict(zip(names, map(float, fitted.coefficients)))}


def requeue_invalid(judged: DataFrame, valid: Column, collection: str) -> DataFrame:
    """Messages that send invalid documents back to the queue of their collection.

    The documents may come straight from their pages.  Then a filter would move
    below the extraction and repeat it, each field once more for every field it
    is used by; so the verdict is a column, and the batches are sorted out by it.
    """
    from ..sources.queues import base_queue

    kept = [c for c in ("URL", "skinnyURL", "domain", "refURL") if c in judged.columns]
    told = judged.select(*kept, (~valid & F.col("URL").isNotNull()).alias("__again"))
    schema = StructType(told.schema.fields[:-1])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(batch.column("__again")).select(kept)

    return told.mapInArrow(again, schema).withColumn("routing_key", F.lit(base_queue(collection)))


def field_validity(df: DataFrame, fields: Sequence[str], now: Column) -> DataFrame:
    """How many documents have each field valid."""
    return df.agg(*[F.count_if(is_valid(f, F.col(f), now)).alias(f"valid_{f}") for f in fields])
