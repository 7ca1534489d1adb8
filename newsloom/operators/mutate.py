"""Changes to document tables, as table-to-table transforms.

Each returns the new table and, where changes can fail, a table of what did not
apply.  A key is unique in the stored table and in a set of changes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import global_rank
from .scan import matches

# Rows per bucket of a running total: a bucket is ordered by one task.
RUN_WIDTH = 1 << 20


def insert_docs(table: DataFrame, docs: DataFrame, key: str, is_edge: bool = False,
                order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Add the documents whose key is free; the rest come back with a reason.

    Of several new documents with one key the first by ``order`` is added (any
    one if there is none), the others are conflicts.
    """
    taken = table.select(key, F.lit(True).alias("__taken"))
    reason = F.when(F.col("__taken"), F.lit("conflict"))
    if is_edge:
        reason = F.when(F.col("_from").isNull() | F.col("_to").isNull(), "edge without ends").otherwise(reason)
    judged = docs.join(taken, key, "left").withColumn("reason", reason).drop("__taken")
    free = judged.filter(F.col("reason").isNull())
    turn = F.struct(*([F.col(order)] if order else []), F.xxhash64(*docs.columns), F.monotonically_increasing_id())
    placed = free.withColumn("__turn", F.row_number().over(Window.partitionBy(key).orderBy(turn)))
    added = placed.filter(F.col("__turn") == 1).drop("reason", "__turn")
    late = placed.filter(F.col("__turn") > 1).withColumn("reason", F.lit("conflict")).drop("__turn")
    return table.unionByName(added), judged.filter(F.col("reason").isNotNull()).unionByName(late)


def _conflicts(table: DataFrame, changes: DataFrame, key: str, rev: str | None) -> Column:
    conflict = F.lit(False)
    if rev and "want_rev" in changes.columns:
        conflict = F.coalesce(F.col("want_rev") != F.col(rev), F.lit(False))
    return conflict


def _merge(table: DataFrame, patches: DataFrame, key: str, rev: str | None,
           body) -> tuple[DataFrame, DataFrame]:
    patch_cols = [c for c in patches.columns if c not in (key, "want_rev", "unset")]
    renamed = patches.select(
        key, F.lit(True).alias("__hit"),
        *[F.col(c) for c in ("want_rev", "unset") if c in patches.columns],
        *[F.col(c).alias(f"__new_{c}") for c in patch_cols])
    joined = table.join(renamed, key, "left")
    apply = F.coalesce(F.col("__hit"), F.lit(False)) & ~_conflicts(table, patches, key, rev)
    merged = joined.select(*[body(c, c in patch_cols, apply).alias(c) for c in table.columns])
    wanted = patches.select(key, *[c for c in ("want_rev",) if c in patches.columns])
    current = table.select(key, F.lit(True).alias("__found"), *([F.col(rev)] if rev else []))
    judged = wanted.join(current, key, "left").select(
        key, F.when(F.col("__found").isNull(), "missing")
        .when(_conflicts(table, patches, key, rev), "revision_error").alias("reason"))
    return merged, judged.filter(F.col("reason").isNotNull())


def update_docs(table: DataFrame, patches: DataFrame, key: str, rev: str | None = None,
                protected: Sequence[str] = (), keep_none: bool = True) -> tuple[DataFrame, DataFrame]:
    """Merge patches: what a patch names is overwritten, the rest stays.

    A null in a patch column means "not named"; ``unset`` (an array of column
    names) lists attributes set to null on purpose.  With ``keep_none`` false
    those attributes are removed instead, which for a column is null as well.
    ``want_rev`` makes a patch conditional; ``protected`` columns never change.
    """
    fixed = {key, rev, *protected}
    has_unset = "unset" in patches.columns

    def body(c: str, patched: bool, apply: Column) -> Column:
        if c in fixed:
            return F.col(c)
        value = F.col(c)
        if patched:
            value = F.when(apply & F.col(f"__new_{c}").isNotNull(), F.col(f"__new_{c}")).otherwise(value)
        if has_unset:
            gone = apply & F.coalesce(F.array_contains("unset", F.lit(c)), F.lit(False))
            value = F.when(~gone, value)
        return value

    return _merge(table, patches, key, rev, body)


def merge_attributes(old: Column, patch: Column, keep_none: bool = True) -> Column:
    """Merge-patch of open attributes held in a map; nulls stay or are removed."""
    base = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    merged = F.map_concat(base, patch)
    return merged if keep_none else F.map_filter(merged, lambda _, v: v.isNotNull())


def replace_docs(table: DataFrame, docs: DataFrame, key: str, rev: str | None = None,
                 protected: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Replace whole bodies: attributes a document does not list become null."""
    fixed = {key, rev, *protected}

    def body(c: str, patched: bool, apply: Column) -> Column:
        if c in fixed:
            return F.col(c)
        return F.when(apply, F.col(f"__new_{c}") if patched else F.lit(None)).otherwise(F.col(c))

    return _merge(table, docs, key, rev, body)


def delete_docs(table: DataFrame, requests: DataFrame, key: str,
                rev: str | None = None) -> tuple[DataFrame, DataFrame]:
    marks = requests.select(key, F.lit(True).alias("__hit"),
                            *[c for c in ("want_rev",) if c in requests.columns])
    joined = table.join(marks, key, "left")
    gone = F.coalesce(F.col("__hit"), F.lit(False)) & ~_conflicts(table, requests, key, rev)
    kept = joined.filter(~gone).select(*table.columns)
    current = table.select(key, F.lit(True).alias("__found"), *([F.col(rev)] if rev else []))
    judged = requests.join(current, key, "left").select(
        key, F.when(F.col("__found").isNull(), "missing")
        .when(_conflicts(table, requests, key, rev), "revision_error").alias("reason"))
    return kept, judged.filter(F.col("reason").isNotNull())


def _chosen(table: DataFrame, example: Mapping[str, object], key: str, limit: int | None) -> DataFrame:
    """The table with ``__hit`` on the rows a by-example change touches."""
    if limit is None:
        return table.withColumn("__hit", matches(example))
    keys = table.filter(matches(example)).select(key).orderBy(key).limit(limit)
    return (table.join(keys.withColumn("__mark", F.lit(True)), key, "left")
            .withColumn("__hit", F.coalesce("__mark", F.lit(False))).drop("__mark"))


def _counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("__hit").alias("n"))


def update_by_example(table: DataFrame, example: Mapping[str, object], patch: Mapping[str, object],
                      key: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Patch every match in key order up to ``limit``; also the count of them."""
    marked = _chosen(table, example, key, limit)
    new = [F.when(F.col("__hit"), F.lit(patch[c]).cast(table.schema[c].dataType))
           .otherwise(F.col(c)).alias(c) if c in patch and c != key else F.col(c)
           for c in table.columns]
    return marked.select(*new), _counted(marked)


def replace_by_example(table: DataFrame, example: Mapping[str, object], doc: Mapping[str, object],
                       key: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    marked = _chosen(table, example, key, limit)
    new = [F.col(c) if c == key else
           F.when(F.col("__hit"), F.lit(doc.get(c)).cast(table.schema[c].dataType))
           .otherwise(F.col(c)).alias(c)
           for c in table.columns]
    return marked.select(*new), _counted(marked)


def remove_by_example(table: DataFrame, example: Mapping[str, object], key: str,
                      limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    marked = _chosen(table, example, key, limit)
    return marked.filter(~F.col("__hit")).select(*table.columns), _counted(marked)


def remove_by_keys(table: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without the keys, and one row ``(removed, ignored)``."""
    wanted = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
    found = wanted.join(table.select(key, F.lit(1).alias("__found")), key, "left")
    report = found.agg(F.count("__found").alias("removed"),
                       F.count_if(F.col("__found").isNull()).alias("ignored"))
    return table.join(wanted, key, "left_anti"), report


def upsert_docs(table: DataFrame, docs: DataFrame, on: str = "URL", order: str | None = None) -> DataFrame:
    """Insert, or merge-patch the document that has the same ``on`` value.

    Several patches of one document count as one: of every column the last
    value named, by ``order`` (any of them if there is none).
    """
    named = [c for c in docs.columns if c != on]
    turn = F.struct(*([F.col(order)] if order else []), F.xxhash64(*docs.columns))
    folded = docs.groupBy(on).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), turn)).alias(c) for c in named])
    if not named:
        folded = docs.select(on).distinct()
    renamed = folded.select(*[F.col(c).alias(f"__new_{c}") for c in docs.columns])
    same = F.col(on) == F.col(f"__new_{on}")
    columns = table.columns + [c for c in docs.columns if c not in table.columns]

    def merged(c: str) -> Column:
        if c not in docs.columns:
            return F.col(c)
        if c not in table.columns:
            return F.col(f"__new_{c}").alias(c)
        return F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c)

    # the batch is the small side of both joins; the stored table is not moved if it fits a broadcast
    patched = table.join(renamed, same, "left").select(*[merged(c) for c in columns])
    met = table.select(on).join(folded.select(on), on, "left_semi").distinct()
    fresh = folded.join(met, on, "left_anti")
    added = fresh.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in columns])
    return patched.unionByName(added)


def delete_everywhere(docs: DataFrame, main: DataFrame, newbies: DataFrame,
                      errors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove by URL from the two article tables, by skinny URL from the errors."""
    urls = docs.select("URL").distinct()
    skinnies = docs.select("skinnyURL").distinct()
    return (main.join(urls, "URL", "left_anti"), newbies.join(urls, "URL", "left_anti"),
            errors.join(skinnies, "skinnyURL", "left_anti"))


def apply_batch(table: DataFrame, ops: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Apply an ordered batch ``(seq, op, <key>, body map<string,string>)``.

    ``op`` is create, update, replace or delete; ``seq`` is anything with an
    order that is unique per key.  Whether an operation applies
    depends only on the last create or delete before it, or else on the stored
    table, so one window per key settles all of them at once.  ``table`` is
    ``(<key>, body map<string,string>)``; rows whose key the batch does not
    name pass as they are.
    """
    empty = F.create_map().cast("map<string,string>")
    keys = ops.select(key).distinct()
    untouched = table.join(keys, key, "left_anti").withColumn("body", F.coalesce("body", empty)).select(key, "body")
    table = table.join(keys, key, "left_semi")
    per_key = Window.partitionBy(key).orderBy("seq")
    before = per_key.rowsBetween(Window.unboundedPreceding, -1)
    stored = table.select(key, F.lit(True).alias("__stored"))
    switch = F.when(F.col("op").isin("create", "delete"), F.col("op"))
    judged = (ops.join(stored, key, "left")
              .withColumn("__last", F.last(switch, ignorenulls=True).over(before))
              .withColumn("__present", F.when(F.col("__last").isNull(), F.coalesce("__stored", F.lit(False)))
                          .otherwise(F.col("__last") == "create"))
              .withColumn("valid", F.when(F.col("op") == "create", ~F.col("__present"))
                          .otherwise(F.col("__present")))
              .select("seq", "op", key, "body", "valid"))
    rejected = judged.filter(~F.col("valid")).select("seq", "op", key)

    valid = judged.filter("valid")
    resets = F.when(F.col("op").isin("create", "replace", "delete"), F.col("seq"))
    fate = valid.groupBy(key).agg(
        F.max(resets).alias("__reset"),
        F.max_by("op", F.when(F.col("op").isin("create", "delete"), F.col("seq"))).alias("__end"))
    fate = fate.withColumn("__dead", F.coalesce(F.col("__end") == "delete", F.lit(False)))

    # every attribute takes its latest value since the last operation that emptied the body
    attrs = (valid.filter(F.col("op") != "delete")
             .select(key, "seq", F.explode("body").alias("attr", "value")))
    no_seq = F.lit(None).cast(ops.schema["seq"].dataType)
    base = table.select(key, no_seq.alias("seq"), F.explode("body").alias("attr", "value"))
    every = (base.unionByName(attrs).join(fate, key, "left")
             .filter(~F.coalesce("__dead", F.lit(False)))
             .filter(F.col("__reset").isNull() | (F.col("seq") >= F.col("__reset"))))
    latest = every.groupBy(key, "attr").agg(
        F.max_by("value", F.struct(F.col("seq").isNotNull(), F.col("seq"))).alias("value"))
    bodies = latest.groupBy(key).agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("attr", "value")))).alias("body"))
    # keys alive at the end, also those whose body has become empty
    alive = (table.select(key).unionByName(valid.select(key)).distinct().join(fate, key, "left")
             .filter(~F.coalesce("__dead", F.lit(False))).select(key))
    changed = alive.join(bodies, key, "left").withColumn("body", F.coalesce("body", empty))
    return changed.select(key, "body").unionByName(untouched), rejected


def cap_newest(table: DataFrame, seq: str, size: int) -> DataFrame:
    """Keep the newest ``size`` documents, and those that tie with the last of them.

    ``seq`` is anything with an order.  Ranks are positions in range
    partitions, so one way serves every size.
    """
    if size <= 0:
        return table.limit(0)
    last = global_rank(table.select(seq).filter(F.col(seq).isNotNull()), [F.col(seq).desc()]).filter(F.col("rank") < size)
    return table.filter(F.col(seq) >= last.agg(F.min(seq)).scalar())


def running_total(table: DataFrame, seq: str, value: Column, width: int = RUN_WIDTH) -> DataFrame:
    """``__total``: the sum of ``value`` from the newest row to this one.

    Rows are ranked over range partitions and cut into buckets of ``width``
    ranks, whatever the values of ``seq``; the totals of the newer buckets, one
    row each, are added to the running sum inside a bucket.
    """
    rows = global_rank(table.withColumn("__value", value), [F.col(seq).desc()], "__rank")
    rows = rows.withColumn("__bucket", F.floor(F.col("__rank") / F.lit(width)))
    totals = rows.groupBy("__bucket").agg(F.sum("__value").alias("__sum"))
    newer = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__bucket", F.coalesce(F.sum("__sum").over(newer), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__bucket").orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("__run", F.sum("__value").over(inside))
            .join(offsets, "__bucket")
            .withColumn("__total", F.col("__run") + F.col("__offset"))
            .drop("__bucket", "__run", "__offset", "__value", "__rank"))


def cap_bytes(table: DataFrame, seq: str, size_of: Column, byte_size: int,
              width: int = RUN_WIDTH) -> DataFrame:
    """Keep the newest documents that fit into ``byte_size``."""
    return (running_total(table, seq, size_of, width)
            .filter(F.col("__total") <= byte_size).drop("__total"))


def unique_violations(table: DataFrame, fields: Sequence[str], sparse: bool = False) -> DataFrame:
    """Values of a supposedly unique key that occur more than once."""
    if sparse:
        table = table.dropna(subset=list(fields))
    return (table.groupBy(*fields).agg(F.count(F.lit(1)).alias("n_docs"))
            .filter(F.col("n_docs") > 1))


def retire_pivots(pivots: DataFrame, retired: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace retired pivots by new ones; ids are not used again."""
    return (pivots.join(retired.select("partition").distinct(), "partition", "left_anti")
            .unionByName(fresh.select(*pivots.columns)))
