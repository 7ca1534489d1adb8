"""Property graphs: definitions, edge checks, traversal.

Vertices are named ``collection/key``; edges are ``(_key, _from, _to, ...)``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir
from .ranking import global_rank

# Edges of a vertex with a large share of all are spread over this many tasks when a frontier meets them.
SALTS = 8
# Vertices are counted by hash in so many buckets; one of more edges than this, and than this part of all, is spread.
BUCKETS, CROWDED, CROWDED_PART = 1 << 16, 10_000, 1000


def collection_of(vertex: Column) -> Column:
    return F.split_part(vertex, F.lit("/"), F.lit(1))


def invalid_edges(edges: DataFrame, definitions: DataFrame, edge_coll: str, vertices: DataFrame | None = None) -> DataFrame:
    """Edges an edge definition does not allow, with a ``reason``.

    ``definitions(edge_coll, from_colls, to_colls)`` is a handful of rows; with
    ``vertices(_id)`` both ends must exist.
    """
    allowed = definitions.filter(F.col("edge_coll") == edge_coll)
    froms = allowed.select(F.explode("from_colls").alias("__c")).distinct().withColumn("__from_ok", F.lit(True))
    tos = allowed.select(F.explode("to_colls").alias("__c")).distinct().withColumn("__to_ok", F.lit(True))
    out = (edges.withColumn("__c", collection_of(F.col("_from"))).join(froms, "__c", "left").drop("__c")
           .withColumn("__c", collection_of(F.col("_to"))).join(tos, "__c", "left").drop("__c"))
    reason = (F.when(F.col("_from").isNull() | F.col("_to").isNull(), "missing end")
              .when(F.col("__from_ok").isNull(), "from not allowed").when(F.col("__to_ok").isNull(), "to not allowed"))
    if vertices is not None:
        known = vertices.select(F.col("_id").alias("__id"), F.lit(True).alias("__known"))
        out = out.join(known.withColumnsRenamed({"__id": "_from", "__known": "__kf"}), "_from", "left")
        out = out.join(known.withColumnsRenamed({"__id": "_to", "__known": "__kt"}), "_to", "left")
        reason = reason.when(F.col("__kf").isNull(), "from unknown").when(F.col("__kt").isNull(), "to unknown")
    return out.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*edges.columns, "reason")


def vertex_collections(definitions: DataFrame, orphans: DataFrame) -> DataFrame:
    """``(collection, orphan)``: those of the definitions, and the orphans among the rest."""
    used = (definitions.select(F.explode("from_colls").alias("collection"))
            .union(definitions.select(F.explode("to_colls"))).distinct())
    alone = orphans.select("collection").distinct().join(used, "collection", "left_anti")
    return used.withColumn("orphan", F.lit(False)).unionByName(alone.withColumn("orphan", F.lit(True)))


def remove_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices without those of ``gone(_id)``, and the edges without those that touch one of them."""
    gone = gone.select("_id").filter(F.col("_id").isNotNull()).distinct()
    left = edges
    for end in ("_from", "_to"):
        left = left.join(gone.withColumnRenamed("_id", end), end, "left_anti").select(*edges.columns)
    return vertices.join(gone, "_id", "left_anti").select(*vertices.columns), left


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select("_key", F.col("_from").alias("at"), F.col("_to").alias("next"))
    back = edges.select("_key", F.col("_to").alias("at"), F.col("_from").alias("next"))
    if direction == "outbound":
        return out
    if direction == "inbound":
        return back
    if direction == "any":
        return out.unionByName(back.filter(F.col("at") != F.col("next")))
    raise ValueError(f"unknown direction {direction!r}")


def traverse(starts: DataFrame, edges: DataFrame, direction: str = "outbound", min_depth: int = 0,
             max_depth: int | None = None, unique_vertices: str = "path", unique_edges: str = "path",
             edge_filter: Column | None = None, vertices: DataFrame | None = None,
             vertex_filter: Column | None = None, prune: Column | None = None,
             max_iterations: int | None = None, siblings: Sequence[Column] | None = None) -> DataFrame:
    """Walk from many start vertices at once: ``(start, vertex, depth, path, edge_path)``.

    ``unique_*`` is ``none``, ``path`` or ``global`` (once per start).  Without
    ``max_depth`` one of them must not be ``none``.  ``edge_filter`` picks edges
    to follow, ``vertex_filter`` rows to report, ``prune`` vertices not to go on
    from; the last two may use the columns of ``vertices(_id, ...)``.

    The frontier moves one level per round.  Where a vertex has a large share
    of all edges it is salted against them, so that is no single task's work;
    the other rows move once.  A walk that is not over after ``max_iterations`` rounds, if given, is an error.
    """
    if max_depth is None and "none" == unique_vertices == unique_edges:
        raise ValueError("an unbounded walk needs unique vertices or edges")
    ensure_checkpoint_dir(edges.sparkSession)
    steps = _steps(edges if edge_filter is None else edges.filter(edge_filter), direction)
    # such steps are never taken; said here, the steps of all levels are one exchange
    for unique, what in ((unique_vertices, "next"), (unique_edges, "_key")):
        if unique == "path":
            steps = steps.filter(F.col(what).isNotNull())
    crowded = _crowded(steps)
    steps = steps.withColumn("__salt", F.when(crowded(F.col("at")), F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(crowded(F.col("vertex")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))

    level = starts.select(F.col("_id").alias("start"), F.col("_id").alias("vertex"), F.lit(0).alias("depth"),
                          F.array("_id").alias("path"), F.array().cast("array<string>").alias("edge_path"))
    own: list[Column] = []
    if siblings is not None:
        places = _places(vertices, siblings)
        # a vertex that is not in the table stands behind those that are, by name
        def placed(df: DataFrame, vertex: str) -> DataFrame:
            unlisted = F.concat(F.lit("~"), _ended(F.col(vertex))).cast("binary")
            return (df.join(places.withColumnRenamed("_id", vertex), vertex, "left")
                    .withColumn("__place", F.coalesce("__place", unlisted)))

        steps = placed(steps, "next")
        level = placed(level, "vertex").select(*level.columns, F.col("__place").alias("order_key"))
        own = [F.concat("order_key", "__place").alias("order_key")]
    levels, depth = [], 0
    while True:
        levels.append(level)
        depth += 1
        if max_depth is not None and depth > max_depth:
            break
        if max_iterations is not None and depth > max_iterations:
            raise RuntimeError(f"the walk goes on after {max_iterations} rounds")
        live = level
        if prune is not None:
            live = _annotated(level, vertices).filter(~F.coalesce(prune, F.lit(False))).select(*level.columns)
        # the path tells the start
        moved = (live.drop("start", "depth").withColumn("__salt", F.explode(salts))
                 .join(steps.withColumnRenamed("at", "vertex"), ["vertex", "__salt"]))
        if unique_vertices == "path":
            moved = moved.filter(~F.array_contains("path", F.col("next")))
        if unique_edges == "path" and depth > 1:
            moved = moved.filter(~F.array_contains("edge_path", F.col("_key")))
        level = moved.select(F.get("path", F.lit(0)).alias("start"), F.col("next").alias("vertex"), F.lit(depth).alias("depth"),
                             F.concat("path", F.array("next")).alias("path"),
                             F.concat("edge_path", F.array("_key")).alias("edge_path"), *own)
        if unique_edges == "global":
            last = F.element_at("edge_path", -1)
            level = _once(level.withColumn("__e", last), "__e",
                          [x.withColumn("__e", F.try_element_at("edge_path", F.lit(-1))) for x in levels]).drop("__e")
        if unique_vertices == "global":
            level = _once(level, "vertex", levels)
        if max_depth is None or 2 < depth < max_depth:
            # bounded lineage: a level is read by the next one and by the result; the last one by the result alone
            level = level.checkpoint()
            if not level.head(1):
                break
    walked = reduce(DataFrame.unionByName, levels).filter(F.col("depth") >= min_depth)
    if vertex_filter is not None:
        walked = _annotated(walked, vertices).filter(vertex_filter).select(*levels[0].columns)
    return walked


def _crowded(steps: DataFrame) -> Callable[[Column], Column]:
    """Whether a vertex is in a bucket with a large share of all steps; at most CROWDED_PART buckets are."""
    bucket = lambda vertex: F.pmod(F.xxhash64(vertex), F.lit(BUCKETS))
    counts = steps.groupBy(bucket(F.col("at")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(CROWDED), F.sum("n").over(Window.partitionBy()) / CROWDED_PART)
    full = [r["bucket"] for r in counts.withColumn("least", least).filter("n > least").select("bucket").collect()]
    return lambda vertex: bucket(vertex).isin(full) if full else F.lit(False)


def _annotated(level: DataFrame, vertices: DataFrame | None) -> DataFrame:
    if vertices is None:
        return level
    return level.join(vertices.withColumnRenamed("_id", "vertex"), "vertex", "left")


def _once(level: DataFrame, what: str, earlier: list[DataFrame]) -> DataFrame:
    """One row per start and value, and none an earlier level had."""
    columns = [c for c in level.columns if c not in ("start", what)]
    first = level.groupBy("start", what).agg(F.min(F.struct("path", *[c for c in columns if c != "path"])).alias("__r"))
    seen = reduce(DataFrame.union, [x.select("start", what) for x in earlier])
    kept = first.join(seen, ["start", what], "left_anti")
    return kept.select("start", what, *[F.col(f"__r.{c}").alias(c) for c in columns]).select(*level.columns)


def _places(vertices: DataFrame, siblings: Sequence[Column]) -> DataFrame:
    """``(_id, __place)``: the rank of every vertex as bytes of one length, so that ranks compare as bytes do."""
    ranked = global_rank(vertices.dropDuplicates(["_id"]), [*siblings, F.col("_id")], "__rank")
    return ranked.select("_id", F.lpad(F.hex("__rank"), 16, "0").cast("binary").alias("__place"))


def path_key(path: Column, postorder: bool = False) -> Column:
    """The path as bytes that sort as the path does: a prefix before what goes on from it, or behind it in post-order.

    Every name ends in two zero bytes; one inside a name is followed by another
    byte.  No name holds the byte that closes a post-order key.
    """
    return _closed(F.array_join(F.transform(path, _ended), "").cast("binary"), postorder)


def _ended(vertex: Column) -> Column:
    return F.concat(F.replace(vertex, F.lit("\0"), F.lit("\0\1")), F.lit("\0\0"))


def _closed(key: Column, postorder: bool) -> Column:
    return F.concat(key, F.unhex(F.lit("FF"))) if postorder else key


def _visit_keys(walked: DataFrame, strategy: str, order: str) -> list[Column]:
    if order not in ("preorder", "postorder"):
        raise ValueError(f"unknown order {order!r}")
    post = order == "postorder"
    key = _closed(F.col("order_key"), post) if "order_key" in walked.columns else path_key(F.col("path"), post)
    if strategy == "breadthfirst":
        return [F.col("depth"), key]
    if strategy == "depthfirst":
        return [key]
    raise ValueError(f"unknown strategy {strategy!r}")


def in_order(walked: DataFrame, strategy: str = "depthfirst", order: str = "preorder", backward: bool = False) -> DataFrame:
    """The walk sorted by start and visiting order, over range partitions; siblings go by name or by ``order_key``."""
    keys = [F.col("start"), *_visit_keys(walked, strategy, order)]
    return walked.orderBy(*[k.desc() if backward else k.asc() for k in keys])


def visited(walked: DataFrame, name: str = "position", strategy: str = "depthfirst", order: str = "preorder",
            backward: bool = False) -> DataFrame:
    """The walk with the place of every visit among those of its start, from 1.

    Visits are ranked over range partitions of start and path, so the walk of
    one start is the work of many tasks; a place is the rank less that of the
    start's first visit.  Visits alike in path (over other edges) go by edges.
    """
    keys = [*_visit_keys(walked, strategy, order), F.array_join("edge_path", "\0")]
    ranked = global_rank(walked, [F.col("start"), *[k.desc() if backward else k.asc() for k in keys]], "__rank")
    first = ranked.groupBy("start").agg(F.min("__rank").alias("__first"))
    return ranked.join(first, "start").withColumn(name, F.col("__rank") - F.col("__first") + 1).drop("__rank", "__first")


class Fold(NamedTuple):
    """A value folded over a walk: a visit's own, how those of its children are put together, and how both make its own."""

    own: Column
    children: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]


def fold(walked: DataFrame, vertices: DataFrame, folds: Mapping[str, Fold]) -> DataFrame:
    """The walk with a column per fold: what its visitor makes of every visit and all below it.

    Works from the deepest level up: children are aggregated by their parent
    (an aggregate of Spark, so a parent with a large share of all children is
    no single task's work), and merged with the parent's own value, which may
    use the columns of ``vertices(_id, ...)``.  A visit without children merges
    with null.  A visit whose parent is not in the walk is folded by itself.
    """
    ensure_checkpoint_dir(walked.sparkSession)
    # a visit is known by its start and the edges it came over
    rows = walked.withColumn("__id", F.array_join("edge_path", "\0")).withColumn(
        "__parent", F.array_join(F.slice("edge_path", 1, F.greatest(F.size("edge_path") - 1, F.lit(0))), "\0"))
    rows = (rows.join(vertices.withColumnRenamed("_id", "vertex"), "vertex", "left")
            .select(*rows.columns, *[f.own.alias(n) for n, f in folds.items()]).checkpoint())
    least, most = rows.agg(F.min("depth"), F.max("depth")).head()
    below, done = None, []
    for depth in range(most, least - 1, -1) if most is not None else ():
        level = rows.filter(F.col("depth") == depth)
        kids = [F.col(f"__below_{n}") for n in folds]
        if below is None:
            level = level.withColumns({f"__below_{n}": F.lit(None).cast(level.schema[n].dataType) for n in folds})
        else:
            up = below.groupBy("start", F.col("__parent").alias("__id")).agg(*[f.children(F.col(n)).alias(f"__below_{n}") for n, f in folds.items()])
            level = level.join(up, ["start", "__id"], "left")
        level = level.withColumns({n: f.merge(F.col(n), k) for (n, f), k in zip(folds.items(), kids)}).drop(*[f"__below_{n}" for n in folds])
        below = level.select(*rows.columns).checkpoint()
        done.append(below)
    return (reduce(DataFrame.unionByName, done) if done else rows).drop("__id", "__parent")


def link_graph(docs: DataFrame) -> DataFrame:
    """Edges from every page to its links; ``docs(URL, links)``."""
    edges = docs.select(F.col("URL").alias("_from"), F.explode("links").alias("_to")).distinct()
    return edges.select(F.md5(F.concat_ws(" ", "_from", "_to")).alias("_key"), "_from", "_to")
