"""Size-bounded clusters by repeated two-way splits, and their medoids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StringType, StructType

from ..functions.vectors import dot, scale, subtract, sum_vectors
from ..session import ensure_checkpoint_dir
from .embed import matrix_of
from .nearest import PRODUCT_BYTES, SLAB_BYTES, slabs

# A split that leaves one side with less than this share is moved to the median.
LEAST_SHARE = 0.1
# Two-means has converged when no centre moves further than this part of the distance between the two.
CONVERGED = 1e-6
# Clusters of up to this many bytes of vectors are split to the end in one task.
LOCAL_BYTES = 32 << 20


def size_bounded_clusters(df: DataFrame, key: str, max_size: int, dim: int, group: str | None = None,
                          levels: int | None = None, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Add ``cluster``: no cluster has more than ``max_size`` rows of ``vec``.

    A cluster that is too large is divided by two-means until it converges.  The
    centres start at the row of lowest ``key`` and the row furthest from it; a
    side with less than LEAST_SHARE of the rows, as equal vectors or a few far
    ones give, moves the border to the median.  So clusters shrink by a share
    at every level.  With ``group`` every group is clustered on its own.
    Labels are ``<group>:<path>``, the path spelling the sides taken; with
    ``levels`` (1 or more) it has at most that many.

    Clusters above ``local_bytes`` are divided by joins and sums, all of one
    level at a time, and leave the steps as they converge.  A smaller one is
    divided to the end by one task, which holds nothing but its vectors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    start = F.concat(F.col(group).cast("string"), F.lit(":")) if group else F.lit(":")
    active = df.select(key, "vec", start.alias("cluster")).checkpoint()
    most = max(max_size, local_bytes // (8 * max(dim, 1)))
    done, level = [], 0
    while True:
        sizes = active.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n"))
        over = sizes.filter(F.col("__n") > most).select("cluster").checkpoint()
        # few: each has more than ``most`` rows
        over = F.broadcast(over)
        done.append(active.join(over, "cluster", "left_anti").select(key, "vec", "cluster"))
        if level == levels or not over.head(1):
            break
        active = _split(active.join(over, "cluster", "left_semi").select(key, "vec", "cluster").checkpoint(), key, level).checkpoint()
        level += 1
    # rows as deep as they should be are done, whatever their cluster's size
    at_depth = [active] if level == levels else []
    small = reduce(DataFrame.unionByName, done[:-1] if at_depth else done)
    left = F.length(F.substring_index("cluster", ":", -1))

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable")
        depth = None if levels is None else levels - int(rows["__depth"].iloc[0])
        paths = _paths(np.vstack(rows["vec"].to_list()).astype(np.float64), max_size, depth)
        return rows.assign(cluster=rows["cluster"] + paths)[[key, "vec", "cluster"]]

    schema = StructType([df.schema[key], df.schema["vec"]]).add("cluster", StringType())
    divided = small.withColumn("__depth", left).groupBy("cluster").applyInPandas(divide, schema)
    return reduce(DataFrame.unionByName, [divided, *at_depth])


def _paths(m: np.ndarray, max_size: int, levels: int | None) -> np.ndarray:
    """The sides every row takes until no cluster is too large; rows come in the order of their keys."""
    paths = np.full(len(m), "", dtype=object)
    todo = [np.arange(len(m))]
    while todo:
        rows = todo.pop()
        if len(rows) <= max_size or levels is not None and len(paths[rows[0]]) == levels:
            continue
        second = _two_means(m[rows])
        paths[rows] += np.where(second, "1", "0").astype(object)
        todo += [rows[~second], rows[second]]
    return paths


def _two_means(v: np.ndarray) -> np.ndarray:
    """Which rows are on the second side."""
    c = np.vstack([v[:1], v[((v - v[0]) ** 2).sum(axis=1).argmax()][None]])
    while True:
        margin = _margin(v, c)
        second, moved = margin > 0, c.copy()
        for k, side in enumerate((~second, second)):
            if side.any():
                moved[k] = side.astype(np.float64) @ v / side.sum()
        shift, apart = ((moved - c) ** 2).sum(axis=1).max(), ((moved[1] - moved[0]) ** 2).sum()
        c = moved
        if shift <= CONVERGED ** 2 * apart:
            break
    margin = _margin(v, c)
    second = margin > 0
    if LEAST_SHARE <= second.mean() <= 1 - LEAST_SHARE:
        return second
    second = np.zeros(len(v), dtype=bool)
    second[np.argsort(margin, kind="stable")[len(v) // 2:]] = True
    return second


def _margin(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How much closer each row is to the second centre."""
    return 2 * v @ (c[1] - c[0]) - ((c[1] ** 2).sum() - (c[0] ** 2).sum())


# Sums by cluster and side; of side CLOSE the vector counts rows by how far the centres must go until they may change sides.
SUMS = "at int, side int, n long, vec array<double>"
CLOSE, UNSURE = 2, 3
# Ways centres may go, as parts of the distance between them.
REACH = 2.0 ** np.arange(-24, 0.5, 0.5)
# Steps are taken ahead if centres may go this many times as far as in the last one.
AHEAD = 2.0
# A task that takes steps ahead holds up to this many bytes of vectors.
BORDER_BYTES = LOCAL_BYTES


def _split(work: DataFrame, key: str, level: int) -> DataFrame:
    """Every cluster of ``work(key, vec, cluster)`` divided in two.

    The clusters are large ones, so their centres are few: every step sends
    them to the rows, and only sums by task, cluster and side come back.

    Late steps move the centres little, and most rows cannot change sides: as
    long as no centre goes further than ``r``, none whose distances to the two
    differ by more than ``2 r``.  These are summed once; one task per cluster
    takes all further steps with the others, until the centres stand or have
    gone too far.  Each is the step that all rows together would give.
    """
    first = work.groupBy("cluster").agg(F.min_by("vec", key).alias("c0"))
    far = work.join(F.broadcast(first), "cluster").withColumn("__d", _distance2(F.col("vec"), F.col("c0")))
    centres = far.groupBy("cluster").agg(F.first("c0").alias("c0"), F.min_by("vec", F.struct(-F.col("__d"), F.col(key))).alias("c1"))
    rows = centres.orderBy("cluster").collect()
    names = [r["cluster"] for r in rows]
    c, live = np.array([[r["c0"], r["c1"]] for r in rows], dtype=np.float64), np.arange(len(rows))
    spark, border = work.sparkSession, max(1, BORDER_BYTES // (8 * max(c.shape[-1], 1)))
    while len(live):
        shared = spark.sparkContext.broadcast(({names[i]: at for at, i in enumerate(live)}, c[live]))
        sums = work.select("cluster", "vec").mapInArrow(_side_sums(shared), SUMS).collect()
        total, n, close = np.zeros((len(live), *c.shape[1:])), np.zeros((len(live), 2, 1)), np.zeros((len(live), len(REACH)))
        for r in sums:
            if r["side"] == CLOSE:
                close[r["at"]] += r["vec"]
                continue
            total[r["at"], r["side"]] += r["vec"]
            n[r["at"], r["side"]] += r["n"]
        shared.destroy()
        # a side without rows keeps its centre
        before, moved = c[live], np.where(n > 0, total / np.maximum(n, 1), c[live])
        shift, apart = ((moved - before) ** 2).sum(axis=2).max(axis=1), ((moved[:, 1] - moved[:, 0]) ** 2).sum(axis=1)
        c[live] = moved
        # how far centres may go until more rows than a task should hold can change sides
        fits = (np.cumsum(close, axis=1) <= border).sum(axis=1)
        reach = np.where(fits > 0, REACH[fits - 1], 0.0)
        on = ~(shift <= CONVERGED ** 2 * apart)
        ahead = on & (reach ** 2 * ((before[:, 1] - before[:, 0]) ** 2).sum(axis=1) > AHEAD ** 2 * shift)
        if ahead.any():
            there = live[ahead]
            shared = spark.sparkContext.broadcast((
                {names[i]: at for at, i in enumerate(there)}, before[ahead], moved[ahead], reach[ahead]))
            steps = work.select("cluster", "vec").mapInArrow(_border(shared), SUMS).groupBy("at").applyInPandas(
                _steps(shared), "at int, c0 array<double>, c1 array<double>, stands boolean").collect()
            for r in steps:
                c[there[r["at"]]] = [r["c0"], r["c1"]]
                on[np.flatnonzero(ahead)[r["at"]]] = not r["stands"]
            shared.destroy()
        live = live[on]
    shared = spark.sparkContext.broadcast(({name: at for at, name in enumerate(names)}, c))
    schema = StructType([work.schema[key], work.schema["vec"], work.schema["cluster"]]).add("__m", DoubleType())
    rows = work.select(key, "vec", "cluster").mapInArrow(_with_margin(shared), schema)
    # for an uneven split the border is the median; rows on it, equal vectors among them, are divided by a hash
    share = F.avg((F.col("__m") > 0).cast("double"))
    limits = rows.groupBy("cluster").agg(F.when(share.between(LEAST_SHARE, 1 - LEAST_SHARE), 0.0).otherwise(
        F.percentile_approx("__m", 0.5, 1000)).alias("__t"), share.between(LEAST_SHARE, 1 - LEAST_SHARE).alias("__even"))
    coin = F.pmod(F.xxhash64(key, F.lit(-1 - level)), F.lit(2)) == 1
    second = (F.col("__m") > F.col("__t")) | (~F.col("__even") & (F.col("__m") == F.col("__t")) & coin)
    return rows.join(F.broadcast(limits), "cluster").select(
        key, "vec", F.concat("cluster", F.when(second, "1").otherwise("0")).alias("cluster"))


def _distance2(a: Column, b: Column) -> Column:
    apart = subtract(a, b)
    return dot(apart, apart)


def _margins(batch: pa.RecordBatch, places: dict[str, int], c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows in the clusters ``places`` has: which they are, their cluster's place, vector and margin."""
    codes = batch.column("cluster").dictionary_encode()
    own = np.array([places.get(name, -1) for name in codes.dictionary.to_pylist()], dtype=np.int64)
    at = own[codes.indices.to_numpy()] if len(batch) else np.zeros(0, dtype=np.int64)
    here = np.flatnonzero(at >= 0)
    at, v = at[here], matrix_of(batch.column("vec").take(pa.array(here)), c.shape[2])
    margin = np.empty(len(at))
    for k in np.unique(at):
        mine = at == k
        margin[mine] = _margin(v[mine], c[k])
    return here, at, v, margin


def _reach(v: np.ndarray, margin: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How far the centres can go, as a part of their distance, before a row may change sides; a little less for rounding."""
    d = [np.sqrt(np.maximum(((v - x) ** 2).sum(axis=1), 0)) for x in c]
    apart = np.sqrt(((c[1] - c[0]) ** 2).sum())
    return np.abs(margin) / np.maximum(2 * (d[0] + d[1]) * apart, np.finfo(float).tiny) * (1 - 1e-6) if apart > 0 else np.zeros(len(v))


def _sums_batch(at, side, n, vec) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int32()), pa.array(side, pa.int32()), pa.array(n, pa.int64()), pa.array(list(vec), type=pa.list_(pa.float64()))],
        names=["at", "side", "n", "vec"])


def _border(shared):
    """Sums of the rows that keep their sides while the centres stay in reach, and the other rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, c, _, reach = shared.value
        sums, n = np.zeros((2 * len(c), c.shape[2])), np.zeros(2 * len(c), dtype=np.int64)
        for batch in batches:
            _, at, v, margin = _margins(batch, places, c)
            for k in np.unique(at):
                mine = np.flatnonzero(at == k)
                sure = _reach(v[mine], margin[mine], c[k]) > reach[k]
                for side in (0, 1):
                    kept = mine[sure & ((margin[mine] > 0) == side)]
                    sums[2 * k + side] += v[kept].sum(axis=0)
                    n[2 * k + side] += len(kept)
                rest = v[mine[~sure]]
                yield _sums_batch([k] * len(rest), [UNSURE] * len(rest), [1] * len(rest), rest)
        used = np.flatnonzero(n)
        yield _sums_batch(used // 2, used % 2, n[used], sums[used])
    return run


def _steps(shared):
    """Steps of one cluster until its centres stand or leave their reach."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _, start, after, reach = shared.value
        k = int(rows["at"].iloc[0])
        free = (rows["side"] == UNSURE).to_numpy()
        dim = start.shape[2]
        v = np.vstack([np.zeros((0, dim)), *rows["vec"][free]])
        sums, n = np.zeros((2, dim)), np.zeros((2, 1))
        for r in rows[~free].itertuples():
            sums[r.side] += r.vec
            n[r.side] += r.n
        c, far = after[k], (reach[k] ** 2) * ((start[k][1] - start[k][0]) ** 2).sum()
        while True:
            second = _margin(v, c) > 0
            total = sums + [v[~second].sum(axis=0), v[second].sum(axis=0)]
            size = n + [[(~second).sum()], [second.sum()]]
            moved = np.where(size > 0, total / np.maximum(size, 1), c)
            stands = ((moved - c) ** 2).sum(axis=1).max() <= CONVERGED ** 2 * ((moved[1] - moved[0]) ** 2).sum()
            c = moved
            if stands or not ((c - start[k]) ** 2).sum(axis=1).max() <= far:
                return pd.DataFrame({"at": [k], "c0": [c[0]], "c1": [c[1]], "stands": [bool(stands)]})
    return run


def _side_sums(shared):
    """Sums of the vectors by cluster and side, one row for each in a task, and how many rows are close to the border."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, c = shared.value
        sums, n = np.zeros((2 * len(c), c.shape[2])), np.zeros(2 * len(c), dtype=np.int64)
        close = np.zeros((len(c), len(REACH) + 1))
        for batch in batches:
            _, at, v, margin = _margins(batch, places, c)
            for k in np.unique(at):
                mine = at == k
                close[k] += np.bincount(np.searchsorted(REACH, _reach(v[mine], margin[mine], c[k])), minlength=len(REACH) + 1)
            side = 2 * at + (margin > 0)
            for k in np.unique(side):
                mine = side == k
                sums[k] += v[mine].sum(axis=0)
                n[k] += mine.sum()
        used = np.flatnonzero(n)
        yield _sums_batch(used // 2, used % 2, n[used], sums[used])
        yield _sums_batch(range(len(c)), [CLOSE] * len(c), [0] * len(c), close[:, :-1])
    return run


def _with_margin(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, c = shared.value
        for batch in batches:
            here, _, _, margin = _margins(batch, places, c)
            rows = batch.take(pa.array(here))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(margin)], names=[*rows.schema.names, "__m"])
    return run


def centres_of(df: DataFrame, cluster: str) -> DataFrame:
    return sum_vectors(df, [cluster]).select(cluster, "size", scale(F.col("vec"), 1 / F.col("size")).alias("vec"))


def medoids(rows: DataFrame, centres: DataFrame, key: str, cluster: str, limit: int = SLAB_BYTES) -> DataFrame:
    """``(cluster, key, distance2)``: the row nearest to each centre, ties to the lowest key.

    Centres pass by the rows in slabs; a task keeps its best row per centre, so
    at most one row per centre and task is moved.
    """
    schema = StructType([centres.schema[cluster], rows.schema[key]]).add("distance2", DoubleType())

    def nearest(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, columns = shared.value
            norms, names = (m * m).sum(axis=1), columns[cluster]
            best, who = np.full(len(m), np.inf), np.full(len(m), None, dtype=object)
            for batch in batches:
                v, keys = matrix_of(batch.column("vec"), m.shape[1]), np.array(batch.column(key).to_pylist(), dtype=object)
                order = np.argsort(keys, kind="stable")
                v, keys = v[order], keys[order]
                step = max(1, PRODUCT_BYTES // (8 * len(m)))
                for at in range(0, len(v), step):
                    part = v[at:at + step]
                    d = norms[None] - 2 * part @ m.T + (part * part).sum(axis=1)[:, None]
                    j = d.argmin(axis=0)
                    low, name = d[j, np.arange(len(m))], keys[at + j]
                    for c in np.flatnonzero(low <= best):
                        if low[c] < best[c] or name[c] < who[c]:
                            best[c], who[c] = low[c], name[c]
            got = np.flatnonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays(
                [pa.Array.from_pandas(names[got], type=to_arrow_type(schema[0].dataType)),
                 pa.array(who[got].tolist(), type=to_arrow_type(schema[1].dataType)), pa.array(best[got])], names=schema.names)
        return run

    vectors = rows.select(key, "vec").filter(F.col("vec").isNotNull())
    parts = [vectors.mapInArrow(nearest(shared), schema) for shared in slabs(centres, cluster, cluster, limit=limit)]
    if not parts:
        return rows.sparkSession.createDataFrame([], schema)
    least = F.min(F.struct("distance2", key))
    return (reduce(DataFrame.unionByName, parts).groupBy(cluster).agg(least.alias("b"))
            .select(cluster, F.col(f"b.{key}").alias(key), F.col("b.distance2").alias("distance2")))


def cluster_medoids(clustered: DataFrame, key: str, cluster: str) -> DataFrame:
    """The row of each cluster nearest to its centre, so no row stands for two clusters."""
    centres = centres_of(clustered, cluster).withColumnRenamed("vec", "__centre")
    apart = subtract(F.col("vec"), F.col("__centre"))
    scored = clustered.join(centres, cluster).withColumn("__d", F.round(dot(apart, apart), 12))
    return scored.groupBy(cluster).agg(
        F.min(F.struct("__d", key)).getField(key).alias(key), F.min_by("vec", F.struct("__d", key)).alias("vec"),
        F.first("size").alias("nDocs"))
