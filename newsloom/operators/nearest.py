"""Nearest pivots, partition ranking and dot products between two tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from .embed import matrix_of

# Vectors that go to every executor at a time; a larger table goes in several slabs.
SLAB_BYTES = 64 << 20
# Bytes of one matrix product inside a task.
PRODUCT_BYTES = 64 << 20
# Rows a task holds of either side in a blocked product.
CELL = 1024


def slabs(right: DataFrame, ident: str, order: str, columns: Sequence[str] = (), limit: int = SLAB_BYTES):
    """The rows of ``right`` in parts of about ``limit`` bytes of vectors, as broadcasts of ``(matrix, {column: values})``.

    A part is sorted by ``order``.  The driver holds one part at a time.
    """
    n, dim = right.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).head()
    parts = max(1, -(-n * dim * 8 // limit))
    chosen = list(dict.fromkeys([ident, order, *columns]))
    for i in range(parts if n else 0):
        part = right if parts == 1 else right.filter(F.pmod(F.xxhash64(ident), F.lit(parts).cast("long")) == i)
        rows = part.select("vec", *chosen).orderBy(order).toPandas()
        if len(rows):
            matrix = np.vstack(rows["vec"].to_list()).astype(np.float64)
            yield right.sparkSession.sparkContext.broadcast((matrix, {c: rows[c].to_numpy() for c in chosen}))


def _products(v: np.ndarray, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Products of the rows of ``v`` with ``m``, a bounded number of rows at a time, with the first row's place."""
    step = max(1, PRODUCT_BYTES // (8 * max(1, len(m))))
    for at in range(0, len(v), step):
        yield at, v[at:at + step] @ m.T


def nearest_pivot(df: DataFrame, pivots: DataFrame, order: str = "partition", limit: int = SLAB_BYTES) -> DataFrame:
    """Add ``partition`` and ``similarity`` of the pivot with the largest dot product.

    ``pivots(partition, vec)``; ties go to the lowest ``order``.  Rows need a
    non-null ``vec``.  No row is moved: pivots pass by in slabs of ``limit``
    bytes, and a row carries the best one so far.
    """
    carried = StructType(list(df.schema.fields)).add("partition", LongType()).add("similarity", DoubleType()).add("__order", LongType())
    out = None
    for shared in slabs(pivots, "partition", order, limit=limit):
        out = (df if out is None else out).mapInArrow(_best_so_far(shared, order, len(df.columns)), carried)
    if out is None:
        raise ValueError("no pivots")
    return out.drop("__order")


def _best_so_far(shared, order: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, columns = shared.value
        ids, places = columns["partition"].astype(np.int64), columns[order].astype(np.int64)
        for batch in batches:
            v = matrix_of(batch.column("vec"), m.shape[1])
            best, sims = np.zeros(len(v), dtype=np.int64), np.zeros(len(v))
            for at, s in _products(v, m):
                best[at:at + len(s)] = s.argmax(axis=1)
                sims[at:at + len(s)] = s.max(axis=1)
            found, placed = ids[best], places[best]
            if batch.num_columns > width:  # later slabs
                old, was, where = (batch.column(width + k).to_numpy() for k in range(3))
                keep = (was > sims) | ((was == sims) & (where < placed))
                found, sims, placed = np.where(keep, old, found), np.where(keep, was, sims), np.where(keep, where, placed)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:width] + [pa.array(found), pa.array(sims), pa.array(placed)],
                names=batch.schema.names[:width] + ["partition", "similarity", "__order"])

    return run


def best_products(left: DataFrame, right: DataFrame, left_id: str, right_id: str, order: str, carry: Sequence[str] = (),
                  top: int | None = None, absolute: bool = False, limit: int = SLAB_BYTES) -> DataFrame:
    """``(left_id, right_id, *carry, similarity)``: per left row the ``top`` right rows of every slab, ties at the end kept.

    The caller takes the best of all; a left row meets at most ``top`` rows and
    their ties for each slab of ``right``.  ``absolute`` ranks by size.
    """
    left = left.select(left_id, "vec").filter(F.col("vec").isNotNull())
    keep = list(dict.fromkeys([right_id, *carry]))
    schema = StructType([left.schema[left_id]] + [right.schema[c] for c in keep]).add("similarity", DoubleType())
    kinds = {c: to_arrow_type(right.schema[c].dataType) for c in keep}

    def best(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, columns = shared.value
            for batch in batches:
                for at, s in _products(matrix_of(batch.column("vec"), m.shape[1]), m):
                    rank = np.abs(s) if absolute else s
                    if top is None or top >= s.shape[1]:
                        i, j = (g.ravel() for g in np.indices(s.shape))
                    else:
                        last = -np.partition(-rank, top - 1, axis=1)[:, top - 1:top]
                        i, j = np.nonzero(rank >= last)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(left_id).take(pa.array(at + i)),
                         *[pa.Array.from_pandas(columns[c][j], type=kinds[c]) for c in keep], pa.array(s[i, j])],
                        names=schema.names)
        return run

    parts = [left.mapInArrow(best(shared), schema) for shared in slabs(right, right_id, order, carry, limit)]
    return reduce(DataFrame.unionByName, parts) if parts else left.sparkSession.createDataFrame([], schema)


def rank_partitions(queries: DataFrame, pivots: DataFrame, key: str, budget: int | str | None = None,
                    keep_vec: bool = False, limit: int = SLAB_BYTES, after: str | None = None) -> DataFrame:
    """Partitions of every query by descending similarity: ``(key, partition, similarity, rank)``.

    Equal similarities go to the higher partition id.  With ``budget`` the list
    ends once the partitions before hold that many documents (``nDocs``): of
    every slab only the partitions within the budget leave the task.  The
    budget may be a column of ``queries``, so may the rank ``after`` which the
    list begins.
    """
    counted = pivots if "nDocs" in pivots.columns else pivots.withColumn("nDocs", F.lit(0).cast("long"))
    most = F.col(budget) if isinstance(budget, str) else F.lit((1 << 62) if budget is None else budget)
    queries = (queries.filter(F.col("vec").isNotNull()).select(
        key, "vec", most.cast("long").alias("__most"), (F.col(after) if after else F.lit(0)).cast("int").alias("__after")))
    schema = StructType([queries.schema[key]]).add("partition", LongType()).add("similarity", DoubleType()).add(
        "rank", IntegerType()).add("nDocs", LongType()).add("__most", LongType()).add("__after", IntegerType())
    if keep_vec:
        schema = schema.add("vec", queries.schema["vec"].dataType)

    def ranked(shared, alone: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, columns = shared.value
            ids, sizes = columns["partition"].astype(np.int64), columns["nDocs"].astype(np.int64)
            for batch in batches:
                mosts, afters = batch.column("__most").to_numpy(), batch.column("__after").to_numpy()
                for at, s in _products(matrix_of(batch.column("vec"), m.shape[1]), m):
                    # ids ascend, so the reverse of a stable ascending order puts the higher id first
                    order = np.argsort(s, axis=1, kind="stable")[:, ::-1]
                    end = at + len(s)
                    keep = np.cumsum(sizes[order], axis=1) - sizes[order] < mosts[at:end, None]
                    if alone:
                        keep &= np.arange(s.shape[1]) >= afters[at:end, None]
                    row, rank = np.nonzero(keep)
                    place = order[row, rank]
                    take = pa.array(at + row)
                    own = [batch.column(key).take(take), pa.array(ids[place]), pa.array(s[row, place]),
                           pa.array(rank + 1, type=pa.int32()), pa.array(sizes[place]),
                           batch.column("__most").take(take), batch.column("__after").take(take)]
                    yield pa.RecordBatch.from_arrays(own + ([batch.column("vec").take(take)] if keep_vec else []), names=schema.names)
        return run

    shared = list(slabs(counted, "partition", "partition", ["nDocs"], limit))
    parts = [queries.mapInArrow(ranked(one, len(shared) == 1), schema) for one in shared]
    out = reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], schema)
    if len(parts) > 1:
        order = Window.partitionBy(key).orderBy(F.col("similarity").desc(), F.col("partition").desc())
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("rank", F.row_number().over(order)).withColumn("__seen", F.coalesce(F.sum("nDocs").over(before), F.lit(0)))
        out = out.filter((F.col("__seen") < F.col("__most")) & (F.col("rank") > F.col("__after"))).drop("__seen")
    return out.drop("nDocs", "__most", "__after")


def blocked_dot(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str,
                carry: Sequence[str] = (), best_of: str | None = None, top: int | None = None,
                cell: int = CELL) -> DataFrame:
    """Dot products of the rows of two tables that share ``on``.

    Both sides are cut into cells of about ``cell`` rows per key, so a key of
    any size is worked by many tasks; each does one matrix product.  ``carry``
    names right columns to keep.  With ``best_of`` only the best right row per
    left row and cell is returned, ties to the lowest ``best_of``; with ``top``
    the best ``top`` of each cell, from which the caller takes the best of all.
    """
    on = list(on)

    def cells(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(cell)).cast("int").alias(name))

    # keys of one side only drop out here, before any vector is moved
    grid = cells(left, "__nl").join(cells(right, "__nr"), on)

    def place(df: DataFrame, ident: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        return (df.join(grid, on)
                .withColumn(own, F.pmod(F.xxhash64(ident), F.col(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
                .drop("__nl", "__nr"))

    keep = list(carry) + ([best_of] if best_of else [])
    keys = on + ["__l", "__r"]
    a = place(left.select(*on, left_id, "vec"), left_id, "__l", "__nl", "__r", "__nr")
    b = place(right.select(*on, right_id, *keep, "vec"), right_id, "__r", "__nr", "__l", "__nl")
    schema = StructType([left.schema[c] for c in on] + [left.schema[left_id], right.schema[right_id]]
                        + [right.schema[c] for c in keep]).add("similarity", DoubleType())

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame(columns=schema.names)
        if best_of:
            y = y.sort_values(best_of, kind="stable")
        s = np.vstack(x["vec"].to_list()) @ np.vstack(y["vec"].to_list()).T
        if best_of:
            i, j = np.arange(len(x)), s.argmax(axis=1)
        elif top is not None and top < s.shape[1]:
            j = np.argpartition(-s, top - 1, axis=1)[:, :top]
            # keep everything equal to the last one taken, so that no tie is cut here
            last = np.take_along_axis(s, j, axis=1).min(axis=1, keepdims=True)
            i, j = np.nonzero(s >= last)
        else:
            i, j = (g.ravel() for g in np.indices(s.shape))
        out = {c: x[c].to_numpy()[i] for c in on}
        out[left_id] = x[left_id].to_numpy()[i]
        for c in [right_id, *keep]:
            out[c] = y[c].to_numpy()[j]
        out["similarity"] = s[i, j]
        return pd.DataFrame(out)

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(product, schema)
