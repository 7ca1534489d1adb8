"""Near-duplicate vectors through an inverted multi-index.

Vectors are cut in halves, and each half has a codebook of its own; the pairs
of codewords are the cells of a grid.  Every vector lies in one cell and looks
for its neighbours in the cells that come first in the order of the summed
distances to both codewords.  How many cells to visit is read from the sample
the codebooks are fitted on, so that the recall asked for is reached there.
Whatever two vectors meet in a cell is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, settle

COSINE = 0.93
# Vectors the codebooks and the number of visited cells are fitted on, chosen by a hash of their id.
SAMPLE_ROWS = 4000
# Share of the pairs over the threshold that the visited cells must hold on the sample.
RECALL = 0.999
# Vectors per cell aimed at, and the most codewords of a half.
CELL_ROWS, MOST_WORDS = 8, 256
# Perturbed copies of each sampled vector that stand for its neighbours when the visits are fitted.
TRIALS = 4
# Rows of a block of a cell on either side.
BLOCK = 1024


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best = _distances(x, centres).argmin(axis=1)
        for j in range(k):
            if (best == j).any():
                centres[j] = x[best == j].mean(axis=0)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None]


def multi_sequence(a: np.ndarray, b: np.ndarray, visits: int) -> np.ndarray:
    """For every row the ``visits`` cells of smallest ``a[i] + b[j]``, nearest first.

    With both halves sorted, the cell in place (i, j) of a row has at least
    (i + 1)(j + 1) cells before or at it, so only places whose product is at
    most ``visits`` can be among them.
    """
    ia, ib = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
    sa, sb = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
    places = np.array([(i, j) for i in range(min(a.shape[1], visits)) for j in range(min(b.shape[1], visits // (i + 1)))])
    total = sa[:, places[:, 0]] + sb[:, places[:, 1]]
    order = total.argsort(axis=1, kind="stable")[:, :visits]
    return ia[np.arange(len(a))[:, None], places[order, 0]] * b.shape[1] + ib[np.arange(len(a))[:, None], places[order, 1]]


class Grid:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float, recall: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        words = int(np.clip(round((max(rows, 1) / CELL_ROWS) ** .5), 1, min(MOST_WORDS, max(1, len(sample)))))
        half = sample.shape[1] // 2
        self.half = half
        self.left = _kmeans(sample[:, :half], words, rng) if len(sample) else np.zeros((1, half))
        self.right = _kmeans(sample[:, half:], words, rng) if len(sample) else np.zeros((1, sample.shape[1] - half))
        self.visits = self._fit(sample, cosine, recall, rng)

    def _distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, :self.half], self.left), _distances(x[:, self.half:], self.right)

    def _fit(self, sample: np.ndarray, cosine: float, recall: float, rng: np.random.Generator) -> int:
        """Visits after which a vector just over the threshold is found, in the share ``recall`` of all trials.

        A pair is found if either vector visits the cell of the other.
        """
        cells = len(self.left) * len(self.right)
        if len(sample) == 0 or cells == 1:
            return cells
        x = np.repeat(sample, TRIALS, axis=0)
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(axis=1)[:, None] * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1)[:, None], 1e-12)
        y = cosine * x + (1 - cosine * cosine) ** .5 * noise
        rank = np.minimum(self._rank(x, y), self._rank(y, x))
        return int(np.clip(np.quantile(rank, recall, method="higher") + 1, 1, cells))

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Cells nearer to ``x`` than the cell of ``y``."""
        out = np.empty(len(x), np.int64)
        for at in range(0, len(x), 512):
            (a, b), (c, d) = self._distances(x[at:at + 512]), self._distances(y[at:at + 512])
            i, j = c.argmin(axis=1), d.argmin(axis=1)
            own = np.take_along_axis(a, i[:, None], 1) + np.take_along_axis(b, j[:, None], 1)
            # count pairs below a sum by one search per codeword of the left half
            sb = np.sort(b, axis=1)
            out[at:at + 512] = [sum(np.searchsorted(sb[r], own[r, 0] - a[r], side="left")) for r in range(len(a))]
        return out

    def visit(self, x: np.ndarray) -> np.ndarray:
        a, b = self._distances(x)
        return multi_sequence(a, b, self.visits)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    Two rows link if their labels are equal and not null and their cosine in
    double precision reaches ``cosine``.  Vectors that are null, zero, or hold a
    null or non-finite component link with nothing, and so do vectors of
    different lengths.  Equal vectors of a label are one point with a weight,
    so a vector that is there many times costs one comparison.  Rows repeating
    an id count as rows; a null id is a row that names no class.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                          F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & sound, F.lit(False)))
    rows = rows.withColumn("norm", F.when(F.col("ok"), F.sqrt(norm)))
    usable = F.col("ok") & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    rows = rows.select("vec_id", "label", F.when(usable, F.col("v")).alias("v"))
    points = settle(rows.filter("v IS NOT NULL").groupBy("label", "v").agg(F.count(F.lit(1)).alias("weight"))
                    .select(F.xxhash64("label", "v").alias("point"), "label", "v", "weight", F.size("v").alias("dim")), "points")
    dims = [(r[0], r[1]) for r in points.groupBy("dim").count().collect()]  # one row per length of vectors
    found = [settle(_links(points.filter(F.col("dim") == dim), dim, n, cosine, recall, sample_rows), "near") for dim, n in dims]
    empty = points.sparkSession.createDataFrame([], "point long, links long, other long")
    near = empty
    for x in found:
        near = near.unionByName(x)
    classes = components(near.filter("other IS NOT NULL").select(F.col("point").alias("a"), F.col("other").alias("b")))
    counts = near.groupBy("point").agg(F.sum("links").alias("links"))
    placed = (points.select("point", "label", F.col("v"), "weight").join(counts, "point", "left")
              .join(classes.select(F.col("node").alias("point"), F.col("component").alias("class")), "point", "left")
              .select("point", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("class", "point").alias("class")))
    named = settle(rows.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")).alias("point"))
                   .join(placed, "point", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class"), "named")
    least = named.filter("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("component_id"))
    out = named.join(least, "class", "left").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(points: DataFrame, dim: int, n: int, cosine: float, recall: float, sample_rows: int) -> DataFrame:
    """``(point, links, other)``: weights of linked points, and links enough to connect each class."""
    sample = points.orderBy(F.xxhash64("point"), "point").limit(sample_rows).select("v").toPandas()["v"]
    x = np.vstack(sample.to_list()) if len(sample) else np.zeros((0, dim))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = points.agg(F.count_distinct("label")).head()[0]
    grid = Grid(x, n // max(1, labels), cosine, recall)
    shared = points.sparkSession.sparkContext.broadcast(grid)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = _matrix(part.column(2), dim)
                u = v / np.linalg.norm(v, axis=1, keepdims=True)
                cells = g.visit(u)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), part.column(3), pa.array(cells[:, 0]),
                     pa.array(list(cells), pa.list_(pa.int64()))], names=["point", "label", "v", "weight", "cell", "visits"])

    schema = f"point long, label {points.schema['label'].dataType.simpleString()}, v array<double>, weight long, cell long, visits array<long>"
    placed = settle(points.select("point", "label", "v", "weight").mapInArrow(place, schema), "placed")
    # a cell of any size is many tasks: blocks of its rows, each met by blocks of its visitors
    asks = placed.select("point", "label", "v", "weight", "cell", F.explode("visits").alias("at"))
    blocks = lambda df, at, name: df.groupBy("label", F.col(at).alias("at")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(name))
    grid_size = blocks(placed, "cell", "held").join(blocks(asks, "at", "asked"), ["label", "at"])
    part = lambda n: F.pmod(F.xxhash64("point"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(grid_size, ["label", "at"]).select(
        F.lit(0).alias("side"),
        "label", "at", part("asked").alias("i"), spread("held").alias("j"), "point", "v", "weight", "cell",
        F.lit(None).cast("array<long>").alias("visits"))
    right = placed.withColumn("at", F.col("cell")).join(grid_size, ["label", "at"]).select(
        F.lit(1).alias("side"), "label", "at", spread("asked").alias("i"), part("held").alias("j"), "point", "v", "weight", "cell", "visits")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _compared(rows, cosine)

    tiles = left.unionByName(right).groupBy("label", "at", "i", "j")
    return tiles.applyInPandas(compare, "point long, links long, other long")


def _compared(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One tile: visitors against the rows of the cell."""
    a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
    none = pd.DataFrame({"point": [], "links": [], "other": []}).astype("int64")
    if a.empty or b.empty:
        return none
    u, v = (np.vstack(x["v"].to_list()) for x in (a, b))
    s = (u @ v.T) / (np.sqrt((u * u).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None])
    pa_, pb = a["point"].to_numpy(), b["point"].to_numpy()
    near = (s >= cosine) & (pa_[:, None] != pb[None])
    # the pair counts for the visitor; for the visited too unless it visits the visitor's cell itself
    seen = [set(x) for x in b["visits"]]
    cells = a["cell"].to_numpy()
    i, j = np.nonzero(near)
    if len(i) == 0:
        return none
    back = np.fromiter((cells[p] not in seen[q] for p, q in zip(i, j)), bool, len(i))
    wa, wb = a["weight"].to_numpy(), b["weight"].to_numpy()
    ca = np.bincount(i, wb[j], len(a)).astype(np.int64)
    cb = np.bincount(j[back], wa[i[back]], len(b)).astype(np.int64)
    # a forest of the tile's links is enough for classes
    names, at = np.unique(np.concatenate((pa_[i], pb[j])), return_inverse=True)
    parent = np.arange(len(names))
    x, y = at[:len(i)], at[len(i):]
    while True:
        low = np.minimum(parent[x], parent[y])
        new = parent.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, parent[x], low)
        np.minimum.at(new, parent[y], low)
        new = new[new]
        if (new == parent).all():
            break
        parent = new
    tree = pd.DataFrame({"point": names, "links": 0, "other": names[parent]})
    counts = pd.DataFrame({"point": np.concatenate((pa_, pb)), "links": np.concatenate((ca, cb))})
    counts = counts[counts["links"] > 0].assign(other=pd.array([pd.NA] * int(((np.concatenate((ca, cb))) > 0).sum()), dtype="Int64"))
    tree["other"] = tree["other"].astype("Int64")
    return pd.concat([counts, tree[tree["point"] != tree["other"]]], ignore_index=True)
