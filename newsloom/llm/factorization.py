"""A factorisation machine over hashed terms: screening, fitting and scoring.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the features a row
has.  The pair sum is taken in linear time as half of (square of the sum minus
sum of the squares) in every factor.

Fitting uses a bounded sample of labelled rows on the driver; the model is a
few thousand screened features, so what is broadcast does not grow with data.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Hash buckets of terms; fixes the size of the largest possible model.
BUCKETS = 1 << 20
# Labelled rows a model is fitted on, chosen by a hash of their id.
SAMPLE_ROWS = 8000
# A term counts if it is in so many sampled rows and its log odds differ from zero by so many deviations.
LEAST_ROWS = 5
LEAST_Z = 3.0
# A pair of terms counts if, weights of single terms granted, chance gives as clear a pair anywhere in the sample this seldom.
PAIR_CHANCE = 0.05
# Terms a worker keeps the bucket of.
CACHE = 1 << 20


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


class Cached(dict):
    """``f(term)``, kept for the terms met so far; emptied when it is full."""

    def __init__(self, f: Callable[[str], int]):
        super().__init__()
        self.f = f

    def __missing__(self, term: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[term] = self.f(term)
        return value


@dataclass
class Model:
    """Screened buckets in ascending order with their weights and factors."""

    buckets: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def position(self, term: str) -> int:
        """Place of the term's weights, -1 for a term the model does not know."""
        b = bucket(term)
        at = int(np.searchsorted(self.buckets, b))
        return at if at < len(self.buckets) and self.buckets[at] == b else -1


def logits(w0: float, w: np.ndarray, v: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One value per row; ``flat`` lists the features of all rows, ``sizes`` how many each has."""
    out = np.full(len(sizes), w0, dtype=np.float64)
    has = np.flatnonzero(sizes)
    if len(has) == 0:
        return out
    starts = np.concatenate(([0], np.cumsum(sizes[has])[:-1]))
    rows = v[flat]
    total = np.add.reduceat(rows, starts, axis=0)
    squares = np.add.reduceat(rows * rows, starts, axis=0)
    out[has] += np.add.reduceat(w[flat], starts) + 0.5 * (total * total - squares).sum(axis=1)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def screened(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets in enough rows whose log odds between the labels are clear of chance."""
    if not rows:
        return np.zeros(0, np.int64)
    flat = np.concatenate(rows)
    of = np.repeat(labels, [len(r) for r in rows])
    pos = np.bincount(flat[of == 1], minlength=BUCKETS).astype(float)
    neg = np.bincount(flat[of == 0], minlength=BUCKETS).astype(float)
    n1, n0 = float((labels == 1).sum()), float((labels == 0).sum())
    a, b, c, d = pos + .5, neg + .5, n1 - pos + .5, n0 - neg + .5
    z = np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return np.flatnonzero((pos + neg >= LEAST_ROWS) & (z >= LEAST_Z))


def _own(rows: list[np.ndarray], kept: np.ndarray) -> list[np.ndarray]:
    """Places in ``kept`` of the buckets of every row, ascending."""
    place = np.full(BUCKETS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    return [np.sort(p[p >= 0]) for p in (place[r] for r in rows)]


def paired(rows: list[np.ndarray], labels: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Buckets of the pairs whose rows have other labels than ``expected``, the probabilities by single terms.

    All pairs of terms in enough rows are tried.  For n rows with mean
    expectation p and k positive labels, chance gives such a k with probability
    exp(-n KL(k/n, p)) at most; that, times the number of pairs, is the bound.
    """
    if not rows:
        return np.zeros(0, np.int64)
    terms = np.flatnonzero(np.bincount(np.concatenate(rows), minlength=BUCKETS) >= LEAST_ROWS)
    own, m = _own(rows, terms), len(terms)
    least = np.log(max(1.0, m * (m - 1.0)) / PAIR_CHANCE)
    sizes = np.array([len(o) for o in own])
    flat = np.concatenate(own) if m else np.zeros(0, np.int64)
    # a term's places in ``flat``, and the end of the row each is in
    places, ends = np.argsort(flat, kind="stable"), np.repeat(np.cumsum(sizes), sizes)
    of = np.repeat(np.arange(len(own)), sizes)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=m))))
    clear = np.zeros(m, bool)
    for i in range(m):
        n, k, e = np.zeros(m), np.zeros(m), np.zeros(m)
        for at in range(bounds[i], bounds[i + 1], 256):
            here = places[at:min(at + 256, bounds[i + 1])]
            others = np.concatenate([flat[a + 1:b] for a, b in zip(here, ends[here])])
            which = np.repeat(of[here], ends[here] - here - 1)
            n += np.bincount(others, minlength=m)
            k += np.bincount(others, labels[which], m)
            e += np.bincount(others, expected[which], m)
        js = np.flatnonzero(n >= LEAST_ROWS)
        n, k, e = n[js], k[js], e[js]
        with np.errstate(divide="ignore", invalid="ignore"):
            stat = np.where(k > 0, k * np.log(k / e), 0) + np.where(n > k, (n - k) * np.log((n - k) / (n - e)), 0)
        js = js[stat >= least]
        clear[js] = True
        clear[i] |= len(js) > 0
    return terms[clear]


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 30, rate: float = 0.1,
        decay: float = 1e-4, batch: int = 128, seed: int = 7) -> Model:
    """Logistic loss by AdaGrad over shuffled batches.  No labels, or one class only: the constant rate."""
    base = (labels.sum() + .5) / (len(labels) + 1.0)
    w0 = float(np.log(base / (1 - base)))
    options = rate, decay, batch, seed
    kept = screened(rows, labels)
    # single terms alone, to see which pairs say more
    own, alone = _own(rows, kept), _descend(rows, labels, kept, w0, 0, epochs, *options)
    sizes = np.array([len(o) for o in own], np.int64)
    flat = np.concatenate(own) if sizes.sum() else np.zeros(0, np.int64)
    expected = np.clip(sigmoid(logits(alone.w0, alone.w, alone.v, flat, sizes)), .01, .99)
    kept = np.union1d(kept, paired(rows, labels, expected))
    return _descend(rows, labels, kept, w0, factors, epochs, *options)


def _descend(rows: list[np.ndarray], labels: np.ndarray, kept: np.ndarray, w0: float, factors: int, epochs: int,
             rate: float, decay: float, batch: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    n = len(kept)
    w, v = np.zeros(n), rng.normal(0, 0.01, (n, factors))
    if n == 0:
        return Model(kept, w0, w, v)
    own = _own(rows, kept)
    gw, gv, g0 = np.full(n, 1e-8), np.full((n, factors), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(own))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            sizes = np.array([len(own[i]) for i in pick])
            flat = np.concatenate([own[i] for i in pick]) if sizes.sum() else np.zeros(0, np.int64)
            err = (sigmoid(logits(w0, w, v, flat, sizes)) - labels[pick]) / len(pick)
            g = err.sum()
            g0 += g * g
            w0 -= rate * g / np.sqrt(g0)
            if len(flat) == 0:
                continue
            of = np.repeat(np.arange(len(pick)), sizes)
            total = np.zeros((len(pick), factors))
            np.add.at(total, of, v[flat])
            touched, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, err[of], len(touched)) + decay * w[touched]
            dv = np.zeros((len(touched), factors))
            np.add.at(dv, back, err[of][:, None] * (total[of] - v[flat]))
            dv += decay * v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= rate * dv / np.sqrt(gv[touched])
    return Model(kept, w0, w, v)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents, those whose id hashes lowest: ``(doc_id, label, ...documents' columns)``.

    A document labelled more than once counts with its highest label; null
    labels do not count.
    """
    chosen = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str, inputs: list[str],
          features: Callable[..., Iterable[str]], sample_rows: int = SAMPLE_ROWS, **options) -> Model:
    """Fit on a sample of at most ``sample_rows`` labelled rows; tasks turn texts into buckets."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def hashed(cols: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        of = Cached(bucket)
        for part in cols:
            yield pd.Series([sorted({of[t] for t in features(*row)}) for row in part.itertuples(index=False)])

    sample = labelled_sample(docs, labels, label, sample_rows)
    got = sample.select("doc_id", "__label", hashed(F.struct(*inputs)).alias("f")).toPandas()
    # repeated documents in a fixed order, so that a fit can be repeated
    got = got.assign(n=[len(f) for f in got["f"]]).sort_values(["doc_id", "n"], kind="stable")
    return fit([np.asarray(f, np.int64) for f in got["f"]], got["__label"].to_numpy(np.float64), **options)


def score(docs: DataFrame, model: Model, inputs: list[str], features: Callable[..., Iterable[str]],
          name: str = "score") -> DataFrame:
    """``docs`` with the score as column ``name``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(cols: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        m = shared.value
        of = Cached(m.position)
        for part in cols:
            flat, sizes = [], []
            for row in part.itertuples(index=False):
                own = {of[t] for t in features(*row)}
                own.discard(-1)
                flat.extend(sorted(own))
                sizes.append(len(own))
            yield pd.Series(sigmoid(logits(m.w0, m.w, m.v, np.array(flat, np.int64), np.array(sizes, np.int64))))

    return docs.withColumn(name, scored(F.struct(*inputs)))
