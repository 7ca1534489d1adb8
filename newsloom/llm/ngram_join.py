"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their classes.

The join is exact up to 64-bit hashes of shingles and sets.

1. Every text becomes a sorted array of hashed shingles.  Texts with one set
   are one node from there on, so copies cost nothing further.
2. Two linked sets share a shingle among the first few of each in any common
   order.  Shingles that many texts share come last in it: a sketch of fixed
   size counts all shingles in buckets, and a crowded bucket marks its own.
   A set is posted under the shingles of that prefix.
3. A posting list is cut into tiles of adjoining bands of set sizes.  First
   every member meets the smallest set of its tiles, which is linear in the
   list and joins groups of near copies into classes.
4. Where a list still holds several classes, blocks of bounded size of its
   tiles are compared through bitmaps of hashed shingles: bits of one set
   missing from the other bound the overlap from above.
5. Pairs left are decided by intersecting the sorted arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, few, settle

WIDTH = 5
# similarity as a ratio of whole numbers: PART * |union| <= WHOLE * |intersection|
PART, WHOLE = 80, 100
# Buckets of the sketch that finds shared shingles, and the pieces it is summed in.
BUCKET_BITS = 20
CHUNKS = 64
# Parts of the list of a crowded shingle.
SALTS = 64
# About so many rows make a side of a block of a tile.
BLOCK = 512
# Pairs of a list up to this size are named before their bitmaps are fetched; rows of a longer one carry theirs.
SHORT = 64
CARRIED = 128
# Size of the filter that says whose sets are needed for the last check.
FILTER_BITS = 23
# Words hashed at a time.
SLICE = 1 << 18
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(31)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def shingle_sets(texts: Iterator[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles.

    Fewer words than ``width`` are one shingle, none give none.  Words of
    several texts are hashed in one go, about SLICE at a time.
    """
    words, sizes = [], []
    for text in texts:
        own = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        words += own
        sizes.append(len(own))
        if len(words) >= SLICE:
            yield from _hashed(words, sizes, width)
            words, sizes = [], []
    yield from _hashed(words, sizes, width)


def _rolled(x: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(x) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * _M1 + x[i:len(x) - k + 1 + i])
    return h


def _hashed(words: list[bytes], sizes: list[int], width: int) -> Iterator[np.ndarray]:
    x = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    every = _rolled(x, width) if len(x) >= width else None
    at = 0
    for n in sizes:
        h = every[at:at + n - width + 1] if n >= width else _rolled(x[at:at + n], n) if n else x[:0]
        at += n
        h = np.sort(h)
        yield h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h


def node_of(sets: np.ndarray) -> int:
    """Signed 64-bit name of a set, its lowest bit 0."""
    value = xxhash.xxh3_64_intdigest(sets.tobytes()) & ~1
    return value - (1 << 64) if value >> 63 else value


def _bitmap_bits(n: int) -> int:
    """Width of a set's bitmap: about two bits a shingle, a power of two."""
    return 1 << min(16, max(6, int(2 * n - 1).bit_length()))


def _bitmap(h: np.ndarray) -> bytes:
    bits = np.zeros(_bitmap_bits(len(h)), np.uint8)
    bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _first_pass(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document, and at the end one row per chunk of the task's sketch."""
        sketch = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            keys = batch.column(0)
            n, node, bitmap, heads = [], [], [], []
            for h in shingle_sets((t.as_py() for t in batch.column(1)), width):
                n.append(len(h))
                node.append(node_of(h) if len(h) else None)
                bitmap.append(_bitmap(h) if len(h) else None)
                heads.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            sketch += np.bincount(np.concatenate(heads or [[]]).astype(np.int64), minlength=len(sketch))
            yield pa.RecordBatch.from_arrays(
                [keys, batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bitmap, pa.binary()),
                 pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int32())], names=FIRST.split(", "))
        task = TaskContext.get().partitionId()
        if sketch.any():
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(CHUNKS, pa.int64())] * 4,
                 pa.array([_packed(x) for x in np.split(sketch, CHUNKS)], pa.binary()),
                 pa.array(range(CHUNKS), pa.int32()), pa.array([task] * CHUNKS, pa.int32())], names=FIRST.split(", "))
    return run


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _unpacked(piece: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(piece), np.int64)


FIRST = "doc_id, text_hash, n, node, bits, chunk, task"
FIRST_SCHEMA = "doc_id long, text_hash long, n long, node long, bits binary, chunk int, task int"


def _crowded(first: DataFrame) -> bytes:
    """One bit per bucket of the sketch: far more shingles than an even spread would give."""
    pieces = first.filter("chunk IS NOT NULL").select("chunk", "task", "bits")
    total, tasks = first.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("task"), F.lit(0)) + 1).head()
    mean = total / (1 << BUCKET_BITS)
    limit = mean + 16 * mean ** .5 + 32

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((1 << BUCKET_BITS) // CHUNKS, np.int64)
        for piece in pdf["bits"]:
            out += _unpacked(piece)
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "task": pdf["task"][:1], "bits": [_packed(out)]})

    # two levels, so that no task adds up the pieces of all others
    step = max(1, int(tasks ** .5))
    partial = pieces.groupBy("chunk", F.expr(f"task div {step}")).applyInPandas(summed, pieces.schema)
    rows = partial.groupBy("chunk").applyInPandas(summed, pieces.schema).select("chunk", "bits").collect()
    out = np.zeros(1 << BUCKET_BITS, bool)
    size = len(out) // CHUNKS
    for chunk, bits in rows:
        out[chunk * size:(chunk + 1) * size] = _unpacked(bits) > limit
    return np.packbits(out).tobytes()


def _lists(docs: DataFrame, crowded: bytes, width: int, part: int, whole: int) -> DataFrame:
    """``(key, node, inner)``: the shingles of every set's prefix, those that can link two sets.

    ``inner`` marks those a set needs towards sets of its size or more; towards
    smaller ones it needs all of them.  Lists of crowded shingles are dealt out
    by set as well and pass as they are; a list of any other is at most as long
    as a bucket of the sketch, and passes if it holds two sets, one with ``inner``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crowded)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            keys, entries, salts = [], [], []
            for h in shingle_sets((t.as_py() for t in batch.column(1)), width):
                n = len(h)
                if n == 0:
                    continue
                outer = n - -(-part * n // whole) + 1
                own = n - -(-2 * part * n // (part + whole)) + 1
                late = hot[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                order = np.concatenate([h[~late][:outer], h[late][:outer]])[:outer]
                node = node_of(h)
                keys.append(order.view(np.int64))
                # the lowest bit of a node's name is free: 0 for inner
                entries.append((np.arange(len(order)) >= own) | np.int64(node))
                salts.append(np.where(hot[(order >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], (node >> 1) % SALTS + 1, 0))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(entries)),
                     pa.array(np.concatenate(salts).astype(np.int16))], names=["key", "entry", "salt"])

    def useful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            key, entry, salt = (batch.column(i).to_numpy() for i in range(3))
            if rest is not None:
                key, entry, salt = (np.concatenate(x) for x in zip(rest, (key, entry, salt)))
            # the last list may go on; what is held of it is one crowded list at most a batch long, or a short one
            cut = len(key) if len(key) and salt[-1] else int(np.searchsorted(-(key != key[-1]).astype(np.int8), 0)) if len(key) else 0
            rest = (key[cut:], entry[cut:], salt[cut:])
            yield from _passed(key[:cut], entry[:cut], salt[:cut])
        if rest is not None:
            yield from _passed(*rest)

    rows = docs.select("doc_id", "text").mapInArrow(post, "key long, entry long, salt short")
    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "entry")
    return dealt.mapInArrow(useful, "key long, node long, inner boolean")


def _passed(key: np.ndarray, entry: np.ndarray, salt: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of useful lists, each set once per list."""
    if len(key) == 0:
        return
    node, outer = entry & ~np.int64(1), (entry & 1).astype(bool)
    new_list = np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
    new = new_list | np.concatenate(([True], node[1:] != node[:-1]))
    starts = np.flatnonzero(new_list)
    several = np.add.reduceat(new.astype(np.int64), starts) > 1
    inner = np.add.reduceat((~outer).astype(np.int64), starts) > 0
    keep = new & (np.repeat(several & inner, np.diff(np.append(starts, len(key)))) | (salt > 0))
    yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep]), pa.array(~outer[keep])],
                                     names=["key", "node", "inner"])


def _exact(docs: DataFrame, rows: DataFrame, pairs: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that link, by the intersection of their sorted arrays.

    Arrays are made anew for one text of each set in a pair; a filter of fixed
    size over document ids says which to make, strays it lets pass find no pair.
    """
    slot = lambda c: F.pmod(F.coalesce(c, F.lit(0)), F.lit(1 << FILTER_BITS)) + 1
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = rows.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select(slot(F.col("doc_id")).alias("slot"))
    asked = asked.groupBy(F.bitmap_bucket_number("slot").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    mask = np.zeros(1 << FILTER_BITS, bool)
    for piece, bits in asked:
        got = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")
        mask[(piece - 1) * len(got):piece * len(got)] = got
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(mask).tobytes())

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
        for batch in batches:
            take = ask[batch.column(0).fill_null(0).to_numpy() & ((1 << FILTER_BITS) - 1)]
            texts = batch.column(1).filter(pa.array(take))
            sets = [h for h in shingle_sets((t.as_py() for t in texts), width) if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in sets], pa.int64()),
                                              pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "h"])

    sets = (docs.select("doc_id", "text").mapInArrow(arrays, "node long, h binary")
            .groupBy("node").agg(F.first("h").alias("h")))

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(whole * both >= part * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    return both.filter(linked("ha", "hb")).select("a", "b")


def _open_lists(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of lists that hold several classes: ``(node, key, inner, n, class, size)``."""
    placed = lists.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    still = placed.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count(F.lit(1)).alias("size"))
    return placed.join(still.filter("x <> y").select("key", "size"), "key")


def _tile_pairs(lists: DataFrame, nodes: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs ``(a, b)`` of different classes in a list that bitmaps cannot rule out.

    A tile is a list and two adjoining bands, cut into blocks of about BLOCK
    rows a side; each pair of blocks is one unit of work.  ``lists`` is settled.
    """
    rows = lists.withColumn("band", F.floor(F.log("n") / F.lit(np.log(whole / part) * 1.0000001)))
    counts = rows.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    above = counts.select("key", (F.col("band") - 1).alias("band"), F.col("blocks").alias("next"))
    grid = settle(counts.join(above, ["key", "band"], "left").select(
        "key", F.col("band").alias("home"), "blocks", F.coalesce("next", F.lit(0)).alias("next")), "tiles")

    short, long = rows.filter(F.col("size") <= SHORT), rows.filter(F.col("size") > SHORT)
    rows = short.withColumn("bits", F.lit(None).cast("binary")).unionByName(
        long.join(nodes.select("node", _folded_to(F.col("bits")).alias("bits")), "node"))
    # a row is on the left in its own band, on the right in its own and in the band below
    homes = F.array(*[F.struct((F.col("band") - up).alias("home"), F.lit(up).alias("up")) for up in (0, 1)])
    placed = rows.withColumn("h", F.explode(homes)).select(
        "key", "h.home", "h.up", "node", "n", "class", "inner", "bits").join(grid, ["key", "home"])

    def unit(i: Column, up: Column, j: Column, side: int) -> Column:
        return F.struct(i.alias("i"), up.alias("up"), j.alias("j"), F.lit(side).alias("side"))

    none = F.array().cast("array<struct<i:int,up:int,j:int,side:int>>")
    at = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    blocks, above, up = F.col("blocks"), F.col("next"), F.col("up")
    left = F.when((up == 0) & F.col("inner"), F.concat(
        F.transform(upto(blocks), lambda j: unit(at(blocks), F.lit(0), j, 0)),
        F.transform(upto(above), lambda j: unit(at(blocks), F.lit(1), j, 0)))).otherwise(none)
    right = F.transform(upto(blocks), lambda i: unit(i, up, at(F.when(up == 0, blocks).otherwise(above)), 1))
    work = placed.withColumn("t", F.explode(F.concat(left, right))).select(
        F.xxhash64("key", "home", "t.i", "t.up", "t.j").alias("tile"), "t.side", "node", "n", "class", "bits")
    dealt = work.repartition("tile").sortWithinPartitions("tile", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = batch.to_pandas()
            now = now if rest is None else pd.concat([rest, now], ignore_index=True)
            tiles = now["tile"].to_numpy()
            cut = int(np.searchsorted(tiles, tiles[-1])) if len(tiles) else 0
            rest = now.iloc[cut:]
            yield from _blocks(now.iloc[:cut], part, whole)
        if rest is not None:
            yield from _blocks(rest, part, whole)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _blocks(rows: pd.DataFrame, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    if rows.empty:
        return
    tiles, side = rows["tile"].to_numpy(), rows["side"].to_numpy()
    node, n, cls, bits = (rows[c].to_numpy() for c in ("node", "n", "class", "bits"))
    starts = np.flatnonzero(np.concatenate(([True], tiles[1:] != tiles[:-1])))
    a, b = [], []
    for lo, hi in zip(starts, np.append(starts[1:], len(tiles))):
        mid = lo + int((side[lo:hi] == 0).sum())
        if mid == lo or mid == hi or hi - lo < 2:
            continue
        right = np.arange(mid, hi)
        carried = bits[lo] is not None
        if carried:
            width = min(map(len, bits[lo:hi]))
            maps = np.stack([_folded(x, width) for x in bits[lo:hi]])
        for i in range(lo, mid):
            j = right[(cls[right] != cls[i]) & (n[right] >= n[i]) & (whole * n[i] >= part * n[right])
                      & ((n[right] > n[i]) | (node[right] > node[i]))]
            if len(j) == 0:
                continue
            if not carried:
                a.extend([node[i]] * len(j))
                b.extend(node[j])
                continue
            mine, theirs = maps[i - lo], maps[j - lo]
            only_mine = np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64)
            only_theirs = np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[i] - only_mine, n[j] - only_theirs)
            j = j[whole * most >= part * (n[i] + n[j] - most)]
            a.extend([node[i]] * len(j))
            b.extend(node[j])
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _folded_to(bits: Column) -> Column:
    """Bitmaps of at most CARRIED bytes: what a row of a long list carries does not grow with its set."""
    @F.pandas_udf("binary")
    def fold(x: pd.Series) -> pd.Series:
        return pd.Series([_folded(b, min(len(b), CARRIED)).tobytes() for b in x], dtype=object)

    return fold(bits)


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap of ``width`` bytes: the pieces of a longer one laid over each other."""
    x = np.frombuffer(bits, np.uint8)
    return np.bitwise_or.reduce(x.reshape(-1, width), axis=0).view(np.uint64)


def ngram_classes(docs: DataFrame, width: int = WIDTH, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``.

    ``part`` of ``whole`` is the least Jaccard similarity of a link.  A class is
    named by the smallest id in it.  Null, empty and blank texts have no
    shingles and are classes of their own.  A null id keeps its row; it names
    no class unless all of a class have none.  Rows that repeat an id are
    rows of their own.  Other columns are ignored.
    """
    named = _named(docs, width, part, whole)
    least = named.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = WIDTH, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """``docs`` with one row of each class, the one of the smallest id, with all its columns.

    Rows without shingles all stay, but for repeats of one id and text, of
    which one stays.  A null id comes after all others.
    """
    named = _named(docs, width, part, whole)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = named.filter("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("first"))
    gone = (named.join(first, "class").filter(order != F.col("first"))
            .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    again = (named.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
             .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")))
    gone, again = few(gone, "gone"), few(again, "repeats")
    kept = docs.withColumn("__text", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash"))
    kept = kept.join(gone, same, "left_anti")
    once = kept.join(again, same, "left_anti")
    repeated = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__text"])
    return once.unionByName(repeated).drop("__text")


def _named(docs: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """``(doc_id, text_hash, n, class)`` of every row, ``class`` the smallest node of its class or null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    first = settle(docs.mapInArrow(_first_pass(width), FIRST_SCHEMA), "shingle-sets")
    rows = first.filter("chunk IS NULL")
    nodes = settle(rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "sets")
    lists = _lists(docs, _crowded(first), width, part, whole)
    lists = settle(lists.join(nodes.select("node", "n"), "node"), "lists")

    band = F.floor(F.log("n") / F.lit(np.log(whole / part) * 1.0000001))
    banded = lists.withColumn("band", band)
    low = banded.filter("inner").groupBy("key", "band").agg(F.min(F.struct("n", "node")).alias("head"))
    heads = low.unionByName(low.withColumn("band", F.col("band") + 1))
    near = banded.join(heads, ["key", "band"]).filter(
        (F.col("node") != F.col("head.node")) & (whole * F.least("n", "head.n") >= part * F.greatest("n", "head.n")))
    pairs = near.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
    links = settle(_exact(docs, rows, settle(_bounded(pairs, nodes, part, whole), "star-pairs"), width, part, whole), "star-links")

    # classes of the stars become nodes, so what links them is small
    classes = settle(components(links), "star-classes").withColumnRenamed("component", "class")
    still = settle(_open_lists(lists, classes), "open-lists")
    pairs = settle(_bounded(_tile_pairs(still, nodes, part, whole), nodes, part, whole), "tile-pairs")
    more = settle(_exact(docs, rows, pairs, width, part, whole), "tile-links")
    for end in ("a", "b"):
        more = (more.join(classes.withColumnRenamed("node", end), end, "left")
                .withColumn(end, F.coalesce("class", end)).drop("class"))
    joined = components(more).select(F.col("node").alias("class"), "component")

    named = rows.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    named = named.join(joined, "class", "left").withColumn("class", F.coalesce("component", "class"))
    return settle(named.select("doc_id", "text_hash", "n", "class"), "classes")


def _bounded(pairs: DataFrame, nodes: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs whose bitmaps leave room for enough overlap."""
    @F.pandas_udf("boolean")
    def possible(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q, s, t in zip(n, m, x, y):
            width = min(len(s), len(t))
            s, t = _folded(s, width), _folded(t, width)
            most = min(p - int(np.bitwise_count(s & ~t).sum()), q - int(np.bitwise_count(t & ~s).sum()))
            out.append(whole * most >= part * (p + q - most))
        return pd.Series(out, dtype=bool)

    left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
    both = left.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
    return both.filter(possible("na", "nb", "xa", "xb")).select("a", "b")
