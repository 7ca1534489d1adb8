"""Token ids of a corpus in raw shard files, with a minimal perfect hash index.

A store is a folder:

- ``shards/shard-N.bin``: nothing but ids, little-endian, two bytes each if the
  vocabulary fits and four otherwise; documents in ascending order of their id.
- ``index/bucket-N.mph``: for a bucket of keys, bit arrays of a minimal perfect
  hash function, and at a key's slot its fingerprint, shard, offset and length.
  A lookup reads a few bits and one slot, whatever the number of documents.
- ``manifest``: a table of shards with the ids before each.

Files are written under a name of the attempt and then moved, so a task that
runs again, or twice, leaves the same store.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import settle

END = 2
KEYS_PER_BUCKET = 200_000
# Slots per key at each level of the hash function, and the most levels.
GAMMA, LEVELS = 2.0, 40
# Stretches whose ids a worker keeps; bytes encoded at a time; stretches handed to the tokenizer at a time; bytes read at a time.
WORDS_KEPT = 800_000
SLICE = 4 << 20
HANDED = 8192
READ = 8 << 20
_CUT = re.compile(r"(?= \S)")
# Anything but single spaces, each before a word, and single line ends; and the sign that a stretch follows no space.
_ODD = "  | \n|\n |\n\n| \\z|[\x01\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# A letter or digit, and an ASCII mark behind it.
_MARKED = "([0-9A-Za-zÀ-ÖØ-öø-ʯ])([!-/:-@\\[-`{-~])"


def width_of(vocabulary: int, end: int) -> int:
    return 2 if max(vocabulary, end + 1) <= 1 << 16 else 4


class Encoder:
    """Whole texts to ids, through the ids of the stretches they are cut into.

    The tokenizer never joins characters over a space that a word follows, over
    a single line end, nor over a letter and a mark behind it, so a text is cut
    there, and a stretch met before is not encoded again.  Arrow cuts the texts,
    finds the distinct stretches and puts their ids together.  A text with other
    spaces, or with a token that is found before words are, is cut at spaces.

    Stretches are named by how they stand in the text: ``\\x01`` is before one
    that follows no space, a line end is the start of its stretch, and all others
    follow a space.
    """

    def __init__(self, path: str, end: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.kind = f"<u{width_of(self.of.get_vocab_size(), end)}"
        self.end = np.array([end], self.kind).tobytes()
        self.odd = "|".join([_ODD, *(re.escape(t.content) for t in self.of.get_added_tokens_decoder().values())])
        self.held: dict[str, bytes] = {}
        self.line = len(self._ids("\n"))

    def _ids(self, text: str) -> bytes:
        return np.array(self.of.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text, and the end behind them; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        out = np.empty(len(texts), dtype=object)
        out[~odd] = self._plain(texts.filter(pa.array(~odd)))
        out[odd] = [self._odd(text) for text in texts.filter(pa.array(odd)).to_pylist()]
        return out.tolist()

    def _plain(self, texts: pa.Array) -> list[bytes]:
        marked = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n"), _MARKED, "\\1 \x01\\2")
        # a line end before each text, whose ids are left out
        stretches = pc.split_pattern(pc.binary_join_element_wise("\n", marked, ""), " ")
        coded = stretches.flatten().dictionary_encode()
        ids = pa.array(self._known(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int32)[stretches.offsets.to_numpy()] if len(ids) else []
        data = ids.buffers()[2]
        return [bytes(data[lo + self.line:hi]) + self.end for lo, hi in zip(at[:-1], at[1:])]

    def _odd(self, text: str) -> bytes:
        return b"".join(self._known(["\x01" + part for part in _CUT.split(text)])) + self.end

    def _known(self, stretches: list[str]) -> list[bytes]:
        """The ids of stretches, encoded if they are not held; if too many are, only these are kept."""
        fresh = list(set(stretches).difference(self.held))
        if len(self.held) + len(fresh) > WORDS_KEPT:
            self.held.clear()
            fresh = list(set(stretches))
        for lo in range(0, len(fresh), HANDED):
            some = fresh[lo:lo + HANDED]
            got = self.of.encode_batch_fast([s[1:] if s[:1] == "\x01" else s if s[:1] == "\n" else " " + s for s in some], add_special_tokens=False)
            lists = [e.ids for e in got]
            ends = np.cumsum([len(x) for x in lists]) * len(self.end)
            data = np.fromiter(chain.from_iterable(lists), self.kind).tobytes()
            self.held.update((s, data[a:b]) for s, a, b in zip(some, [0, *ends.tolist()], ends.tolist()))
        return list(map(self.held.__getitem__, stretches))


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def _write(folder: str, name: str):
    """A file to write and the function that puts it in its place."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"

    def done() -> None:
        fs.move(draft, f"{root}/{name}")

    return fs.open_output_stream(draft), done


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


ENTRIES = "shard int, doc_id long, copy long, offset long, n long"


def write_store(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> None:
    """Encode ``docs(doc_id, text)`` and write the store.

    Each text is followed by ``end``; a null text is empty.  Documents go in
    ascending order of id, null ids first; rows that repeat an id stand after
    one another in the order of the input and are its copies 0, 1, ...
    A repeated id is spread over shards like any others.  An empty table gives
    a store without shards.  Other columns are ignored.
    """
    spark, folder = docs.sparkSession, _uri(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    dealt = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(tokenizer, end), TaskContext.get().partitionId()
        file = done = None
        at, last, copy = 0, (), 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in _slices(texts):
                own = encoder.encode(texts.slice(lo, hi - lo))
                if file is None:
                    file, done = _write(f"{folder}/shards", f"shard-{shard:06d}.bin")
                offsets, sizes, copies = [], [], []
                for key, ids in zip(keys[lo:hi], own):
                    file.write(ids)
                    copy, last = (copy + 1, last) if last == (key,) else (0, (key,))
                    n = len(ids) // len(encoder.end)
                    offsets.append(at)
                    sizes.append(n)
                    copies.append(copy)
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(own), pa.int32()), pa.array(keys[lo:hi], pa.int64()), pa.array(copies, pa.int64()),
                     pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=["shard", "doc_id", "copy", "offset", "n"])
        if file is not None:
            file.close()
            done()

    entries = settle(dealt.mapInArrow(write, ENTRIES), "token-entries")
    ends = entries.groupBy("shard").agg(
        F.sum("n").alias("n_tokens"), F.min_by("doc_id", "offset").alias("first"), F.max_by("doc_id", "offset").alias("last"),
        (F.max_by("copy", "offset") + 1).alias("held"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    (ends.select("shard", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
     .write.mode("overwrite").parquet(f"{folder}/manifest"))
    # an id may go on in the next shard: copies counted so far
    marks = ends.select("shard", F.col("last").alias("doc_id"), F.lit(1).alias("side"), "held").unionByName(
        ends.select("shard", F.col("first").alias("doc_id"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("held")))
    running = Window.partitionBy("doc_id").orderBy("shard", "side").rowsBetween(Window.unboundedPreceding, -1)
    carried = (marks.withColumn("carry", F.coalesce(F.sum("held").over(running), F.lit(0))).filter("side = 0 AND carry > 0")
               .select(F.col("shard").alias("s"), F.col("doc_id").alias("d"), "carry"))
    numbered = (entries.join(carried, (F.col("shard") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
                .withColumn("copy", F.col("copy") + F.coalesce("carry", F.lit(0))))
    buckets = max(1, -(-entries.count() // KEYS_PER_BUCKET))
    keyed = numbered.select(*_key(buckets), "shard", "offset", "n")

    def build(bucket: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = _write_bucket(folder, bucket[0], rows)
        return pd.DataFrame({"bucket": [bucket[0]], "n": [len(rows)], "bytes": [size]})

    (keyed.groupBy("bucket").applyInPandas(build, "bucket long, n long, bytes long")
     .write.mode("overwrite").parquet(f"{folder}/buckets"))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(total):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE)) + 1
        yield lo, min(hi, len(total))
        lo = hi


def _key(buckets: int) -> list[Column]:
    """A key's bucket, hash and fingerprint; a null id is a key too."""
    parts = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("copy")]
    return [F.pmod(F.xxhash64(F.lit(1), *parts), F.lit(buckets).cast("long")).alias("bucket"),
            F.xxhash64(F.lit(2), *parts).alias("hash"), F.hash(F.lit(3), *parts).alias("fingerprint")]


def _place(h: np.ndarray, level: int, m: int) -> np.ndarray:
    x = (h ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(m)).astype(np.int64)


def _write_bucket(folder: str, bucket: int, rows: pd.DataFrame) -> int:
    """Each level keeps the keys that meet no other; the rest go on to the next, the last of all to a sorted list."""
    h = rows["hash"].to_numpy(np.int64).view(np.uint64)
    left, levels, slots, used = np.arange(len(h)), [], np.full(len(h), -1, np.int64), 0
    while len(left) and len(levels) < LEVELS:
        m = max(8, int(GAMMA * len(left)))
        at = _place(h[left], len(levels), m)
        alone = np.bincount(at, minlength=m) == 1
        fits = alone[at]
        rank = np.cumsum(alone) - 1
        slots[left[fits]] = used + rank[at[fits]]
        used += int(alone.sum())
        levels.append(np.packbits(alone, bitorder="little"))
        left = left[~fits]
    # equal hashes never part: they stand in the list in the order of their hashes and fingerprints
    fingerprint = rows["fingerprint"].to_numpy(np.int32)
    left = left[np.lexsort((fingerprint[left], h[left]))]
    slots[left] = used + np.arange(len(left))
    order = np.argsort(slots, kind="stable")
    head = np.array([len(h), len(levels), used] + [len(x) for x in levels], np.int64)
    parts = [head, *levels, h[left], fingerprint[order], rows["shard"].to_numpy(np.int32)[order],
             rows["offset"].to_numpy(np.int64)[order], rows["n"].to_numpy(np.int64)[order]]
    file, done = _write(f"{folder}/index", f"bucket-{bucket:08d}.mph")
    with file:
        for part in parts:
            file.write(part.tobytes())
    done()
    return sum(part.nbytes for part in parts)


class Index:
    """The index of one bucket, read from its file."""

    def __init__(self, folder: str, bucket: int):
        fs, root = pafs.FileSystem.from_uri(_uri(folder))
        with fs.open_input_file(f"{root}/index/bucket-{bucket:08d}.mph") as file:
            data = file.read()
        n, k, used = np.frombuffer(data, np.int64, 3)
        sizes = np.frombuffer(data, np.int64, k, 24)
        at = 24 + 8 * int(k)
        self.levels, remaining, filled = [], int(n), 0
        for size in sizes:
            m = max(8, int(GAMMA * remaining))
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[:m]
            at += int(size)
            self.levels.append((m, bits.astype(bool), filled + np.cumsum(bits) - 1))
            filled += int(bits.sum())
            remaining = int(n) - filled
        rest = int(n - used)
        self.rest, self.used = np.frombuffer(data, np.uint64, rest, at), int(used)
        at += 8 * rest
        self.columns = {}
        for name, kind in (("fingerprint", np.int32), ("shard", np.int32), ("offset", np.int64), ("n", np.int64)):
            self.columns[name] = np.frombuffer(data, kind, n, at)
            at += self.columns[name].nbytes

    def slots(self, hashes: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 for keys whose fingerprint is not the stored one."""
        h = hashes.astype(np.int64).view(np.uint64)
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (m, bits, rank) in enumerate(self.levels):
            at = _place(h[left], level, m)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        for i in left:
            lo, hi = np.searchsorted(self.rest, h[i], "left"), np.searchsorted(self.rest, h[i], "right")
            same = np.flatnonzero(self.columns["fingerprint"][self.used + lo:self.used + hi] == fingerprints[i])
            out[i] = self.used + lo + same[0] if len(same) else -1
        known = out >= 0
        known[known] = self.columns["fingerprint"][out[known]] == fingerprints[known]
        return np.where(known, out, -1)


def look_up(keys: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, copy, shard, offset, n)`` of ``keys(doc_id, copy)`` in the store; unknown keys give no row."""
    spark, folder = keys.sparkSession, _uri(folder)
    buckets = spark.read.parquet(f"{folder}/buckets").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    if buckets == 0:
        return spark.createDataFrame([], "doc_id long, copy long, shard int, offset long, n long")
    asked = keys.select("doc_id", "copy", *_key(-(-buckets // KEYS_PER_BUCKET)))
    dealt = asked.repartition("bucket").sortWithinPartitions("bucket")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            bucket = batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held != bucket[lo]:
                    held, index = bucket[lo], Index(folder, int(bucket[lo]))
                part = batch.slice(lo, hi - lo)
                slot = index.slots(part.column(3).to_numpy(), part.column(4).to_numpy())
                known = slot >= 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(pa.array(known)), part.column(1).filter(pa.array(known)),
                     *[pa.array(index.columns[c][slot[known]]) for c in ("shard", "offset", "n")]],
                    names=["doc_id", "copy", "shard", "offset", "n"])

    return dealt.mapInArrow(find, "doc_id long, copy long, shard int, offset long, n long")


def read_ids(places: DataFrame, folder: str, width: int, crc: bool = False) -> DataFrame:
    """``places(doc_id, copy, shard, offset, n)`` with ``ids``, little-endian 32-bit, or only their crc32.

    Rows are sorted by their place, so that a shard is read from front to back.
    """
    folder = _uri(folder)
    dealt = places.select("doc_id", "copy", "shard", "offset", "n").repartition("shard").sortWithinPartitions("shard", "offset")
    last = ("ids_crc32", "long", pa.int64()) if crc else ("ids", "binary", pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        held = file = None
        start, data = 0, b""
        for batch in batches:
            out = []
            for shard, offset, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if held != shard:
                    held, start, data = shard, 0, b""
                    file = fs.open_input_file(f"{root}/shards/shard-{shard:06d}.bin")
                lo, size = offset * width, n * width
                if lo < start or lo + size > start + len(data):
                    file.seek(lo)
                    start, data = lo, file.read(max(READ, size))
                ids = np.frombuffer(data, f"<u{width}", n, lo - start).astype("<u4").tobytes()
                out.append(zlib.crc32(ids) if crc else ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, last[2])], names=[*batch.schema.names, last[0]])

    return dealt.mapInArrow(read, f"doc_id long, copy long, shard int, offset long, n long, {last[0]} {last[1]}")


def read_back(spark: SparkSession, keys: DataFrame, folder: str, width: int) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of ``keys(doc_id, copy)``, all from the store's files."""
    manifest = spark.read.parquet(f"{_uri(folder)}/manifest").select("shard", "base")
    found = read_ids(look_up(keys, folder), folder, width, crc=True).join(manifest, "shard")
    return found.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")


def keys_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, copy)`` of every row of ``docs``."""
    counted = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))
