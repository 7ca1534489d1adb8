from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest
from common_rows import awkward, no_rows, prose

from newsloom.llm import sharding as sh


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 40, 1000, 1025])
def test_permutation_and_its_inverse(n):
    p = sh.Permutation(n)
    new = p.forward(np.arange(n))
    assert sorted(new) == list(range(n)) and list(p.backward(new)) == list(range(n))
    if n >= 1000:
        assert list(new) != list(sh.Permutation(n, seed=14).forward(np.arange(n)))
        # neighbours part: about one in n keeps its distance of one
        assert (np.diff(new) == 1).mean() < 0.02
    shard, slot = sh.place(np.arange(n), n, 7)
    assert list(sh.row_at(shard, slot, n, 7)) == list(range(n))


def test_large_numbers_do_not_overflow():
    p = sh.Permutation(1 << 61)
    rows = np.array([0, 1, (1 << 61) - 1, 1 << 60, 123456789012345])
    assert list(p.backward(p.forward(rows))) == list(rows) and (p.forward(rows) >= 0).all()
    with pytest.raises(ValueError):
        sh.Permutation((1 << 62) + 1)


def one_at_a_time(row, n, seed):
    """The permutation of one number, bit strings and all."""
    keys = sh._keys(seed)
    bits = max(2, (n - 1).bit_length())
    while True:
        state, left = format(row, f"0{bits}b"), bits - bits // 2
        for key in keys:
            a, b = state[:left], state[left:]
            x = (int(b, 2) + key) % sh.PRIME * sh.FACTORS[0] % sh.PRIME
            x = (x ^ x >> 15) * sh.FACTORS[1] % sh.PRIME
            x = (x ^ x >> 13) % 2 ** left
            state, left = b + format(int(a, 2) ^ x, f"0{left}b"), bits - left
        row = int(state, 2)
        if row < n:
            return row


def test_as_by_brute_force(spark):
    rows = [(i * 37 % 501, prose(i % 9, i) if i % 11 else None) for i in range(501)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for k, (i, text) in enumerate(sorted(rows)):
        raw, new = (text or "").encode(), one_at_a_time(k, len(rows), sh.SEED)
        want.append((i, len(raw) + 16, crc32(raw), new % 40, new // 40))
    for parts in (1, 13):
        got = sh.shard_documents(frame.repartition(parts)).collect()
        assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == sorted(want)


def test_awkward_rows(spark):
    docs, rows = awkward(spark)
    for shards in (1, 3, 40):
        got = sh.shard_documents(docs.withColumn("slot", docs.n).withColumn("row", docs.n), shards).collect()
        assert sorted((r.shard, r.slot) for r in got) == sorted((k % shards, k // shards) for k in range(len(rows)))
        assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted(
            (repr(i), len((t or "").encode()) + 16, crc32((t or "").encode())) for i, t in rows)
    assert sh.shard_documents(no_rows(spark)).count() == 0
    with pytest.raises(ValueError):
        sh.shard_documents(docs, 0)


def test_one_key_with_all_rows_is_spread(spark):
    same = spark.createDataFrame([(1, "a b c")] * 4000, "doc_id long, text string").repartition(4)
    got = sh.shard_documents(same)
    assert got.count() == 4000 and got.select("shard", "slot").distinct().count() == 4000
    sizes = got.groupBy("shard").count().agg({"count": "max"}).head()[0]
    assert sizes == 100


def test_written_shards(spark, tmp_path):
    rows = [(i, prose(4, i)) for i in range(200)] + [(3, prose(4, 3)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sh.write_shards(docs, str(tmp_path / "shards"), 7)
    seen = []
    for shard in range(7):
        part = sh.read_shard(spark, str(tmp_path / "shards"), shard).collect()
        assert [r.slot for r in part] == list(range(len(part))) and len(part) in (28, 29)
        assert list(sh.row_at(np.full(len(part), shard), np.arange(len(part)), len(rows), 7)) == [r.row for r in part]
        seen += [(r.doc_id, r.text) for r in part]
    assert sorted(seen, key=repr) == sorted(rows, key=repr)
