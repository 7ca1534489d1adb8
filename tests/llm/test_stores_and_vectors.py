from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from common_rows import awkward, no_rows
from tokenizers import Tokenizer

from newsloom.llm import multi_index, token_store
from newsloom.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tok, at, out = Tokenizer.from_file(TOKENIZER), 0, []
    for ident, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((ident, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def key(row):
    return tuple(-1 if x is None else x for x in row)


def test_store_gives_back_what_the_tokenizer_says(spark, monkeypatch):
    monkeypatch.setattr(token_store, "KEYS_PER_BUCKET", 5)
    _, rows = awkward(spark)
    rows += [(20, " lead"), (21, "a <|endoftext|> b  c\t d\n\n  e'll 's  "), (22, " \x1cx  　y z\xa0w 1234567890 !!??"), (23, "a\n b \nc")]
    # rows of one id stand in the order of the input
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    folder = scratch_path(spark, "store")
    token_store.write_store(docs, folder, TOKENIZER)
    keys = token_store.keys_of(docs)
    got = token_store.read_back(spark, keys, folder, 2).collect()
    assert sorted(map(key, got)) == sorted(map(key, expected(rows)))
    ids = token_store.read_ids(token_store.look_up(keys, folder), folder, 2).filter("doc_id = 6").first().ids
    assert Tokenizer.from_file(TOKENIZER).decode(np.frombuffer(ids, "<u4")[:-1]) == "short text"
    unknown = spark.createDataFrame([(99, 0), (6, 1), (2, 1)], "doc_id long, copy long")
    assert [(r.doc_id, r.copy) for r in token_store.look_up(unknown, folder).collect()] == [(2, 1)]


def test_an_id_over_many_shards(spark):
    rows = [(i // 90, f"text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    folder = scratch_path(spark, "store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write_store(docs, folder, TOKENIZER)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spark.read.parquet(f"{folder}/manifest").count() > 2
    got = token_store.read_back(spark, token_store.keys_of(docs), folder, 2).collect()
    assert sorted(map(key, got)) == sorted(map(key, expected(rows)))


def test_empty_store(spark):
    folder = scratch_path(spark, "store")
    token_store.write_store(no_rows(spark), folder, TOKENIZER)
    assert token_store.read_back(spark, token_store.keys_of(no_rows(spark)), folder, 2).collect() == []


def test_keys_that_never_part_are_still_found(tmp_path):
    import pandas as pd

    n = 1000
    rows = pd.DataFrame({"hash": [7] * 3 + list(range(100, 100 + n)), "fingerprint": range(n + 3), "shard": 0,
                         "offset": range(n + 3), "n": 1})
    token_store._write_bucket(f"file://{tmp_path}", 0, rows)
    index = token_store.Index(str(tmp_path), 0)
    slots = index.slots(rows["hash"].to_numpy(), rows["fingerprint"].to_numpy())
    assert sorted(slots) == list(range(n + 3)) and (index.columns["offset"][slots] == rows["offset"]).all()
    assert (index.slots(np.arange(5000, 5100), np.arange(10 ** 6, 10 ** 6 + 100)) == -1).all()


def vectors(n=600, dim=16):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim))
    for i in range(100, 300):  # near copies, links between some of which fail
        x[i] = x[i % 40] + rng.normal(scale=0.16 + 0.1 * (i % 3), size=dim)
    x[300:340] = x[7]
    return [(i, [float(a) for a in v.astype(np.float32)], i % 2 if i < 500 else None) for i, v in enumerate(x)]


def brute(rows):
    links, parent = {}, {}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    def sound(v, label):
        return label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)

    good = [(i, np.array(v, float), label) for i, v, label in rows if sound(v, label)]
    for i, *_ in rows:
        links[i], parent[i] = 0, i
    for a, (i, v, p) in enumerate(good):
        for j, w, q in good[:a]:
            if p == q and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i in links}


def test_vectors_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 8)
    rows = vectors() + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0, None] + [0.0] * 14, 1),
                        (1004, [], 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [float("inf")] + [1.0] * 15, 0)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.near_vectors(docs).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    found, there = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert found <= there and found >= 0.97 * there
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(got[i][1] != want[i][1] for i in got) <= 0.03 * len(want)
    assert multi_index.near_vectors(docs.limit(0)).collect() == []


def test_cells_come_in_the_order_of_their_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random((5, 7)), rng.random((5, 9))
    for r, cells in enumerate(multi_index.multi_sequence(a, b, 20)):
        total = (a[r][:, None] + b[r][None]).ravel()
        assert np.allclose(total[cells], np.sort(total)[:20])
