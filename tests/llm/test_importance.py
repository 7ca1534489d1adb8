from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from common_rows import awkward, no_rows, prose

from newsloom.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def runs(text):
    w = WORD.findall((text or "").translate(UPPER))
    return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f):
    return crc32(f.encode()) % 10000


def brute(docs, target, part=5, whole=100):
    """Sorted rows (doc_id, n_features, weight, score, rank)."""
    s = Counter(bucket(f) for _, t in docs for f in runs(t)[1])
    t = Counter(bucket(f) for x in target for f in runs(x)[1])
    ns, nt = sum(s.values()) + 10000, sum(t.values()) + 10000
    rows = []
    for i, text in docs:
        n, fs = runs(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([n, i, len(fs), weight, score])
    able = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[:part * len(able) // whole])}
    return sorted(((*r[1:], ranks.get(id(r))) for r in rows), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_as_by_brute_force(spark, monkeypatch):
    docs = [(i, prose(5 + 7 * i % 60, i, "ABé"[i % 3]) + ("?! \n" if i % 4 else " 12-x")) for i in range(90)]
    target = [prose(40, 3), prose(30, 4, "é"), None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert rows_of(im.resample(frame, bench, 35, 100)) == brute(docs, target, 35, 100)
    assert rows_of(im.resample(frame, bench)) == brute(docs, target)
    # a document of several lists of words has the same features
    monkeypatch.setattr(im, "SLICE", 16)
    monkeypatch.setattr(im, "COUNTED", 10)
    for _, text in docs[:20]:
        assert sorted(h for _, hs in im.features(text.encode()) for h in hs) == sorted(crc32(f.encode()) for f in runs(text)[1])


def test_quickselect_finds_every_place(spark):
    rows = [(s, i) for s, i in zip([5, 3, 3, 9, 3, 3, 1, 9, 3, 3, -2, 7], [1, 2, 2, 4, None, 2, 3, 4, 1, 8, 6, 5])] * 3
    frame = spark.createDataFrame(rows, "score long, doc_id long").repartition(5).cache()
    ordered = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1]))
    for k in (1, 2, 7, 18, 30, len(rows)):
        key = im.kth_key(frame, k, pivots=2)
        got = frame.limit(1).select(key.alias("k")).head().k
        assert (-got.a, got.c) == ordered[k - 1]
    assert im.kth_key(frame, len(rows) + 1, pivots=2) is None


def test_awkward_rows(spark):
    docs, rows = awkward(spark)
    got = im.resample(docs.withColumn("rank", docs.n).withColumn("weight", docs.n), spark.createDataFrame([(prose(60, 1),)], "text string"), 1, 2)
    assert rows_of(got) == brute(rows, [prose(60, 1)], 1, 2)
    # the repeated rows share a key, and the last place falls between them
    same = spark.createDataFrame([(1, prose(30, 5))] * 9 + [(2, prose(30, 6))], "doc_id long, text string")
    ranked = im.resample(same, no_rows(spark), 1, 2)
    assert sorted(r["rank"] for r in ranked.filter("rank IS NOT NULL").collect()) == [1, 2, 3, 4, 5]
    assert ranked.count() == 10
    assert im.resample(no_rows(spark), no_rows(spark)).count() == 0


def test_drawn_documents_keep_their_columns(spark):
    docs, rows = awkward(spark)
    ranked = im.resample(docs.dropDuplicates(["doc_id", "text"]), no_rows(spark), 1, 2)
    kept = im.drawn_documents(docs.dropDuplicates(["doc_id", "text"]), ranked)
    assert kept.columns == docs.columns
    want = {(r.doc_id) for r in ranked.filter("rank IS NOT NULL").collect()}
    assert {r.doc_id for r in kept.collect()} == want and len(want) == kept.count() == 2
