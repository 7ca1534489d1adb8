from __future__ import annotations

import itertools

from common_rows import awkward, no_rows, prose
from pyspark.sql import functions as F

from newsloom.llm import decontamination as d
from newsloom.llm.common import settle, sieve


def items(spark):
    return spark.createDataFrame([(0, prose(40, 21)), (1, prose(13, 22)), (2, prose(9, 23)), (3, prose(5, 24)), (4, None), (5, prose(8, 25)),
                                  (6, "two words"), (7, prose(12, 26)), (8, prose(7, 27)), (9, "again again again again again again")], "item_id long, text string")


def test_the_first_mask_meets_every_pair_of_substitutions():
    mask = d.MASKS[0]
    for gone in itertools.combinations(range(d.SPAN), d.SUBSTITUTIONS):
        assert any(all(s + k not in gone for k in mask) for s in range(d.SPAN - d.REACH + 1))


def test_the_short_mask_meets_every_substitution():
    for n in range(d.REACH, d.SPAN):
        for gone in range(n):
            assert any(all(s + k != gone for k in d.SHORT_MASK) for s in range(n - d.SHORT_MASK[-1]))


def changed(text, places):
    return " ".join("other" if i in places else w for i, w in enumerate(text.split()))


def brute(docs, bench):
    out = {}
    for i, text in docs:
        w = (text or "").lower().split()
        for k, item in bench:
            v = (item or "").lower().split()
            span = min(d.SPAN, len(v))
            if not v or len(v) < d.LEAST_PASSAGE and v != w:
                continue
            for start in range(1 - len(v), len(w)):
                same = [0 <= start + x < len(w) and w[start + x] == v[x] for x in range(len(v))]
                best = max(sum(same[x:x + span]) for x in range(len(v) - span + 1))
                if best >= span - (d.SUBSTITUTIONS if len(v) >= d.SPAN else len(v) >= d.REACH):
                    n, places = out.get((i, k), (0, 0))
                    out[i, k] = (max(n, best), places + 1)
    return out


def test_overlaps_as_by_brute_force(spark):
    bench = [tuple(r) for r in items(spark).collect()]
    long, exact, short = bench[0][1], bench[1][1], bench[2][1]
    docs = [(1, prose(50, 1) + " " + long + " " + prose(20, 2)), (2, changed(exact, {3, 9})), (3, changed(exact, {3, 6, 9})),
            (4, short), (5, changed(short, {4})), (6, " ".join(long.split()[20:33])), (7, " ".join(long.split()[20:32])),
            (8, bench[3][1] * 3), (9, prose(400, 3)), (10, f"{exact} {prose(9, 4)} {exact}"), (11, " ".join(long.split()[30:])),
            (12, changed(long, set(range(0, 40, 6)))), (13, "Two WORDS"), (14, "two words more"), (15, bench[8][1]), (16, changed(bench[8][1], {3})),
            (17, prose(9, 5) + " " + bench[8][1]), (18, bench[3][1]), (19, "again " * 30), (20, bench[5][1] + " " + changed(bench[5][1], {4, 5}))]
    docs += [(30 + i, changed(bench[k][1], {i})) for k in (5, 7) for i in range(k + 3 if k == 5 else 12)]
    for limit in (10 ** 6, 0):
        got = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), items(spark), limit)
        assert {(r.doc_id, r.item_id): (r.n_equal, r.n_places) for r in got.collect()} == brute(docs, bench)


def test_one_passage_in_every_document(spark):
    passage = prose(30, 9)
    docs = [(i, f"{prose(i % 7, i)} {passage} {prose(i % 5, i + 1)}") for i in range(400)]
    bench = [(0, passage), (1, prose(3, 1) + " " + passage), (2, prose(20, 2))]
    table, items_ = spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    for limit in (10 ** 6, 0):
        got = d.overlaps(table, items_, limit).collect()
        assert {(r.doc_id, r.item_id): (r.n_equal, r.n_places) for r in got} == want and len(want) == 800
    assert d.drop_contaminated(table, items_).count() == 0


def test_awkward_rows(spark):
    docs, rows = awkward(spark)
    bench = spark.createDataFrame([(0, prose(60, 1)), (0, prose(60, 1))], "item_id long, text string")
    assert sorted((r.doc_id or 0) for r in d.overlaps(docs, bench).collect()) == [0, 1, 2]
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert d.overlaps(no_rows(spark), bench).count() == 0
    assert d.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_a_sieve_lets_all_its_hashes_pass_and_few_others(spark):
    some = spark.range(5000).select(F.xxhash64("id").alias("h")).localCheckpoint()
    passes = sieve(some, 5000)
    assert some.filter(passes(F.col("h"))).count() == 5000
    assert spark.range(10 ** 6, 10 ** 6 + 100_000).filter(passes(F.xxhash64("id"))).count() < 1000
    assert some.filter(sieve(some.limit(0), 0)(F.col("h"))).count() == 0


def test_what_is_moved_does_not_grow_with_copies_of_an_item(spark, monkeypatch):
    passage = prose(30, 9)
    docs = spark.createDataFrame([(i, f"{prose(900, i)} {passage}") for i in range(20)] + [(99, prose(900, 99))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, passage) for k in range(50)], "item_id long, text string")
    for limit in (10 ** 6, 0):
        moved = {}

        def settled(df, name):
            moved[name] = (settle(df, name), df.columns)
            return moved[name][0]

        monkeypatch.setattr(d, "settle", settled)
        assert d.overlaps(docs, bench, limit).count() == 20 * 50
        # numbers of the alignments of 20 documents and a few strays, no words, whatever the number of items
        hits, columns = moved["hits"]
        assert 20 <= hits.count() < 40 and "words" not in columns and moved["items"][0].count() == 1


def test_documents_are_dropped_without_a_row_per_copy_of_an_item(spark, monkeypatch):
    passage = prose(30, 9)
    docs = spark.createDataFrame([(None, passage), (1, f"{prose(9, 1)} {passage}"), (2, prose(40, 2)), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, passage) for k in range(50)] + [(None, prose(40, 2))], "item_id long, text string")
    written = {}
    monkeypatch.setattr(d, "settle", lambda df, name: written.setdefault(name, settle(df, name)))
    # an item without an id is not searched
    assert sorted(r.doc_id for r in d.drop_contaminated(docs, bench).collect()) == [2, 3]
    assert 2 <= written["hits"].count() < 10 and written["items"].count() == 1
