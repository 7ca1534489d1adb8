from __future__ import annotations

from collections import Counter

import pytest
from common_rows import awkward, no_rows, prose

from newsloom.llm import ngram_join


def brute(rows, width, part, whole):
    """Per row its set size and the smallest id its links reach."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and whole * both >= part * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[find(i)] = min(least.get(find(i), ident), ident)
    return Counter((ident, len(sets[i]), least.get(find(i), ident)) for i, (ident, _) in enumerate(rows))


def edited(text: str, every: int, mark: str) -> str:
    words = text.split()
    return " ".join(f"{mark}{i}" if i % every == every - 1 else w for i, w in enumerate(words))


@pytest.mark.parametrize("width, part", [(4, 85), (5, 80)])
def test_near_copies_as_by_brute_force(spark, width, part):
    base, other = prose(400, 5), prose(300, 6)
    rows = [(i, edited(base, 100 + i, f"e{i}x")) for i in range(30)]
    rows += [(100 + i, prose(40, 50 + i) + " " + other[:900] + " " + prose(30, 90 + i)) for i in range(25)]
    rows += [(200 + i, other) for i in range(5)] + [(300 + i, edited(other, 25 + i, "q")) for i in range(12)]
    # a chain: each one close to the next, the ends far apart
    words = prose(200, 9).split()
    rows += [(400 + i, " ".join(words[3 * i:3 * i + 150])) for i in range(12)]
    got = ngram_join.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string"), width, part, 100)
    assert Counter(map(tuple, got.collect())) == brute(rows, width, part, 100)


def test_blocks_of_one_row_and_carried_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "SHORT", 2)
    monkeypatch.setattr(ngram_join, "SLICE", 50)
    base = prose(120, 5)
    rows = [(i, edited(base, 9 + i % 30, f"e{i}x")) for i in range(40)]
    got = ngram_join.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    assert Counter(map(tuple, got.collect())) == brute(rows, 4, 85, 100)


def test_awkward_rows(spark):
    docs, rows = awkward(spark)
    assert Counter(map(tuple, ngram_join.ngram_classes(docs, 4, 85, 100).collect())) == brute(rows, 4, 85, 100)
    assert ngram_join.ngram_classes(no_rows(spark)).collect() == []


def test_one_row_of_each_class_stays(spark):
    docs, _ = awkward(spark)
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text if r.text is None else r.text[:12]) for r in kept.collect())
    first, second = prose(60, 1)[:12], prose(30, 2)[:12]
    assert got == Counter({(1, first): 1, (3, None): 1, (4, ""): 1, (5, " \n\t "): 1, (None, None): 1, (6, "short text"): 1,
                           (7, second): 1, (8, prose(6000, 3)[:12]): 1, (9, "é\U0001F600 café"): 1})
