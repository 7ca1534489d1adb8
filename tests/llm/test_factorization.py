from __future__ import annotations

import numpy as np
from common_rows import awkward, no_rows, prose

from newsloom.llm import factorization as fm, quality, toxicity


def test_pair_sum_by_the_square_of_the_sum():
    rng = np.random.default_rng(3)
    w, v = rng.normal(size=9), rng.normal(size=(9, 4))
    rows = [[0, 3, 5], [], [8], [1, 2, 3, 4, 5]]
    flat, sizes = np.array([i for r in rows for i in r]), np.array([len(r) for r in rows])
    want = [0.5 + w[r].sum() + sum(v[a] @ v[b] for x, a in enumerate(r) for b in r[:x]) for r in rows]
    assert np.allclose(fm.logits(0.5, w, v, flat, sizes), want)


def test_pairs_that_no_linear_weight_catches():
    """Label 1 only where both of two features are there; each by itself says little."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(1500):
        r = {i for i in range(6) if rng.random() < .5}
        rows.append(np.array(sorted(r), np.int64))
        labels.append(float((0 in r) == (1 in r)))
    labels = np.array(labels)
    kept = fm.LEAST_Z
    try:
        fm.LEAST_Z = 0.0
        model = fm.fit(rows, labels, factors=4, epochs=60)
    finally:
        fm.LEAST_Z = kept
    place = {b: i for i, b in enumerate(model.buckets)}
    flat = np.array([place[i] for r in rows for i in r])
    got = fm.logits(model.w0, model.w, model.v, flat, np.array([len(r) for r in rows])) > 0
    assert (got == labels).mean() > 0.95


def test_terms_that_say_something_only_in_a_pair():
    """The same with the production constants, in prose where neither of two words leans to a label by itself."""
    rng = np.random.default_rng(5)
    group, insult = fm.bucket("group"), fm.bucket("insult")
    rows, labels = [], []
    for i in range(1200):
        a, b = i % 2, i // 2 % 2
        own = {fm.bucket(f"w{x}") for x in rng.choice(400, 30, replace=False)} | ({group} if a else set()) | ({insult} if b else set())
        rows.append(np.array(sorted(own), np.int64))
        labels.append(float(a == b))
    labels = np.array(labels)
    assert not {group, insult} & set(fm.screened(rows[:900], labels[:900]).tolist())
    model = fm.fit(rows[:900], labels[:900])
    assert {group, insult} <= set(model.buckets.tolist())
    own = fm._own(rows[900:], model.buckets)
    got = fm.logits(model.w0, model.w, model.v, np.concatenate(own), np.array([len(o) for o in own])) > 0
    assert (got == labels[900:]).mean() > 0.95
    # labels by chance: no pair is taken for one
    assert len(fm.paired(rows, rng.integers(0, 2, 1200).astype(float), np.full(1200, .5))) == 0


def corpus(spark):
    rows = [(i, prose(40, i) + (" you utter blockhead" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 != 0)) for i, _ in rows] + [(3, None, None), (None, 1, 1)],
                                   "doc_id long, toxic int, quality int")
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    model = toxicity.train_toxicity(docs, labels)
    for r in toxicity.score_toxicity(docs, model).collect():
        assert (r.score >= toxicity.THRESHOLD) == (r.doc_id % 4 == 0)
    model = quality.train_quality(docs, labels)
    right = [(r.score >= quality.THRESHOLD) == (r.doc_id % 4 != 0) for r in quality.score_quality(docs, model).collect()]
    assert np.mean(right) > 0.97


def test_awkward_rows(spark):
    docs, rows = awkward(spark)
    _, labels = corpus(spark)
    model = toxicity.train_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, model)
    assert set(scored.columns) == set(docs.columns) and scored.count() == len(rows)
    assert all(0 <= r.score <= 1 for r in scored.collect())
    none = quality.train_quality(no_rows(spark), labels.limit(0))
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.score_quality(docs, none).collect())
    assert quality.score_quality(no_rows(spark), none).collect() == []
