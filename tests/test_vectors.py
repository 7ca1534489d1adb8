"""Vector operators against brute force, and every alternative path against the usual one."""

import numpy as np
from pyspark.sql import functions as F

from newsloom.operators import cluster, duplicates, embed, nearest
from newsloom.plans.search import search, similar_docs
from newsloom.sources.model import WordModel

RNG = np.random.default_rng(5)


def unit(n, dim=8):
    m = RNG.normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def table(spark, m, name="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, vec array<double>")


def model(spark, limit=1 << 20):
    words = [f"w{i}" for i in range(30)]
    rows = [(w, i, v.tolist()) for i, (w, v) in enumerate(zip(words, unit(30)))]
    return WordModel(spark.createDataFrame(rows, "word string, idx long, vec array<double>"), limit)


def texts(spark):
    docs = [(d, [" ".join(f"w{RNG.integers(0, 40)}" for _ in range(6)) for _ in range(d % 5 + 1)]) for d in range(20)]
    return spark.createDataFrame(docs + [(20, ["nothing known"]), (21, [])], "id long, sentences array<string>")


def as_map(df):
    return {r.id: None if r.vec is None else np.array(r.vec) for r in df.collect()}


def test_broadcast_and_join_agree(spark):
    docs, m = texts(spark).cache(), model(spark)
    m.table.cache()
    joined = WordModel(m.table, limit=0)
    assert m.fits and not joined.fits
    for mode in ("mean", "core"):
        a, b = (as_map(embed.score_docs(docs, x, mode, key="id")) for x in (m, joined))
        assert a.keys() == b.keys() and a[20] is None and b[20] is None and a[21] is None
        assert all(np.allclose(a[k], b[k], atol=1e-9) for k in a if a[k] is not None)


def test_nearest_pivot_in_slabs(spark):
    """Vectors of any length, ties among them: one slab or many, the answer is the same."""
    rows, piv = unit(200) * np.linspace(0.1, 9, 200)[:, None], unit(40) * np.linspace(3, 0.2, 40)[:, None]
    piv[17] = piv[5]
    want = (rows @ piv.T).argmax(axis=1)
    df = table(spark, rows)
    pivots = table(spark, piv, "partition")
    for limit in (1 << 20, piv.nbytes // 4):
        found = nearest.nearest_pivot(df, pivots, limit=limit)
        assert {r.id: r.partition for r in found.collect()} == dict(enumerate(want))
        assert found.columns == [*df.columns, "partition", "similarity"]


def test_rank_in_slabs(spark):
    piv = unit(12)
    queries, pivots = table(spark, unit(10)), table(spark, piv, "partition").withColumn("nDocs", F.lit(5).cast("long"))
    for budget in (None, 20):
        a = nearest.rank_partitions(queries, pivots, "id", budget).select("id", "partition", "rank")
        b = nearest.rank_partitions(queries, pivots, "id", budget, limit=piv.nbytes // 3).select("id", "partition", "rank")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_best_products_and_medoids_in_slabs_without_cross_joins(spark):
    from newsloom.operators import cluster

    x, y = unit(30), unit(50)
    left, right = table(spark, x, "i"), table(spark, y, "j")
    products = x @ y.T
    for limit in (1 << 20, y.nbytes // 4):
        found = nearest.best_products(left, right, "i", "j", "j", top=3, limit=limit)
        assert "Cartesian" not in plan_of(found) and "NestedLoop" not in plan_of(found)
        best = {}
        for r in found.collect():
            assert abs(r.similarity - products[r.i, r.j]) < 1e-12
            best.setdefault(r.i, []).append((-r.similarity, r.j))
        assert all([j for _, j in sorted(best[i])[:3]] == list(np.argsort(-products[i], kind="stable")[:3]) for i in range(30))
        near = cluster.medoids(right, left, "j", "i", limit=limit)
        assert "Cartesian" not in plan_of(near) and "NestedLoop" not in plan_of(near)
        d = ((x[:, None] - y[None]) ** 2).sum(axis=2)
        assert {r.i: r.j for r in near.collect()} == dict(enumerate(d.argmin(axis=1)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocked_dot_over_many_cells(spark):
    a, b = unit(30), unit(25)
    left, right = (table(spark, m, n).withColumn("k", F.lit(1)) for m, n in ((a, "i"), (b, "j")))
    got = {(r.i, r.j): r.similarity for r in nearest.blocked_dot(left, right, ["k"], "i", "j", cell=7).collect()}
    assert len(got) == 750 and all(abs(got[i, j] - a[i] @ b[j]) < 1e-12 for i, j in got)


def test_duplicates_brute_force(spark):
    m = unit(40)
    m = np.vstack([m, m[3:9], m[5:6], m[10:12] + 1e-8, m[10:11]])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    # most rows the same vector, and vectors that share grid cells without being equal
    m = np.vstack([m, np.repeat(m[:1], 60, axis=0), m[:1] + np.r_[np.zeros(7), 3e-5]])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    same = np.round(m @ m.T, 12) == 1
    want = {j: int(np.flatnonzero(same[:j, j])[0]) for j in range(len(m)) if same[:j, j].any()}
    df = table(spark, m).withColumn("url", F.col("id").cast("string"))
    got = {r.id: int(r.dupliURL) for r in duplicates.flag_vector_duplicates(df, "id", "url", 8).collect()}
    assert got == want


def test_clusters_split_equal_vectors(spark):
    m = np.vstack([unit(60), np.repeat(unit(1), 50, axis=0)])
    found = cluster.size_bounded_clusters(table(spark, m), "id", 12, 8)
    sizes = [r["count"] for r in found.groupBy("cluster").count().collect()]
    assert max(sizes) <= 12 and sum(sizes) == 110 and found.select("id").distinct().count() == 110


def one_by_one(docs, part, piv, queries, wanted):
    """(query, document, rank) by visiting partitions in turn."""
    want = set()
    for q, (v, n) in enumerate(zip(queries, wanted)):
        seen, count = set(), 0
        for rank, p in enumerate(sorted(range(len(piv)), key=lambda i: (piv[i] @ v, i), reverse=True), 1):
            if count >= n:
                break
            sims = {d: docs[d] @ v for d in np.flatnonzero(part == p)}
            new = {d for d, s in sims.items() if round(s, 10) not in seen}
            want |= {(q, int(d), rank) for d in new}
            count += len(new)
            seen |= {round(sims[d], 10) for d in new}
    return want


def test_similar_docs_against_the_loop(spark):
    docs, piv, queries, n = unit(120), unit(9), unit(6), 30
    part = (docs @ piv.T).argmax(axis=1)
    # a query whose first partitions repeat one similarity is sent to another round
    docs[part == part[0]] = docs[0]
    want = one_by_one(docs, part, piv, queries, [n] * 6)
    d = spark.createDataFrame([(i, int(p), v.tolist()) for i, (p, v) in enumerate(zip(part, docs))],
                              "doc_id long, partition long, vec array<double>")
    got = similar_docs(table(spark, queries, "query_id"), d, table(spark, piv, "partition"), n)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got.collect()} == want


def test_search_goes_on_from_a_page(spark):
    docs, piv, queries = unit(150), unit(12), unit(7)
    part = (docs @ piv.T).argmax(axis=1)
    docs[part == part[0]] = docs[0]
    d = spark.createDataFrame([(i, int(p), v.tolist()) for i, (p, v) in enumerate(zip(part, docs))],
                              "doc_id long, partition long, vec array<double>")
    q = table(spark, queries, "query_id").withColumn("want", F.col("query_id") * 9)
    p = table(spark, piv, "partition")
    page = search(q, d, p, F.col("want"))
    found = {tuple(r) for r in page.kept.collect()}
    more = search(q, d, p, F.col("want") + 25, so_far=page)
    rest = {tuple(r) for r in more.kept.collect()}
    assert found < rest and len(rest) == more.kept.count()
    for n, so_far in ((F.col("want"), None), (F.col("want") + 25, page)):
        got = similar_docs(q, d, p, n, so_far=so_far)
        single = one_by_one(docs, part, piv, queries, [9 * i + (25 if so_far else 0) for i in range(7)])
        assert {(r.query_id, r.doc_id, r["rank"]) for r in got.collect()} == single
    sizes = np.bincount(part, minlength=12)
    needed = {i: r for i, _, r in sorted(one_by_one(docs, part, piv, queries, [9 * i for i in range(7)]), key=lambda x: x[2])}
    for r in page.cursor.collect():
        order = sorted(range(12), key=lambda i: (piv[i] @ queries[r.query_id], i), reverse=True)
        least = sum(sizes[k] for k in order[:needed.get(r.query_id, 0)])
        assert r.scored == sum(sizes[k] for k in order[:r.visited]) <= 2 * max(least, 9 * r.query_id) + max(sizes)
    assert page.cursor.filter("query_id = 0").head().visited == 0
    assert similar_docs(q.limit(0), d, p, 5).count() == 0 and search(q, d, p, 0).kept.count() == 0


def test_duplicates_in_a_hot_cell(spark):
    rng = np.random.default_rng(11)
    # some coordinates are zero for all, one is close to 1, and the rest lie within less than a cell of each other
    m = np.zeros((900, 16))
    m[:, 3], m[:, 5:9] = 1.0, rng.normal(size=(900, 4)) * 4e-5
    m[450:500] = m[:50]
    m[500:520, 5] = m[60:80, 5] + 3e-8
    m[500:520, 6:9] = m[60:80, 6:9]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    same = np.round(m @ m.T, 12) == 1
    want = {j: int(np.flatnonzero(same[:j, j])[0]) for j in range(len(m)) if same[:j, j].any()}
    df = table(spark, m).withColumn("url", F.col("id").cast("string"))
    assert {r.id: int(r.dupliURL) for r in duplicates.flag_vector_duplicates(df, "id", "url", 16).collect()} == want
    groups = df.select(F.col("id").alias("own"), "vec")
    sizes = [r["count"] for r in duplicates._in_cells(groups, 16).groupBy("bucket").count().collect()]
    # linear work: no cell holds a large part of the rows, though all of them began in a few
    assert max(sizes) <= 2 * duplicates.MOST and sum(sizes) < 4 * len(m) and 70 <= len(want) < 500


def test_clusters_divided_by_joins_and_by_tasks(spark):
    centres = unit(5) * 3
    m = np.vstack([centres[i % 5] + unit(1)[0] * 0.3 for i in range(300)])
    df = table(spark, m).withColumn("g", F.col("id") % 2)
    got = {}
    for local in (0, 32 << 20):
        found = cluster.size_bounded_clusters(df, "id", 40, 8, group="g", local_bytes=local)
        got[local] = {r.id: r.cluster for r in found.collect()}
    assert got[0] == got[32 << 20] and len(got[0]) == 300
    sizes = np.unique(list(got[0].values()), return_counts=True)[1]
    assert sizes.max() <= 40 and all(c.startswith(f"{i % 2}:") for i, c in got[0].items())
    # converged: after the first split no row is nearer to the mean of the other side
    once = {r.id: r.cluster for r in cluster.size_bounded_clusters(df, "id", 1, 8, levels=1).collect()}
    side = np.array([once[i] == ":1" for i in range(300)])
    a, b = m[~side].mean(axis=0), m[side].mean(axis=0)
    assert (side == (((m - b) ** 2).sum(axis=1) < ((m - a) ** 2).sum(axis=1))).all()
    # equal vectors are divided as well, either way
    same = table(spark, np.repeat(m[:1], 64, axis=0))
    for local in (0, 32 << 20):
        sizes = [r["count"] for r in cluster.size_bounded_clusters(same, "id", 10, 8, local_bytes=local).groupBy("cluster").count().collect()]
        assert sum(sizes) == 64 and max(sizes) <= 10
    assert cluster.size_bounded_clusters(same.limit(0), "id", 10, 8).count() == 0
