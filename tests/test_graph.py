"""Visiting order and folds of walks, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import graph

NAMES = ["v/1", "v/10", "v/2", "v/1\0", "v/é", "v/\U0001F600", "w/1", "v/1 a", "w/", "v/3"]


def fixture(spark, seed=4, n=16):
    rng = random.Random(seed)
    edges = sorted({(rng.choice(NAMES), rng.choice(NAMES)) for _ in range(n)})
    edges = [(f"e{i}", a, b) for i, (a, b) in enumerate(edges)] + [("again", *edges[0])]
    values = [(v, float(i * 7 % 5) if i % 4 else None) for i, v in enumerate(NAMES[:-1])]
    return (spark.createDataFrame(edges, "_key string, _from string, _to string"), edges,
            spark.createDataFrame(values, "_id string, value double"), dict(values))


def walks(start, edges, depth=3):
    """(path, edge path) of every walk without repeated edges and vertices."""
    out, level = [], [((start,), ())]
    for _ in range(depth + 1):
        out += level
        level = [((*p, b), (*k, e)) for p, k in level for e, a, b in edges if a == p[-1] and b not in p and e not in k]
    return out


@pytest.mark.parametrize("sort", [False, True])
def test_places_of_visits(spark, sort):
    table, edges, vertices, values = fixture(spark)
    order = sorted(values, key=lambda v: (values[v] is None, -(values[v] or 0), v.encode()))
    rank = {v: (0, order.index(v), b"") if v in values else (1, 0, v.encode()) for v in NAMES}
    starts = NAMES[:3]
    walked = graph.traverse(spark.createDataFrame([(s,) for s in starts], "_id string"), table, max_depth=3, vertices=vertices,
                            siblings=[F.col("value").desc_nulls_last()] if sort else None)
    kinds = [("a", "depthfirst", "preorder", False), ("b", "depthfirst", "postorder", False),
             ("c", "breadthfirst", "preorder", True), ("d", "depthfirst", "postorder", True)]
    for name, strategy, how, backward in kinds:
        walked = graph.visited(walked, name, strategy, how, backward)
    got = {(r.start, tuple(r.edge_path)): (r.a, r.b, r.c, r.d) for r in walked.collect()}
    want = {}
    end = (2,)
    for s in starts:
        found = walks(s, edges)
        step = (lambda v: rank[v]) if sort else (lambda v: (0, 0, v.encode()))
        for at, (_, strategy, how, backward) in enumerate(kinds):
            def key(w):
                path = [step(v) for v in w[0]] + ([end] if how == "postorder" else [])
                return ([len(w[0])] if strategy == "breadthfirst" else []), path, "\0".join(w[1])
            for i, w in enumerate(sorted(found, key=key, reverse=backward)):
                want.setdefault((s, w[1]), [0] * 4)[at] = i + 1
    assert {k: list(v) for k, v in got.items()} == want and len(want) > 20
    listed = [tuple(r.edge_path) for r in graph.in_order(walked.filter(F.col("start") == "v/1"), order="postorder").collect()]
    assert sorted(range(1, len(listed) + 1)) == sorted(got["v/1", e][1] for e in listed)
    assert [got["v/1", e][1] for e in listed if len(e) < 2] == sorted(got["v/1", e][1] for e in listed if len(e) < 2)


def test_folds(spark):
    table, edges, vertices, values = fixture(spark)
    starts = NAMES[:4]
    walked = graph.traverse(spark.createDataFrame([(s,) for s in starts], "_id string"), table, max_depth=3)
    folds = {"total": graph.Fold(F.coalesce("value", F.lit(0.0)), F.sum, lambda own, kids: own + F.coalesce(kids, F.lit(0.0))),
             "leaves": graph.Fold(F.lit(1).cast("long"), F.sum, lambda own, kids: F.coalesce(kids, own))}
    got = {(r.start, tuple(r.edge_path)): (r.total, r.leaves) for r in graph.fold(walked, vertices, folds).collect()}
    want = {}
    for s in starts:
        found = walks(s, edges)
        for path, over in found:
            below = [(p, k) for p, k in found if k[:len(over)] == over]
            want[s, over] = (sum(values.get(p[-1]) or 0 for p, _ in below),
                             sum(not any(k2[:-1] == k and k2 != k for _, k2 in found) for _, k in below))
    assert got == want
    assert graph.fold(walked.limit(0), vertices, folds).columns == [*walked.columns, "total", "leaves"]
    with pytest.raises(ValueError):
        graph.visited(walked, order="sideways")


def test_only_a_crowded_vertex_is_salted(spark, monkeypatch):
    monkeypatch.setattr(graph, "CROWDED", 50)
    monkeypatch.setattr(graph, "CROWDED_PART", 4)
    edges = [(f"e{i}", "hub/0", f"v/{i}") for i in range(200)] + [(f"f{i}", f"v/{i}", f"w/{i}") for i in range(200)]
    edges += [("null", "v/0", None), (None, "v/1", "w/0")]
    table = spark.createDataFrame(edges, "_key string, _from string, _to string")
    crowded = graph._crowded(table.withColumnRenamed("_from", "at"))
    named = spark.createDataFrame([("hub/0",), *[(f"v/{i}",) for i in range(200)]], "_id string")
    assert [r[0] for r in named.filter(crowded(F.col("_id"))).collect()] == ["hub/0"]
    out = graph.traverse(named.limit(1), table, max_depth=2)
    assert out.filter("depth = 1").count() == 200 and out.filter("depth = 2").count() == 200
    # starts move once, not once per salt, and the last level is not written
    back = graph.traverse(named.filter("_id <> 'hub/0'"), table, "inbound", min_depth=1, max_depth=3)
    assert back.count() == 200 and "ExistingRDD[start" not in back.select("start", "path")._jdf.queryExecution().executedPlan().toString()
    rows = [r for r in back.collect()]
    assert {(r.start, r.vertex, tuple(r.path), tuple(r.edge_path)) for r in rows} == {
        (f"v/{i}", "hub/0", (f"v/{i}", "hub/0"), (f"e{i}",)) for i in range(200)}
