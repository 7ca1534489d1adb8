"""Steps of two-means over large clusters."""

import numpy as np
from pyspark.sql import functions as F

from newsloom.operators import cluster


def test_steps_move_no_vectors(spark, monkeypatch):
    """Centres go to the rows: while clusters are divided, no plan joins the rows with a shuffle, and labels stay those of one task."""
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=4) + 3 * (i % 3)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, vec array<double>").repartition(5)
    plans = []
    inner = cluster._split

    def split(work, key, level):
        out = inner(work, key, level)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(cluster, "_split", split)
    by_steps = {x.k: x.cluster for x in cluster.size_bounded_clusters(df, "k", 40, 4, local_bytes=0).collect()}
    assert plans and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
    by_task = {x.k: x.cluster for x in cluster.size_bounded_clusters(df, "k", 40, 4).collect()}
    assert by_steps == by_task


def test_clusters_are_told_apart_without_moving_rows(spark):
    """Which clusters are too large is a short list: rows meet it where they are, and move once, to the task of their cluster."""
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(200)], "k long, vec array<double>").repartition(3)
    found = cluster.size_bounded_clusters(df, "k", 20, 4, local_bytes=2000)
    sizes = [x["n"] for x in found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 200 and max(sizes) <= 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_late_steps_take_no_job_each(spark, monkeypatch):
    """Rows near the border take the late steps in one task, and the labels are those of one task."""
    r = np.random.default_rng(11)
    rows = [(i, r.uniform(-1, 1, size=3).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, vec array<double>").repartition(4)
    jobs, steps, inner, margin = [], [], cluster._side_sums, cluster._margin
    monkeypatch.setattr(cluster, "_margin", lambda v, c: steps.append(1) or margin(v, c))
    cluster._two_means(np.array([v for _, v in rows]))
    monkeypatch.setattr(cluster, "_margin", margin)
    monkeypatch.setattr(cluster, "_side_sums", lambda shared: jobs.append(1) or inner(shared))
    # a border of at most 400 rows
    monkeypatch.setattr(cluster, "BORDER_BYTES", 400 * 8 * 3, raising=False)
    by_steps = {x.k: x.cluster for x in cluster.size_bounded_clusters(df, "k", 1000, 3, levels=1, local_bytes=0).collect()}
    assert len(jobs) < len(steps) // 2
    by_task = {x.k: x.cluster for x in cluster.size_bounded_clusters(df, "k", 1000, 3, levels=1).collect()}
    assert by_steps == by_task
