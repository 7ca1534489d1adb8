"""Queues: bounded consumption, acknowledgement, replay."""

import pytest
from pyspark.sql import functions as F

from newsloom.sources import consume as co
from newsloom.sources.queues import publish_by_key


def publish(spark, path, batch, keys, publisher="main", parts=3):
    rows = [(f"{publisher}{batch}-{i}", k) for i, k in enumerate(keys)]
    publish_by_key(spark.createDataFrame(rows, "URL string, routing_key string").repartition(parts), path, batch, publisher)


SCHEMA = "URL string, note int"


class Sink:
    def __init__(self, fail=False):
        self.seen, self.fail = [], fail

    def __call__(self, batch, batch_id):
        self.seen.append((batch_id, sorted(r.URL for r in batch.collect())))
        if self.fail:
            raise RuntimeError("sink lost")


def left(spark, path):
    return {r.routing_key: r.pending for r in co.pending(spark, path).collect()}


def run(spark, path, limit, key="a", fail=False):
    from pyspark.sql.types import StructType

    sink = Sink(fail)
    co.consume(spark, path, key, StructType.fromDDL(SCHEMA), sink, limit)
    return sink.seen


def test_bounded_runs_take_every_message_once(spark, tmp_path):
    path = str(tmp_path / "queue")
    publish(spark, path, 0, "aabab")
    publish(spark, path, 1, "aaaa")
    publish(spark, path, 0, "aab", "other")
    assert left(spark, path) == {"a": 9, "b": 3}
    got = []
    for limit, rest in ((2, 7), (4, 3), (100, 0)):
        seen = run(spark, path, limit)
        assert sum(len(urls) for _, urls in seen) == min(limit, 9 - len(got))
        got += [u for _, urls in seen for u in urls]
        assert left(spark, path) == {"a": rest, "b": 3}
    assert len(set(got)) == len(got) == 9
    # a batch that comes later is taken from where the last run stopped
    publish(spark, path, 2, "ba")
    assert left(spark, path) == {"a": 1, "b": 4}
    assert [urls for _, urls in run(spark, path, None)] == [["main2-1"]]
    assert len(run(spark, path, None, "b")[0][1]) == 4 and left(spark, path) == {"a": 0, "b": 0}
    assert not any(urls for _, urls in run(spark, path, 5, "nothing of that name"))


def test_a_failed_run_is_repeated(spark, tmp_path):
    path = str(tmp_path / "queue")
    publish(spark, path, 0, "aaaaaaa")
    first = run(spark, path, 3)
    with pytest.raises(Exception):
        run(spark, path, 3, fail=True)
    assert left(spark, path) == {"a": 4}
    # the same messages under the same batch id, whatever the limit is now
    again = run(spark, path, 1)
    assert [(b, len(u)) for b, u in again][:1] == [(1, 3)]
    rest = run(spark, path, 100)
    urls = [u for seen in (first, again, rest) for _, us in seen for u in us]
    assert sorted(set(urls)) == sorted(urls) and len(urls) == 7 and left(spark, path) == {"a": 0}


def test_micro_batches_of_a_running_stream(spark, tmp_path):
    from pyspark.sql.types import StructType

    path = str(tmp_path / "queue")
    publish(spark, path, 0, "aaaaa", parts=2)
    sink = Sink()
    stream = co.message_stream(spark, path, "a", StructType.fromDDL(SCHEMA), 2)
    assert stream.columns == ["URL", "note"]
    query = (stream.writeStream.foreachBatch(sink).trigger(processingTime="0 seconds")
             .option("checkpointLocation", str(tmp_path / "log")).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [len(urls) for _, urls in sink.seen] == [2, 2, 1]
    # the last micro-batch is acknowledged when the next one starts
    assert left(spark, path) == {"a": 1}


def test_rows_of_large_files_are_cut_into_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "queue")
    rows = spark.range(1000).select(F.col("id").cast("string").alias("URL"), F.lit("a").alias("routing_key")).coalesce(1)
    publish_by_key(rows, path)
    monkeypatch.setattr(co, "TASK_ROWS", 64)
    source = co.QueueStream({"path": path, "routingkey": "a"}, spark.createDataFrame([], "URL string").schema)
    mid = source.queue.ahead({}, 333)
    parts = [*source.partitions({}, mid), *source.partitions(mid, source.queue.ahead(mid, None))]
    assert max(p.last - p.first for p in parts) == 64
    urls = [u for p in parts for b in source.read(p) for u in b.column(0).to_pylist()]
    assert sorted(map(int, urls)) == list(range(1000))
