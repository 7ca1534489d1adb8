"""Keyed state of streams: late rows, timers, polls."""

import time

from pyspark.sql import functions as F

from newsloom.streaming import feeds, liveness


def run(spark, tmp_path, df, name):
    query = (df.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / f"{name}-log")).start(str(tmp_path / name)))
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / name)).collect()


def files(spark, tmp_path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_late_outcomes_do_not_override_and_timers_report(spark, tmp_path):
    batches = [[("a", 100, 1, "beat"), ("b", 100, 2, "beat"), ("c", 90, 3, "error"), ("d", 100, 8, "timeout")],
               [("a", 110, 5, "error"), ("a", 105, 4, "beat"), ("b", 99, 6, "error"), ("c", 95, 7, "beat"), ("d", 100, 7, "beat")],
               [("z", 400, 9, "beat")], [("z", 401, 10, "beat")]]
    rows = [[(e, float(s), n, o) for e, s, n, o in b] for b in batches]
    stream = files(spark, tmp_path, rows, "emitter string, s double, seq long, outcome string").withColumn("ts", F.timestamp_seconds("s"))
    got = run(spark, tmp_path, liveness.liveness_stream(stream, "emitter", 50, late="30 seconds"), "out")
    told = {}
    for r in sorted(got, key=lambda r: (r.at, r.seq, r.beat is not None)):
        told.setdefault(r.emitter, []).append((r.at.timestamp(), r.status))
    # an older outcome and an older beat change nothing; the last beat counts for the timer
    assert told["a"] == [(100, "alive"), (110, "dead"), (155, "slow")]
    assert told["b"] == [(100, "alive"), (150, "slow")]
    assert told["c"][-1] == (145, "slow") and (95, "alive") in told["c"]
    # a timeout stays one, whatever the beat's age
    assert {s for _, s in told["d"]} == {liveness.TIMED_OUT}
    assert told["z"][-1] == (401, "alive")


def test_a_link_gone_for_a_poll_passes_again(spark, tmp_path):
    # (link, poll, seq, ref, good)
    rows = [("a", 0, 0, 5.0, True), ("a", 1, 1, 5.0, True), ("a", 2, 2, 4.0, True), ("a", 4, 3, 4.0, True), ("a", 5, 4, 5.0, False),
            ("a", 6, 5, 4.0, True), ("a", 7, 6, 4.5, True), ("a", 9, 7, 1.0, False), ("a", 10, 8, 1.0, True), ("b", 3, 9, 1.0, True), ("b", 3, 10, 2.0, True)]
    want = {0, 3, 6, 8, 9, 10}
    schema = "link string, poll long, seq long, ref double, good boolean"
    table = spark.createDataFrame(rows, schema)
    assert {r.seq for r in feeds.new_versions(table, ["link"], "seq", "ref", F.col("good"), width=2, poll="poll").collect()} == want
    batches = [[r for r in rows if r[1] in polls] for polls in ((0, 1), (2, 3, 4), (5, 6, 7), (9, 10))]
    stream = feeds.version_stream(files(spark, tmp_path, batches, schema), ["link"], "seq", "ref", "good", None, "poll")
    assert {r.seq for r in run(spark, tmp_path, stream, "out")} == want
