"""Which emitters are alive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from ..operators.running import previous_max

NEVER, TIMED_OUT = "unknown (never tried)", "unknown (timed out)"


def liveness(probes: DataFrame, emitters: DataFrame, key: str, now: Column, max_lag: float) -> DataFrame:
    """``(key, status)`` at ``now`` of every emitter.

    ``probes(key, ts, seq, outcome)`` with outcome ``beat``, ``timeout`` or
    ``error``.  The last outcome decides, but without a beat within ``max_lag``
    seconds an emitter that answers is slow.
    """
    state = probes.groupBy(key).agg(
        F.max_by("outcome", F.struct("ts", "seq")).alias("outcome"),
        F.max(F.when(F.col("outcome") == "beat", F.col("ts"))).alias("beat"))
    return emitters.select(key).distinct().join(state, key, "left").select(
        key, _status(F.col("outcome"), F.col("beat"), now, max_lag).alias("status"))


def _status(outcome: Column, beat: Column, now: Column, max_lag: float) -> Column:
    lag = F.unix_micros(now) - F.unix_micros(beat.cast("timestamp"))
    late = F.coalesce(lag > F.lit(int(max_lag * 1_000_000)), F.lit(True))
    return (F.when(outcome.isNull(), NEVER).when(outcome == "timeout", TIMED_OUT)
            .when(late, "slow").when(outcome == "error", "dead").otherwise("alive"))


def slow_gaps(beats: DataFrame, key: str, ts: str, seq: str, max_lag: float) -> DataFrame:
    """Intervals between consecutive beats that are longer than ``max_lag`` seconds."""
    seen = previous_max(beats, [key], [F.col(ts), F.col(seq)], F.col(ts))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    return (seen.withColumn("gap_us", gap).filter(F.col("gap_us") > int(max_lag * 1_000_000))
            .select(key, F.col("before").alias("since"), F.col(ts).alias("until"), "gap_us"))


class Liveness(StatefulProcessor):
    """Keeps an emitter's last outcome and last beat, whatever order they come in, and reports what changes.

    An outcome older than the one kept does not count, a beat older than the one
    kept neither.  A timer reports an emitter whose last beat is too old.
    """

    def __init__(self, max_lag_ms: int):
        self.max_lag_ms = max_lag_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, seq long, outcome string, beat long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = tuple(self.last.get()) if self.last.exists() else (None, None, None, None)
        last, outcome, beat = before[:2], before[2], before[3]
        for r in rows:
            if last[0] is None or (r["us"], r["seq"]) > last:
                last, outcome = (r["us"], r["seq"]), r["outcome"]
            if r["outcome"] == "beat" and (beat is None or r["us"] > beat):
                beat = r["us"]
        if (*last, outcome, beat) == before:
            return
        self.last.update((*last, outcome, beat))
        if beat != before[3]:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(beat // 1000 + self.max_lag_ms)
        slow = beat is None or last[0] - beat > self.max_lag_ms * 1000
        yield self._report(key, last[0], outcome, beat, "slow" if slow and outcome != "timeout" else STATUS[outcome], last[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        us, seq, outcome, beat = self.last.get()
        if outcome != "timeout":
            yield self._report(key, expiredTimerInfo.getExpiryTimeInMs() * 1000, outcome, beat, "slow", seq)

    @staticmethod
    def _report(key, us: int, outcome: str, beat: int | None, status: str, seq: int) -> Row:
        return Row(emitter=key[0], us=us, status=status, seq=seq, outcome=outcome, beat=beat)

    def close(self) -> None:
        pass


STATUS = {"beat": "alive", "timeout": TIMED_OUT, "error": "dead"}


def liveness_stream(probes: DataFrame, key: str, max_lag: float, late: str = "1 minute") -> DataFrame:
    """Status changes of a stream ``(key, ts, seq, outcome)``: ``(emitter, at, status, seq, outcome, beat)``.

    Rows may come in any order, up to ``late`` behind the newest; later ones are
    dropped.  ``outcome`` and ``beat`` are the last ones at that time.
    """
    schema = StructType([StructField("emitter", probes.schema[key].dataType)])
    for name, kind in (("us", "long"), ("status", "string"), ("seq", "long"), ("outcome", "string"), ("beat", "long")):
        schema = schema.add(name, kind)
    stream = probes.select(key, "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "outcome")
    told = stream.withWatermark("ts", late).groupBy(key).transformWithState(
        Liveness(int(max_lag * 1000)), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return told.select("emitter", F.timestamp_micros("us").alias("at"), "status", "seq", "outcome", F.timestamp_micros("beat").alias("beat"))


def current_status(changes: DataFrame, emitters: DataFrame, key: str, now: Column, max_lag: float) -> DataFrame:
    """``(key, status)`` at ``now`` of every emitter, from the reported changes; as ``liveness`` of all probes."""
    newest = F.struct("at", "seq", F.coalesce(F.unix_micros("beat"), F.lit(-1)))
    last = changes.groupBy(F.col("emitter").alias(key)).agg(
        F.max_by("outcome", newest).alias("outcome"), F.max("beat").alias("beat"))
    return emitters.select(key).distinct().join(last, key, "left").select(
        key, _status(F.col("outcome"), F.col("beat"), now, max_lag).alias("status"))
