"""Only new versions of feed entries pass."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.running import previous_max

# State of a link that no poll has brought for this long is forgotten.
FORGET_MS = 30 * 24 * 3600 * 1000


def new_versions(entries: DataFrame, keys: list[str], seq: str, ref: str, good: Column, width: int = 1 << 20,
                 poll: str | None = None) -> DataFrame:
    """Entries newer than every good one of their link before them.

    Only good entries pass and advance the mark, so the mark is the running
    maximum over good entries in order of arrival.  With ``poll``, the number of
    the poll that brought an entry, a link that a poll did not bring is
    forgotten: its next entry passes again.
    """
    if poll is not None:
        entries, keys = _with_runs(entries, keys, poll, width), [*keys, "__run"]
    fit = entries.filter(good)
    order = [F.col(seq)] if poll is None else [F.col(poll), F.col(seq)]
    seen = previous_max(fit, keys, order, F.col(ref), width=width)
    return seen.filter(F.col("before").isNull() | (F.col(ref) > F.col("before"))).drop("before", "__run")


def _with_runs(entries: DataFrame, keys: list[str], poll: str, width: int) -> DataFrame:
    """With the first poll of the unbroken run of polls, good or not, that brought the link."""
    polls = entries.select(*keys, poll).distinct()
    polls = previous_max(polls, keys, [F.col(poll)], F.col(poll), "__last", width)
    polls = polls.withColumn("__first", F.when(F.col("__last").isNull() | (F.col(poll) > F.col("__last") + 1), F.col(poll)))
    polls = previous_max(polls, keys, [F.col(poll)], F.col("__first"), "__open", width)
    return entries.join(polls.select(*keys, poll, F.coalesce("__first", "__open").alias("__run")), [*keys, poll])


class VersionGate(StatefulProcessor):
    """Keeps the reference time last passed for one link, and the last poll that brought it."""

    def __init__(self, seq: str, ref: str, good: str, forget_ms: int | None, poll: str | None = None):
        self.seq, self.ref, self.good, self.forget_ms, self.poll = seq, ref, good, forget_ms, poll

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = (handle.getValueState("last", "ref double, poll long") if self.forget_ms is None
                     else handle.getValueState("last", "ref double, poll long", ttlDurationMs=self.forget_ms))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # in order of arrival; a poll and a number are enough to sort by
        batch = sorted(rows, key=lambda r: (r[self.poll] if self.poll else 0, r[self.seq]))
        mark, last = tuple(self.last.get()) if self.last.exists() else (None, None)
        for r in batch:
            if self.poll is not None:
                if last is not None and r[self.poll] > last + 1:
                    mark = None
                last = r[self.poll] if last is None else max(last, r[self.poll])
            if r[self.good] and r[self.ref] is not None and (mark is None or r[self.ref] > mark):
                mark = float(r[self.ref])
                yield r
        if batch:
            self.last.update((mark, last))

    def close(self) -> None:
        pass


def version_stream(entries: DataFrame, keys: list[str], seq: str, ref: str, good: str,
                   forget_ms: int | None = FORGET_MS, poll: str | None = None) -> DataFrame:
    """The same over a stream.  ``good`` is a boolean column; polls come in order.

    State also expires by TTL, so that links that are gone for good do not stay.
    State with a TTL runs on processing time and so never reports the end of
    its input: a run to the end (``availableNow``) needs ``forget_ms=None``.
    """
    schema = StructType(list(entries.schema.fields))
    return entries.groupBy(*keys).transformWithState(
        VersionGate(seq, ref, good, forget_ms, poll), outputStructType=schema, outputMode="Append",
        timeMode="None" if forget_ms is None else "ProcessingTime")
