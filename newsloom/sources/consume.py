"""Bounded consumption of message queues, with acknowledgement.

A queue is the folder ``publish_by_key`` writes.  A consumer has a place in it:
per publisher the batch and the row within it up to which messages were taken.
The stream reader plans at most a number of messages at a time, tasks read their
rows of the files, and the ledger of the consumer moves on once the outputs are
written: a run that fails is repeated from where the ledger stands.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "message_queue"
# Messages one task reads.
TASK_ROWS = 100_000


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _children(fs: pafs.FileSystem, folder: str, lead: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(i.base_name.removeprefix(lead) for i in found if i.base_name.startswith(lead))


class Ledger:
    """What a consumer was handed out and what it has acknowledged.

    A place is ``{publisher: {"batch": id, "row": n}}``: all of the batches
    before, and the first rows of that one in the order of its files.
    """

    def __init__(self, path: str, routing_key: str, consumer: str):
        self.fs, self.root = _open(path)
        self.folder, self.name = f"{self.root}/_acks/{routing_key}", f"{consumer}.json"

    def read(self) -> dict:
        try:
            with self.fs.open_input_stream(f"{self.folder}/{self.name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {"planned": {}, "acked": {}}

    def write(self, **places: dict) -> None:
        self.fs.create_dir(self.folder, recursive=True)
        draft = f"{self.folder}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(self.read() | places).encode())
        self.fs.move(draft, f"{self.folder}/{self.name}")


class Queue:
    """The messages under one routing key, in the order of publisher, batch and file."""

    def __init__(self, path: str, routing_key: str):
        self.fs, self.root = _open(path)
        self.key = f"routing_key={routing_key}"

    def batches(self, place: dict) -> Iterator[tuple[str, int, int, list[tuple[str, int]]]]:
        """``(publisher, batch, rows already taken, files with their rows)`` from a place on."""
        for publisher in _children(self.fs, self.root, "publisher="):
            at = place.get(publisher, {"batch": -1, "row": 0})
            for batch in sorted(map(int, _children(self.fs, f"{self.root}/publisher={publisher}", "batch_id="))):
                if batch < at["batch"]:
                    continue
                folder = f"{self.root}/publisher={publisher}/batch_id={batch}/{self.key}"
                names = [n for n in _children(self.fs, folder, "") if n.endswith(".parquet")]
                files = [(f"{folder}/{n}", pq.read_metadata(f"{folder}/{n}", filesystem=self.fs).num_rows) for n in names]
                yield publisher, batch, at["row"] if batch == at["batch"] else 0, files

    def ahead(self, place: dict, limit: int | None) -> dict:
        """The place at most ``limit`` messages further on."""
        out, left = dict(place), limit
        for publisher, batch, taken, files in self.batches(place):
            if left == 0:
                break
            rows = sum(n for _, n in files) - taken
            step = rows if left is None else min(rows, left)
            if step > 0:
                out[publisher] = {"batch": batch, "row": taken + step}
                left = left if left is None else left - step
        return out


class QueueRows(InputPartition):
    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class QueueStream(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        path, key = options["path"], options["routingkey"]
        self.path, self.schema, self.limit = path, schema, int(options["limit"]) if "limit" in options else None
        self.queue, self.ledger = Queue(path, key), Ledger(path, key, options.get("consumer", "main"))
        # whether the place planned last was made into a micro-batch by this run
        self.run = False

    def initialOffset(self) -> dict:
        return self.ledger.read()["acked"]

    def latestOffset(self) -> dict:
        """The end of the next micro-batch.

        It is written down before it is told, so a run after a failure plans
        the same end first, whatever the limit is by then.  Micro-batches run
        one after the other: asked again, the last one is done.
        """
        entry = self.ledger.read()
        if entry["planned"] != entry["acked"] and not self.run:
            return entry["planned"]
        self.run = False
        place = self.queue.ahead(entry["planned"] or entry["acked"], self.limit)
        if place != entry["planned"]:
            self.ledger.write(planned=place)
        return place

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.run = True
        out = []
        for publisher, batch, taken, files in self.queue.batches(start):
            stop = end.get(publisher, {"batch": -1, "row": 0})
            if batch > stop["batch"]:
                continue
            most, at = stop["row"] if batch == stop["batch"] else None, 0
            for file, rows in files:
                lo, hi = max(0, taken - at), rows if most is None else min(rows, most - at)
                out += [QueueRows(file, k, min(k + TASK_ROWS, hi)) for k in range(lo, hi, TASK_ROWS)]
                at += rows
        return out

    def read(self, partition: QueueRows) -> Iterator[pa.RecordBatch]:
        """The rows of a part of a file, one row group at a time; a field that was not published is null."""
        wanted, fs = to_arrow_schema(self.schema), _open(self.path)[0]
        with pq.ParquetFile(partition.file, filesystem=fs) as file:
            at = 0
            for group in range(file.num_row_groups):
                rows = file.metadata.row_group(group).num_rows
                lo, hi = max(partition.first - at, 0), min(partition.last - at, rows)
                at += rows
                if lo >= hi:
                    continue
                there = [n for n in wanted.names if n in file.schema_arrow.names]
                found = file.read_row_group(group, columns=there).slice(lo, hi - lo)
                columns = [found[f.name].cast(f.type) if f.name in there else pa.nulls(hi - lo, f.type) for f in wanted]
                yield from pa.Table.from_arrays(columns, schema=wanted).to_batches()

    def commit(self, end: dict) -> None:
        self.ledger.write(acked=end)


class QueueSource(DataSource):
    """``spark.readStream.format(FORMAT)`` with options ``path``, ``routingKey``, ``limit`` and ``consumer``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: StructType) -> QueueStream:
        return QueueStream({k.lower(): v for k, v in self.options.items()}, schema)


def message_stream(spark: SparkSession, path: str, routing_key: str, schema: StructType, limit: int | None = None,
                   consumer: str = "main") -> DataFrame:
    """The messages of a queue as a stream; a micro-batch takes at most ``limit``.

    Acknowledged are the micro-batches before the one that runs.  Publishers
    number their batches upwards; a batch must not change once it was read.
    """
    spark.dataSource.register(QueueSource)
    reader = spark.readStream.format(FORMAT).schema(schema).option("path", path).option("routingKey", routing_key)
    return (reader if limit is None else reader.option("limit", limit)).option("consumer", consumer).load()


def consume(spark: SparkSession, path: str, routing_key: str, schema: StructType,
            handle: Callable[[DataFrame, int], None], limit: int | None = None, consumer: str = "main") -> None:
    """Take at most ``limit`` messages, hand them to ``handle(batch, batch_id)``, and acknowledge them.

    One bounded run: it ends when ``handle`` has returned.  If it fails, nothing
    is acknowledged and the next run gives the same messages under the same
    batch id, so sinks that overwrite the folder of a batch keep them once.
    An empty queue gives no messages.
    """
    stream = message_stream(spark, path, routing_key, schema, limit, consumer)
    query = (stream.writeStream.foreachBatch(handle).trigger(availableNow=True)
             .option("checkpointLocation", f"{path}/_acks/{routing_key}/{consumer}-log").start())
    query.awaitTermination()
    ledger = Ledger(path, routing_key, consumer)
    ledger.write(acked=ledger.read()["planned"])


def pending(spark: SparkSession, path: str, consumer: str = "main") -> DataFrame:
    """``(routing_key, pending)``: messages published and not yet acknowledged by a consumer.

    Only the numbers of rows are read, from the files' ends.
    """
    fs, root = _open(path)
    acks = [(key, publisher, at["batch"], at["row"])
            for key in _children(fs, f"{root}/_acks", "")
            for publisher, at in Ledger(path, key, consumer).read()["acked"].items()]
    acked = spark.createDataFrame(acks, "routing_key string, publisher string, batch long, row long")
    schema = StructType().add("publisher", "string").add("batch_id", "long").add("routing_key", "string")
    messages = spark.read.schema(schema).parquet(path).join(F.broadcast(acked), ["routing_key", "publisher"], "left")
    left = messages.groupBy("routing_key", "publisher").agg(
        (F.count_if(F.col("batch").isNull() | (F.col("batch_id") >= F.col("batch"))) - F.coalesce(F.max("row"), F.lit(0))).alias("n"))
    return left.groupBy("routing_key").agg(F.sum("n").alias("pending"))
