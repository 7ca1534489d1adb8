"""Message queues as a table partitioned by routing key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def publish_by_key(df: DataFrame, path: str, batch_id: int = 0, publisher: str = "main") -> None:
    """Append messages under their ``routing_key``.

    A batch owns its partitions and overwrites them, so a batch that is replayed
    after a lost executor or a restarted stream leaves no second copy.  Every
    publisher numbers its own batches.
    """
    (df.withColumn("publisher", F.lit(publisher)).withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
     .partitionBy("publisher", "batch_id", "routing_key").parquet(path))


def read_queue(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All messages ever published; ``schema`` is that of a message."""
    full = StructType(list(schema.fields)).add("publisher", "string").add("batch_id", "long").add("routing_key", "string")
    return spark.read.schema(full).parquet(path)


def backlog(messages: DataFrame) -> DataFrame:
    """Pending messages per queue."""
    return messages.groupBy("routing_key").agg(F.count(F.lit(1)).alias("pending"))


def base_queue(collection: str) -> str:
    """``newsErrors`` and ``newsNewbies`` belong to the queue ``news``."""
    import re

    return re.sub(r"[A-Z].*", "", collection)
