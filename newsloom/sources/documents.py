"""Import and export of document tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


@dataclass
class Import:
    """``valid`` documents and ``rejected`` rows ``(seq, line, reason)``."""

    valid: DataFrame
    rejected: DataFrame
    complete: bool

    def summary(self) -> DataFrame:
        """One row ``(created, errors)``; a complete import with errors creates nothing."""
        created = self.valid.agg(F.count(F.lit(1)).alias("created"))
        errors = self.rejected.agg(F.count(F.lit(1))).scalar()
        out = created.withColumn("errors", errors)
        if self.complete:
            out = out.withColumn("created", F.when(F.col("errors") > 0, F.lit(0)).otherwise(F.col("created")))
        return out

    def documents(self) -> DataFrame:
        """What goes into the table: all, or nothing if the import must be complete."""
        if not self.complete:
            return self.valid
        return self.valid.filter(self.rejected.agg(F.count(F.lit(1))).scalar() == 0)


def import_lines(lines: DataFrame, line: str, seq: str, schema: str | StructType, key: str = "_key",
                 complete: bool = False, stored: DataFrame | None = None) -> Import:
    """Check newline-delimited JSON documents given as a column of lines.

    A line is rejected if it is not an object, its key is not a string, an
    earlier line has the same key, or ``stored``, the table it goes into, has.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    raw_key = F.get_json_object(line, f"$.{key}")
    # the key must be written as a JSON string: variant typing tells "1" from 1
    parsed = F.try_parse_json(line)
    key_type = F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant"))
    rows = lines.select(F.col(seq).alias("__seq"), F.col(line).alias("__line"), raw_key.alias("__key"),
                        F.from_json(line, schema).alias("__doc"),
                        (parsed.isNotNull() & F.startswith(F.ltrim(line), F.lit("{"))).alias("__object"),
                        F.coalesce(key_type == "STRING", raw_key.isNull()).alias("__string_key"))
    reason = (F.when(~F.coalesce("__object", F.lit(False)), "not an object")
              .when(~F.col("__string_key"), "key is not a string"))
    rows = rows.withColumn("reason", reason)
    # the first good line of a key wins; a partial minimum per key shuffles no documents
    first = (rows.filter(F.col("reason").isNull() & F.col("__key").isNotNull())
             .groupBy("__key").agg(F.min("__seq").alias("__first")))
    rows = rows.join(first, "__key", "left").withColumn(
        "reason", F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("__seq") > F.col("__first"), "duplicate key"))
    if stored is not None:
        # the keys of the import are the small side
        taken = stored.select(F.col(key).alias("__key")).join(first.select("__key"), "__key", "left_semi").distinct()
        rows = rows.join(taken.withColumn("__taken", F.lit(True)), "__key", "left").withColumn(
            "reason", F.coalesce("reason", F.when(F.col("__taken"), "key is stored")))
    valid = rows.filter(F.col("reason").isNull()).select("__doc.*")
    rejected = rows.filter(F.col("reason").isNotNull()).select(
        F.col("__seq").alias("seq"), F.col("__line").alias("line"), "reason")
    return Import(valid, rejected, complete)


def import_file(spark: SparkSession, path: str, schema: str | StructType, key: str = "_key",
                complete: bool = False, stored: DataFrame | None = None) -> Import:
    """Import a file or folder of NDJSON; rows are ordered by file and position."""
    text = spark.read.text(path)
    lines = text.select(F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                 F.monotonically_increasing_id()).alias("seq"), F.col("value").alias("line"))
    return import_lines(lines, "line", "seq", schema, key, complete, stored)


def export_documents(df: DataFrame, key: str | None = None, limit: int | None = None,
                     include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    """The columns and rows of an export; write the result with ``df.write``."""
    if include is not None and exclude is not None:
        raise ValueError("give either include or exclude")
    if include is not None:
        df = df.select(*include)
    if exclude is not None:
        df = df.drop(*exclude)
    if limit is None:
        return df
    return (df.orderBy(key) if key else df).limit(limit)


def write_documents(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    df.write.format(fmt).mode(mode).save(path)
