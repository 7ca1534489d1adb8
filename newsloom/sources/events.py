"""Site events: arbitrary attributes with a time stamp and an optional flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def stamp_events(df: DataFrame, site: Column, attributes: list[str], created: Column | None = None,
                 flag: Column | None = None) -> DataFrame:
    """Rows ``(site, data map, createdTs, _flag)``; null attributes are left out."""
    data = F.map_from_arrays(F.array(*[F.lit(a) for a in attributes]),
                             F.array(*[F.col(a).cast("string") for a in attributes]))
    return df.select(site.alias("site"), F.map_filter(data, lambda _, v: v.isNotNull()).alias("data"),
                     (F.current_timestamp() if created is None else created).alias("createdTs"),
                     (F.lit(None).cast("string") if flag is None else flag).alias("_flag"))


def append_events(events: DataFrame, path: str, batch: str) -> None:
    """Add a batch of events; one that is written again replaces itself."""
    events.write.mode("overwrite").partitionBy("site").parquet(f"{path}/batch={batch}")
