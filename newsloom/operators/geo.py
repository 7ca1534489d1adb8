"""Documents near a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: mean earth radius in metres.
EARTH = 6371000.0


def distance(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(lat), F.radians(F.lit(to_lat))
    h = (F.pow(F.sin((b - a) / 2), 2)
         + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(F.lit(to_lon) - lon) / 2), 2))
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _box(df: DataFrame, lat: str, to_lat: float, radius: float) -> DataFrame:
    """A latitude band the scan can skip files by; exact tests follow."""
    import math

    band = math.degrees(radius / EARTH) * (1 + 1e-9)
    return df.filter(F.col(lat).between(to_lat - band, to_lat + band))


def near(df: DataFrame, lat: str, lon: str, to_lat: float, to_lon: float, key: str, limit: int | None = 100,
         radius: float | None = None, skip: int | None = None, distance_col: str | None = None) -> DataFrame:
    """Documents by distance, ties by key; optionally within ``radius`` metres."""
    if radius is not None:
        df = _box(df, lat, to_lat, radius)
    out = df.withColumn("__d", distance(F.col(lat), F.col(lon), to_lat, to_lon))
    if radius is not None:
        out = out.filter(F.col("__d") <= radius)
    out = out.orderBy("__d", key)
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out.withColumnRenamed("__d", distance_col) if distance_col else out.drop("__d")


def within(df: DataFrame, lat: str, lon: str, to_lat: float, to_lon: float, radius: float, key: str,
           distance_col: str | None = None) -> DataFrame:
    return near(df, lat, lon, to_lat, to_lon, key, None, radius, None, distance_col)
