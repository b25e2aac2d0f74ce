"""Zonal statistics of samples that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.missing import nan_to_null


def stream_zonal(samples: DataFrame, zone: list[str], value: str, *, time: str, window: str, late: str) -> DataFrame:
    """count, mean and population deviation of each zone and tumbling window; samples later than ``late`` are left out, and state goes with the watermark."""
    x = nan_to_null(value)
    grouped = samples.withWatermark(time, late).groupBy(F.window(time, window), *zone)
    return grouped.agg(F.count("*").alias("count"), F.avg(x).alias(f"{value}_mean"), F.stddev_pop(x).alias(f"{value}_std"))
