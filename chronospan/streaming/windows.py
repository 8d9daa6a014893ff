"""Streaming counterparts: hopping means with late data, for use between readStream and writeStream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hopping_means(events: DataFrame, width: str = "4 hours", stride: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(rec, start, n, mean_y) per window of (rec, ts, y); rows later than the watermark are left out. Windows are open at their end."""
    seen = events.withWatermark("ts", late).groupBy("rec", F.window("ts", width, stride).alias("w"))
    return seen.agg(F.count("*").alias("n"), F.avg("y").alias("mean_y")).select("rec", F.col("w.start").alias("start"), "n", "mean_y")
