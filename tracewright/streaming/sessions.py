"""Runs of signal in a stream: readings over a limit, grouped while their gaps are small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signal_sessions(stream: DataFrame, limit: float, gap: str = "30 minutes", late: str = "1 hour", sample: str = "sample", time: str = "ts", value: str = "value") -> DataFrame:
    """(sample, start, end, n, mean, top) of each session of readings of at least limit; a session ends when none comes for gap.

    Readings later than the watermark are dropped, and their state with it;
    null values belong to none. The frame may be a stream or a table.
    """
    hot = stream.withWatermark(time, late).where(F.col(value) >= limit)
    out = hot.groupBy(F.session_window(time, gap).alias("w"), sample).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("top"))
    return out.select(sample, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "top")


def windowed_background(stream: DataFrame, limit: float, width: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour", sample: str = "sample", time: str = "ts", value: str = "value") -> DataFrame:
    """(sample, start, n, mean, sd) of the readings under limit in sliding windows."""
    low = stream.withWatermark(time, late).where(F.col(value) < limit)
    out = low.groupBy(F.window(time, width, slide).alias("w"), sample).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return out.select(sample, F.col("w.start").alias("start"), "n", "mean", "sd")
