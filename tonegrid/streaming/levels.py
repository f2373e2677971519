"""Levels of an unbounded stream of samples: an extension, as the operators proper read whole signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_levels(stream: DataFrame, key: str, time: str, value: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n, peak, rms) of tumbling windows of event time, with a watermark.

    State holds the windows that are still open, a few numbers each, not their samples.
    """
    x = F.col(value).cast("double")
    rows = stream.withWatermark(time, late).groupBy(key, F.window(time, length).alias("w"))
    out = rows.agg(F.count("*").alias("n"), F.max(F.abs(x)).alias("peak"), F.sqrt(F.avg(x * x)).alias("rms"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak", "rms")


def sessions(stream: DataFrame, key: str, time: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(key, start, end, onsets): bursts of onsets with no pause of ``gap`` or more."""
    rows = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("onsets"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "onsets")
