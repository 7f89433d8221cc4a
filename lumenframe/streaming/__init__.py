"""Streams of observations: live time bins and observing groups with a watermark. An extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_time_bins(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(objectid, start, n, m): count and mean of each object's points in tumbling windows of event time ``ts``."""
    g = stream.withWatermark("ts", late).groupBy("objectid", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("m"))
    return g.select("objectid", F.col("window.start").alias("start"), "n", "m")


def live_timegroups(stream: DataFrame, gap: str = "4 days", late: str = "1 day") -> DataFrame:
    """(objectid, start, end, n, m): runs of points with no gap of ``gap`` or more, as session windows."""
    g = stream.withWatermark("ts", late).groupBy("objectid", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("m"))
    return g.select("objectid", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "m")
