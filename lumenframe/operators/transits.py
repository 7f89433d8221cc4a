"""Transit times, windows and points outside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import KEY


def transit_times(spans: DataFrame, period: Column | float, epoch: Column | float, duration: float, pad: float = 0.0) -> DataFrame:
    """(objectid, transit, tmid, start, end): mid-times strictly inside (t0, t1) of ``spans`` (objectid, t0, t1)."""
    p = period if isinstance(period, Column) else F.lit(float(period))
    e = epoch if isinstance(epoch, Column) else F.lit(float(epoch))
    s = spans.withColumns({"_p": p, "_e": e})
    s = s.withColumn("transit", F.explode(F.sequence(F.floor((F.col("t0") - F.col("_e")) / F.col("_p")), F.ceil((F.col("t1") - F.col("_e")) / F.col("_p")))))
    s = s.withColumn("tmid", F.col("_e") + F.col("transit") * F.col("_p")).where("tmid > t0 AND tmid < t1")
    half = duration / 2 + pad * duration
    return s.select(KEY, "transit", "tmid", (F.col("tmid") - half).alias("start"), (F.col("tmid") + half).alias("end"))


def out_of_transit(lc: DataFrame, windows: DataFrame) -> DataFrame:
    """Points outside every window of their object."""
    w = windows.select(F.col(KEY).alias("_k"), "start", "end")
    return lc.join(w, (F.col(KEY) == F.col("_k")) & (F.col("t") >= F.col("start")) & (F.col("t") <= F.col("end")), "left_anti")


def epochs(midtimes: DataFrame, period: float, t0: float | None = None) -> DataFrame:
    """Adds ``epoch``, the whole number of periods from t0 (by default the mean of times weighted by 1 / err^2, moved to a mid-time)."""
    if t0 is None:
        w = 1.0 / (F.col("err") * F.col("err"))
        means = midtimes.groupBy(KEY).agg((F.sum(F.col("tmid") * w) / F.sum(w)).alias("_mean"), F.min("tmid").alias("_first"))
        m = midtimes.join(means, KEY).withColumn("_t0", F.col("_first") + F.round((F.col("_mean") - F.col("_first")) / period) * period)
    else:
        m = midtimes.withColumn("_t0", F.lit(float(t0)))
    return m.withColumn("epoch", F.round((F.col("tmid") - F.col("_t0")) / period).cast("long")).drop("_t0", "_mean", "_first")
