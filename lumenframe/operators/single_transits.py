"""Mid-times of single transits: points are dealt to the transit they are nearest to by arithmetic, then fitted, many in a kernel call.

No interval join is needed: with a period and an epoch a time has one nearest transit, so object and number of the transit
are the key of one shuffle, and a long series with many transits is many small groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fits import in_groups, least_squares_many, padded
from .series import KEY, finite_filter
from .transit_fits import transit_model

_FIT = "tmid double, err double, level double, slope double, chisq double, n long, n_in long, before long, after long"


def with_transits(lc: DataFrame, ephemeris: DataFrame, widen: float = 2.0) -> DataFrame:
    """Points within ``widen`` durations of a mid-time, with ``transit`` (its number), ``predicted`` and the ephemeris.

    ``ephemeris`` is (objectid, period, t0, duration), more columns are kept; duration is in days.
    """
    j = lc.join(ephemeris, KEY).where("period > 0 AND duration > 0")
    j = j.withColumn("transit", F.round((F.col("t") - F.col("t0")) / F.col("period")).cast("long"))
    j = j.withColumn("predicted", F.col("t0") + F.col("transit") * F.col("period"))
    return j.where(F.abs(F.col("t") - F.col("predicted")) <= widen * F.col("duration"))


def fit_many(ts: list[np.ndarray], ys: list[np.ndarray], es: list[np.ndarray], at: np.ndarray, u: tuple[float, float]) -> list[tuple[float, float, float, float, float] | None]:
    """(mid-time, its error, level, slope, chi squared) of each of some transits of known shape times a line.

    ``at`` has predicted time, period, duration, rp, a and b in rows. A shape is tried at steps of a quarter of the duration, so
    a transit that is off by some of it is found. Shorter series are filled up with points that weigh nothing.
    """
    predicted, period, duration, *shape = at.T
    t, y, e = padded(ts, np.nan), padded(ys, 1.0), padded(es, np.inf)
    t = np.where(np.isnan(t), (predicted + period / 2)[:, None], t)
    free = np.full(len(ts), np.inf)
    low, high = np.stack([predicted - 1.5 * duration, np.zeros(len(ts)), -free], 1), np.stack([predicted + 1.5 * duration, free, free], 1)
    steps = np.stack([1e-4 * duration, np.full(len(ts), 1e-6), np.full(len(ts), 1e-6)], 1)

    def residuals(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        mid, level, slope = (c[:, None] for c in x.T)
        return (transit_model(t[k], mid, period[k, None], *[c[k, None] for c in shape], u) * (level + slope * (t[k] - predicted[k, None])) - y[k]) / e[k]

    every, level = np.arange(len(ts)), np.array([float(np.median(v)) for v in ys])
    starts = np.stack([np.stack([predicted + 0.25 * k * duration, level, np.zeros(len(ts))], 1) for k in range(-4, 5)])
    best = np.argmin([np.sum(residuals(x, every) ** 2, 1) for x in starts], 0)
    x, ok = least_squares_many(residuals, starts[best, every], low, high, 30, steps)
    out: list[tuple[float, float, float, float, float] | None] = [None] * len(ts)
    every = np.flatnonzero(ok)
    if not len(every):
        return out
    x, steps = x[every], steps[every]
    chi = np.sum(residuals(x, every) ** 2, 1)
    slopes = []
    for i in range(3):
        d = np.zeros_like(x)
        d[:, i] = steps[:, i]
        slopes.append((residuals(x + d, every) - residuals(x - d, every)) / (2 * steps[:, i, None]))
    for v, c, j, i in zip(x.tolist(), chi.tolist(), np.stack(slopes, 2), every.tolist(), strict=True):
        out[i] = (v[0], math.sqrt(max(0.0, np.linalg.pinv(j.T @ j)[0, 0])), v[1], v[2], c)
    return out


def midtimes(lc: DataFrame, ephemeris: DataFrame, u: tuple[float, float] = (0.3, 0.2), widen: float = 2.0, least: int = 8, least_in: int = 3) -> DataFrame:
    """(objectid, transit, tmid, err, level, slope, chisq, n, n_in, before, after): a fit for each transit that has the points.

    ``ephemeris`` is (objectid, period, t0, duration, rp, a, b), as fit_transits() gives the shape; the series is flux around any
    level. A transit needs ``least`` points in its window and ``least_in`` within the transit; before and after count those on
    either side of it. A fit that does not converge, or has fewer points than parameters, gives no row.
    """

    cols = [KEY, "transit", *[c.split()[0] for c in _FIT.split(", ")]]

    def run(groups: list[pd.DataFrame]) -> pd.DataFrame:
        kept = []
        for p in groups:
            if len(p) >= max(least, 4):
                off, half = (p["t"] - p["predicted"]).to_numpy(float), float(p["duration"].iloc[0]) / 2
                counts = len(p), int((np.abs(off) <= half).sum()), int((off < -half).sum()), int((off > half).sum())
                if counts[1] >= least_in:
                    kept.append((p, counts))
        if not kept:
            return pd.DataFrame(columns=cols)
        series = ([p[c].to_numpy(float) for p, _ in kept] for c in ("t", "m", "e"))
        at = np.array([[float(p[c].iloc[0]) for c in ("predicted", "period", "duration", "rp", "a", "b")] for p, _ in kept])
        found = zip(kept, fit_many(*series, at, u), strict=True)
        return pd.DataFrame([(p[KEY].iloc[0], p["transit"].iloc[0], *got, *counts) for (p, counts), got in found if got is not None], columns=cols)

    kind = lc.schema[KEY].dataType.simpleString()
    shape = ephemeris.select(KEY, "period", "t0", "duration", "rp", "a", "b")
    rows = with_transits(finite_filter(lc).select(KEY, "t", "m", "e", "seq"), shape, widen)
    return in_groups(rows, [KEY, "transit"], run, f"{KEY} {kind}, transit long, {_FIT}")


def observed_minus_calculated(found: DataFrame) -> DataFrame:
    """(objectid, transit, tmid, err, calculated, oc, period, t0): each mid-time against the line through all of its object.

    The line is fitted with weights 1 / err^2, in sums around the weighted mean; transits whose error is not over zero are left
    out of it, and objects with one transit alone have no line.
    """
    w = F.when(F.col("err") > 0, 1.0 / (F.col("err") * F.col("err")))
    base = found.groupBy(KEY).agg(F.min("tmid").alias("_from"), (F.sum(w * F.col("transit")) / F.sum(w)).alias("_x"))
    c = found.join(base, KEY).withColumn("_y", F.col("tmid") - F.col("_from"))
    d = F.col("transit") - F.col("_x")
    line = c.groupBy(KEY).agg(F.try_divide(F.sum(w * d * F.col("_y")), F.sum(w * d * d)).alias("period"), (F.sum(w * F.col("_y")) / F.sum(w)).alias("_mean"))
    out = c.join(line, KEY).withColumn("t0", F.col("_from") + F.col("_mean") - F.col("period") * F.col("_x"))
    out = out.withColumn("calculated", F.col("t0") + F.col("transit") * F.col("period"))
    return out.select(KEY, "transit", "tmid", "err", "calculated", (F.col("tmid") - F.col("calculated")).alias("oc"), "period", "t0")
