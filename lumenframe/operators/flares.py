"""Fits of flares: candidate windows meet the points of their object, and the small fits of many windows are one kernel call."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fits import in_groups, least_squares_many, padded
from .series import KEY, finite_filter

_FIT = "amplitude double, peak double, rise double, decay double, level double, amplitude_err double, peak_err double, chisq double, redchisq double, n long"


def flare_curve(t: np.ndarray, amplitude: float, peak: float, rise: float, decay: float, level: float) -> np.ndarray:
    """A Gaussian rise to the peak and an exponential decay after it, over a level."""
    d = t - peak
    return level + amplitude * np.where(d < 0, np.exp(-(d * d) / (2 * rise * rise)), np.exp(-np.maximum(d, 0.0) / decay))


def fit_many(ts: list[np.ndarray], ms: list[np.ndarray], es: list[np.ndarray], start: list[float], end: list[float]) -> list[dict | None]:
    """The fits of flares between two times, each from the best of some lengths to start with; either sign of amplitude is
    allowed. Shorter series are filled up with points that weigh nothing."""
    out: list[dict | None] = [None] * len(ts)
    begin = []
    for i, (t, m) in enumerate(zip(ts, ms, strict=True)):
        inside = np.flatnonzero((t >= start[i]) & (t <= end[i]))
        if len(t) >= 6 and len(inside):
            level = float(np.median(m))
            top = inside[np.argmax(np.abs(m[inside] - level))]
            begin.append((i, max(float(np.median(np.diff(t))), 1e-9), float(t[-1] - t[0]), m[top] - level, t[top], level))
    if not begin:
        return out
    which = [int(x[0]) for x in begin]
    gap, span, amplitude, peak, level = np.array([x[1:] for x in begin]).T
    first, last = np.array([(start[i], end[i]) for i in which]).T
    t, m, e = (padded([x[i] for i in which], fill) for x, fill in ((ts, 0.0), (ms, 0.0), (es, np.inf)))
    free, size = np.full(len(which), np.inf), np.maximum(np.abs(amplitude), 1e-12)
    low = np.stack([-free, first - gap, 1e-3 * gap, 1e-3 * gap, -free], 1)
    high = np.stack([free, last + gap, span, 2 * span, free], 1)
    steps = np.stack([1e-5 * size, 1e-4 * gap, 1e-4 * gap, 1e-4 * gap, 1e-5 * size], 1)
    residuals = lambda x, at: (flare_curve(t[at], *[c[:, None] for c in x.T]) - m[at]) / e[at]
    every = np.arange(len(which))
    starts = [np.clip(np.stack([amplitude, peak, rise * gap, decay * gap, level], 1), low, high) for rise in (0.25, 0.5, 1.0, 2.0, 4.0) for decay in (0.5, 1.0, 2.0, 5.0, 12.0)]
    best = np.argmin([np.sum(residuals(x, every) ** 2, 1) for x in starts], 0)
    x, ok = least_squares_many(residuals, np.stack(starts)[best, every], low, high, 40, steps)
    every = np.flatnonzero(ok)
    if not len(every):
        return out
    x, steps = x[every], steps[every]
    chi = np.sum(residuals(x, every) ** 2, 1)
    slopes = []
    for i in range(5):
        d = np.zeros_like(x)
        d[:, i] = steps[:, i]
        slopes.append((residuals(x + d, every) - residuals(x - d, every)) / (2 * steps[:, i, None]))
    for v, c, j, i in zip(x.tolist(), chi.tolist(), np.stack(slopes, 2), every.tolist(), strict=True):
        err = np.sqrt(np.maximum(np.diag(np.linalg.pinv(j.T @ j)), 0.0)) if np.isfinite(j).all() else np.full(5, np.nan)
        n = len(ts[which[i]])
        out[which[i]] = dict(zip(("amplitude", "peak", "rise", "decay", "level"), v, strict=True)) | {"amplitude_err": float(err[0]), "peak_err": float(err[1]), "chisq": c, "redchisq": c / (n - 5) if n > 5 else math.nan, "n": n}
    return out


def fit_flares(lc: DataFrame, candidates: DataFrame, before: float, after: float) -> DataFrame:
    """(objectid, flare, amplitude, peak, rise, decay, level, errors, chisq, redchisq, n) of each of ``candidates``.

    ``candidates`` are rows (objectid, flare, start, end), as find_flares() gives them; the points from ``before`` days before the
    start to ``after`` days after the end go into the fit. Windows of an object may overlap. A window with fewer than six points
    or no converging fit gives no row.
    """

    cols = [KEY, "flare", *[c.split()[0] for c in _FIT.split(", ")]]

    def run(groups: list[pd.DataFrame]) -> pd.DataFrame:
        ts, ms, es = ([p[c].to_numpy(float) for p in groups] for c in ("t", "m", "e"))
        first = [float(t[0]) for t in ts]
        ends = ([float(p[c].iloc[0]) - f for p, f in zip(groups, first, strict=True)] for c in ("start", "end"))
        found = fit_many([t - f for t, f in zip(ts, first, strict=True)], ms, es, *ends)
        return pd.DataFrame([{KEY: p[KEY].iloc[0], "flare": p["flare"].iloc[0], **got, "peak": got["peak"] + f} for p, got, f in zip(groups, found, first, strict=True) if got is not None], columns=cols)

    kind = lc.schema[KEY].dataType.simpleString()
    w = candidates.select(F.col(KEY).alias("_k"), F.col("flare").cast("int").alias("flare"), "start", "end")
    rows = finite_filter(lc).select(KEY, "t", "m", "e", "seq").join(w, (F.col(KEY) == F.col("_k")) & (F.col("t") >= F.col("start") - before) & (F.col("t") <= F.col("end") + after)).drop("_k")
    return in_groups(rows, [KEY, "flare"], run, f"{KEY} {kind}, flare int, {_FIT}")
