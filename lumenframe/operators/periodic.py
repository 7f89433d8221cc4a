"""Features of periods: peaks against the sampling, fits at a period, and everything by object in one table."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords, photometry
from . import features, periodograms, series, spatial
from .fits import bounded_many, fit_fourier, fit_spline, in_groups
from .series import KEY, sigclip

#: Lengths of the sidereal day in days, over and under.
SIDEREAL = (1.0027379, 0.9972696)


def sampling_ratios(peaks: DataFrame, scores: DataFrame, window: DataFrame, near: float = 1e-4, sidereal: float = 1e-4) -> DataFrame:
    """``peaks`` (objectid, method, rank, period, score) with ratio, sidereal and near_sidereal.

    A score is over the range of its method's ``scores`` (objectid, method, score); those of which the least is best count
    from one down, as the peaks do. ``ratio`` is that over the mean of the sampling periodogram ``window`` (objectid, freq,
    power), over its range, at periods within ``near``; null if there are none. ``sidereal`` compares signed differences, so
    any period under a day is flagged; near_sidereal compares their sizes.
    """
    up = lambda c: F.when(F.col("method") == "pdm", 1.0 - F.col(c)).otherwise(F.col(c))
    span = scores.groupBy(KEY, "method").agg((F.max(up("score")) - F.min(up("score"))).alias("_span"))
    own = window.groupBy(KEY).agg((F.max("power") - F.min("power")).alias("_own"))
    w = window.join(own, KEY).select(KEY, (1.0 / F.col("freq")).alias("_p"), F.try_divide("power", "_own").alias("_w"))
    at = peaks.select(KEY, "method", "rank", "period").join(w, KEY).where(F.abs(F.col("_p") - F.col("period")) < near).groupBy(KEY, "method", "rank").agg(F.avg("_w").alias("_mean"))
    j = peaks.join(span, [KEY, "method"], "left").join(at, [KEY, "method", "rank"], "left")
    off = [(F.col("period") - s) / F.col("period") for s in SIDEREAL]
    return j.select(*peaks.columns, F.try_divide(F.try_divide(up("score"), F.col("_span")), F.col("_mean")).alias("ratio"), ((off[0] < sidereal) | (off[1] < sidereal)).alias("sidereal"), ((F.abs(off[0]) < sidereal) | (F.abs(off[1]) < sidereal)).alias("near_sidereal"))


def periodogram_features(peaks: DataFrame, scores: DataFrame, window: DataFrame, near: float = 1e-4, sidereal: float = 1e-4, multiplier: float = 5.0) -> DataFrame:
    """(objectid, n_abovesampling, n_sidereal, n_near_sidereal, n_pairs, n_close_pairs) over all methods' best periods.

    n_pairs counts all pairs of best periods, n_close_pairs those that differ by less than ``near``.
    """
    r = sampling_ratios(peaks, scores, window, near, sidereal)
    g = r.groupBy(KEY).agg(F.count_if(F.col("ratio") > multiplier).alias("n_abovesampling"), F.count_if("sidereal").alias("n_sidereal"), F.count_if("near_sidereal").alias("n_near_sidereal"), F.sort_array(F.collect_list("period")).alias("_p"))
    n = F.size("_p")
    close = F.aggregate(F.transform("_p", lambda x, i: F.size(F.filter(F.slice("_p", i + 2, n), lambda y: y - x < near))), F.lit(0), lambda a, b: a + b)
    return g.select(KEY, "n_abovesampling", "n_sidereal", "n_near_sidereal", (n * (n - 1) / 2).cast("long").alias("n_pairs"), close.cast("long").alias("n_close_pairs"))


def searched_features(lc: DataFrame, grids: DataFrame, method: str = "gls", best: int = 3, near: float = 1e-4, sidereal: float = 1e-4, multiplier: float = 5.0, work: int = periodograms.WORK) -> DataFrame:
    """periodogram_features() of the ``best`` peaks of ``method`` over ``grids`` (objectid, first, step, number), and ``period``,
    the best of them.

    An object's scores and the periodogram of its sampling are made once, and no row is made for a frequency. Those of a grid
    in several stretches meet once, packed, sixteen bytes a frequency.
    """
    kernel, score, largest = periodograms.METHODS[method]
    columns = [KEY, "n_abovesampling", "n_sidereal", "n_near_sidereal", "n_pairs", "n_close_pairs", "period"]

    def summary(v: np.ndarray, w: np.ndarray, freqs: np.ndarray) -> tuple | None:
        at = np.flatnonzero(np.isfinite(v) & (freqs > 0))
        if not len(at):
            return None
        p, up = 1.0 / freqs[at], 1.0 - v[at] if method == "pdm" else v[at]
        top = periodograms.walked(-v[at] if largest else v[at], p, best, 0.1)
        seen = np.isfinite(w)
        span, own = up.max() - up.min(), w[seen].max() - w[seen].min() if seen.any() else 0.0
        above = 0
        for i in top:
            here = w[seen & (np.abs(1.0 / np.where(freqs != 0, freqs, np.nan) - p[i]) < near)]
            if span and own and len(here) and here.mean():
                above += int(up[i] / span / (here / own).mean() > multiplier)
        q = p[top]
        off = np.array([(q - x) / q for x in SIDEREAL])
        close = sum(int((np.abs(q[i + 1 :] - q[i]) < near).sum()) for i in range(len(q)))
        return above, int((off < sidereal).any(0).sum()), int((np.abs(off) < sidereal).any(0).sum()), len(q) * (len(q) - 1) // 2, close, float(q[0])

    def scores(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.iloc[0]
        t, _, e, _, freqs = periodograms.opened(pdf)
        w = np.concatenate([periodograms.window_power(t, t, e, freqs[i:j])["power"] for i, j in periodograms._blocks(len(t), len(freqs))])
        t, m, e, _, freqs = periodograms.opened(pdf[pdf["e"] != 0])
        v = np.concatenate([kernel(t, m, e, freqs[i:j])[score] for i, j in periodograms._blocks(len(t), len(freqs))])
        got = (x[KEY], int(x["part"]), float(x["first"]), float(x["step"]))
        if len(freqs) < int(x["number"]):
            return pd.DataFrame([(*got, v.astype(float).tobytes(), w.astype(float).tobytes(), *[None] * 6)], columns=[KEY, "part", "first", "step", "v", "w", *columns[1:]])
        return pd.DataFrame([(*got, None, None, *(summary(v, w, freqs) or [None] * 6))], columns=[KEY, "part", "first", "step", "v", "w", *columns[1:]])

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["v"].iloc[0] is not None:
            pdf = pdf.sort_values("part")
            v, w = (np.concatenate([np.frombuffer(b, float) for b in pdf[c]]) for c in ("v", "w"))
            got = summary(v, w, float(pdf["first"].iloc[0]) + np.arange(len(v)) * float(pdf["step"].iloc[0]))
            return pd.DataFrame([(pdf[KEY].iloc[0], *got)] if got else [], columns=columns)
        return pdf[columns].dropna(subset=["period"])

    ok = series.finite("m") & series.finite("e") & (F.col("e") != 0)
    rows = lc.where(series.finite("t")).withColumns({"m": F.when(ok, F.col("m")).otherwise(0.0), "e": F.when(ok, F.col("e")).otherwise(0.0)})
    kind, counts = lc.schema[KEY].dataType.simpleString(), ", ".join(f"{c} long" for c in columns[1:-1]) + ", period double"
    parts = series.dealt(periodograms.stretches(rows, grids, work, nonzero_errors=False), KEY, "part").groupBy(KEY, "part").applyInPandas(scores, f"{KEY} {kind}, part long, first double, step double, v binary, w binary, {counts}")
    return parts.groupBy(KEY).applyInPandas(met, f"{KEY} {kind}, {counts}")


def fit_features(lc: DataFrame, periods: DataFrame, order: int = 5, sigma: float | None = 10.0, least: int = 10) -> DataFrame:
    """(objectid, fourier_*, planet_*, eb_*, ebx2_*) of objects with ``periods`` (objectid, period): chisq, redchisq,
    residual_mad and residual_mad_over_lcmad of a Fourier series, a transit, eclipses, and eclipses at twice the period.

    Fits that do not converge have nulls.
    """
    kinds = ("fourier", "planet", "eb", "ebx2")
    names = [f"{k}_{c}" for k in kinds for c in ("chisq", "redchisq", "residual_mad", "residual_mad_over_lcmad")]

    def run(groups: list[pd.DataFrame]) -> pd.DataFrame:
        groups = [p for p in groups if len(p) >= least and float(p["period"].iloc[0]) > 0]
        if not groups:
            return pd.DataFrame(columns=[KEY, *names])
        series = ts, ms, es = [[p[c].to_numpy(float) for p in groups] for c in ("t", "m", "e")]
        periods = np.array([float(p["period"].iloc[0]) for p in groups])
        once, twice = (np.array([fit_spline(t, m, e, x)["epoch"] for t, m, e, x in zip(*series, f * periods, strict=True)]) for f in (1, 2))
        found: dict[str, list] = {"fourier": []}
        for t, m, e, x in zip(*series, periods, strict=True):
            got = fit_fourier(t, m, e, x, order)
            found["fourier"].append((got["chisq"], got["redchisq"], got["fit"] - got["m"]))
        found |= {"planet": bounded_many("trapezoid", *series, periods, once), "eb": bounded_many("eclipses", *series, periods, once), "ebx2": bounded_many("eclipses", *series, 2 * periods, twice)}
        rows = []
        for i, p in enumerate(groups):
            mad = float(np.median(np.abs(ms[i] - np.median(ms[i]))))
            row: dict = {KEY: p[KEY].iloc[0]}
            for kind in kinds:
                chi, red, left = found[kind][i] or (math.nan, math.nan, np.full(1, math.nan))
                spread = float(np.median(np.abs(left - np.median(left)))) if np.isfinite(left).all() else math.nan
                row |= {f"{kind}_chisq": chi, f"{kind}_redchisq": red, f"{kind}_residual_mad": spread, f"{kind}_residual_mad_over_lcmad": spread / mad if mad else math.nan}
            rows.append(row)
        return pd.DataFrame(rows)[[KEY, *names]]

    kind = lc.schema[KEY].dataType.simpleString()
    rows = sigclip(lc, sigma).select(KEY, "t", "m", "e", "seq").join(periods.select(KEY, "period"), KEY)
    return in_groups(rows, [KEY], run, f"{KEY} {kind}, " + ", ".join(f"{c} double" for c in names))


def periodic_features(lc: DataFrame, found: DataFrame, order: int = 5) -> DataFrame:
    """One row for each object of ``found`` (searched_features()): that, and fit_features() and phased features at its period."""
    best = found.select(KEY, "period")
    at = series.finite_filter(lc).join(best, KEY)
    x = (F.col("t") - F.min("t").over(series.whole())) / F.col("period")
    folded = at.withColumn("phase", x - F.floor(x))
    return found.join(features.phased_features(folded), KEY, "left").join(fit_features(lc, best, order), KEY, "left")


def star_features(catalog: DataFrame, radius_arcsec: float = 7200.0, bands: dict[str, Column] | None = None) -> DataFrame:
    """``catalog`` (objectid, ra, decl, ...) with galactic coordinates, colour indices of u, g, r, i and z, M dwarf subtype,
    and number and distance of neighbours."""
    gl, gb = coords.equatorial_to_galactic(F.col("ra"), F.col("decl"))
    out = catalog.withColumns({"gl": gl, "gb": gb})
    if bands:
        out = out.withColumns(bands).withColumns(photometry.color_indices(*[F.col(x) for x in "ugriz"]))
        name, sti, sts = photometry.mdwarf_subtype(F.col("r") - F.col("i"), F.col("i") - F.col("z"))
        out = out.withColumns({"m_class": name, "sti": sti, "sts": sts})
    return out.join(spatial.neighbor_features(catalog, radius_arcsec), KEY, "left")
