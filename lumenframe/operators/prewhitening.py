"""Prewhitening again and again: search, fit and removal in a loop within one call for each object, not one job a round."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .fits import fit_fourier
from .periodograms import Grid, _blocks, frequency_grids, gls_power, opened, stretches, walked
from .series import KEY, sigclip

_ROUND = "round int, period double, power double, fap double, amplitude double, rms_before double, rms_after double, epoch double"


def removed(t: np.ndarray, m: np.ndarray, e: np.ndarray, period: float, order: int) -> tuple[np.ndarray, dict]:
    """(magnitudes around their median without the Fourier fit at ``period``, the fit)."""
    got = fit_fourier(t, m, e, period, order)
    place = np.argsort(np.argsort((t - t.min()) / period % 1.0, kind="stable"), kind="stable")
    return m - got["fit"][place] + np.median(m), got


def rounds_of(t: np.ndarray, m: np.ndarray, e: np.ndarray, freqs: np.ndarray, rounds: int, order: int, worst_fap: float | None) -> tuple[list[dict], np.ndarray]:
    """(a row for each signal taken out, what is left of the magnitudes), strongest signal first.

    It ends after ``rounds``, where no frequency has a finite power, or before a peak whose false-alarm probability, for as
    many independent frequencies as the least of points, frequencies and span, is over ``worst_fap``.
    """
    out, n = [], len(t)
    independent = min(n, len(freqs), (freqs[-1] - freqs[0]) * (t.max() - t.min())) if len(freqs) else 0.0
    for at in range(rounds):
        power = np.concatenate([gls_power(t, m, e, freqs[i:j])["power"] for i, j in _blocks(n, len(freqs))])
        power[~np.isfinite(power) | (freqs <= 0)] = -np.inf
        best = walked(-power, 1.0 / np.where(freqs > 0, freqs, np.inf), 1, 0.0)
        if not len(best) or not math.isfinite(power[best[0]]):
            break
        z = float(np.clip(power[best[0]], 0.0, 1.0))
        fap = 1.0 - (1.0 - (1.0 - z) ** ((n - 3.0) / 2.0)) ** independent
        if worst_fap is not None and fap > worst_fap:
            break
        period = 1.0 / float(freqs[best[0]])
        left, got = removed(t, m, e, period, order)
        amplitude = float(np.ptp(got["fit"]) / 2.0)
        out.append({"round": at, "period": period, "power": float(power[best[0]]), "fap": fap, "amplitude": amplitude, "rms_before": float(m.std()), "rms_after": float(left.std()), "epoch": got["epoch"]})
        m = left
    return out, m


def _calls(lc: DataFrame, grid: Grid | None, sigma: float | tuple[float, float] | None, least: int) -> DataFrame:
    """The clipped points of each object with its whole grid, one stretch an object."""
    lc = sigclip(lc, sigma).select(KEY, "t", "m", "e", "seq")
    return stretches(lc, frequency_grids(lc, least=least) if grid is None else grid, 1 << 62)


def prewhiten_rounds(lc: DataFrame, grid: Grid | None = None, rounds: int = 5, order: int = 3, worst_fap: float | None = None, sigma: float | tuple[float, float] | None = 30.0, least: int = 10) -> DataFrame:
    """(objectid, round, period, power, fap, amplitude, rms_before, rms_after, epoch): the signals of each object in turn.

    In each round the best period of the generalized Lomb-Scargle search is fitted by a Fourier series of ``order`` harmonics
    and a level, and the fit is taken out. See rounds_of() for the end. Amplitude is half of the fit's range, epoch the time of
    its faintest point. An object's points and powers are held by one task: some tens of bytes a point and frequency.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, m, e, _, freqs = opened(pdf)
        found, _ = rounds_of(t, m, e, freqs, rounds, order + 1, worst_fap)
        first = float(pdf["t"].min())
        rows = pd.DataFrame(found, columns=[c.split()[0] for c in _ROUND.split(", ")])
        rows["epoch"] += first
        rows.insert(0, KEY, pdf[KEY].iloc[0])
        return rows.astype({"round": np.int32})

    kind = lc.schema[KEY].dataType.simpleString()
    return _calls(lc, grid, sigma, least).groupBy(KEY).applyInPandas(run, f"{KEY} {kind}, {_ROUND}")


def prewhitened(lc: DataFrame, grid: Grid | None = None, rounds: int = 5, order: int = 3, worst_fap: float | None = None, sigma: float | tuple[float, float] | None = 30.0, least: int = 10) -> DataFrame:
    """(objectid, t, m, e, seq): what prewhiten_rounds() leaves of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, m, e, _, freqs = opened(pdf)
        _, left = rounds_of(t, m, e, freqs, rounds, order + 1, worst_fap)
        pdf = pdf.sort_values(["t", "seq"], kind="stable")
        return pd.DataFrame({KEY: pdf[KEY], "t": pdf["t"], "m": left, "e": pdf["e"], "seq": pdf["seq"]})

    schema = lc.select(KEY, "t", "m", "e", "seq").schema
    return _calls(lc, grid, sigma, least).groupBy(KEY).applyInPandas(run, schema)
