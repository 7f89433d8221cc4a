"""Transit least squares: a bank of limb-darkened transit shapes against the folded series, at every duration and epoch.

The series is folded and summed into phase bins. For each frequency and duration the shape slides around the circle of bins;
with a free level the fall of chi squared has a closed form in four sums, of which two are sums of the shape over bins. All
of a block's frequencies go through one matrix product a duration.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .periodograms import METHODS, Grid, Kernel, _bins, search
from .series import KEY
from .transit_fits import flux


def shape(width: int, rp: float = 0.1, b: float = 0.3, u: tuple[float, float] = (0.3, 0.2), fine: int = 8) -> np.ndarray:
    """Mean depth of a transit in each of ``width`` bins from first to last contact, the deepest point being one."""
    x = (np.arange(width * fine) + 0.5) / (width * fine) * 2 - 1
    z = np.sqrt(b * b + ((1 + rp) ** 2 - b * b) * x * x)
    deep = 1 - flux(z, rp, u)
    return (deep / deep.max()).reshape(width, fine).mean(1)


def widths(bins: int, shortest: float, longest: float, ratio: float = 1.25) -> list[int]:
    """Durations in bins, each about ``ratio`` times the one before."""
    low, high, out = max(1, round(shortest * bins)), max(1, round(longest * bins)), []
    at = float(low)
    while round(at) <= high:
        out.append(round(at))
        at = max(at * ratio, round(at) + 1.0)
    return out or [low]


def tls_kernel(bins: int = 200, shortest: float = 0.01, longest: float = 0.12, rp: float = 0.1, b: float = 0.3, u: tuple[float, float] = (0.3, 0.2)) -> Kernel:
    """Signal residue (root of the fall of chi squared, errors scaled to weights that add up to one), depth, duration and middle.

    Depth is signed as the values are: negative where flux falls. Duration and middle are in phase from the first time. Of equal
    fits the shortest, then the earliest counts.
    """
    bank = [(n, shape(n, rp, b, u)) for n in widths(bins, shortest, longest)]

    def power(x: np.ndarray, m: np.ndarray, e: np.ndarray, freqs: np.ndarray) -> dict[str, np.ndarray]:
        w = 1.0 / (e * e)
        w = w / w.sum()
        y, number = m - np.sum(w * m), len(freqs)
        at = _bins(x, freqs, bins).ravel()
        sums = lambda v: np.bincount(at, np.broadcast_to(v, (number, len(x))).ravel(), number * bins).reshape(number, bins)
        longest_bin = bank[-1][0]
        around = lambda v: np.concatenate([v, v[:, : longest_bin - 1]], 1) if longest_bin > 1 else v
        sw, sy = around(sums(w)), around(sums(w * y))
        best, depth, size, start = np.full(number, -1.0), np.zeros(number), np.zeros(number), np.zeros(number)
        rows = np.arange(number)
        for n, s in bank:
            slide = lambda v, k=n: np.lib.stride_tricks.sliding_window_view(v[:, : bins + k - 1], k, axis=1)
            one, both, by_y = slide(sw) @ s, slide(sw) @ (s * s), slide(sy) @ s
            spread = both - one * one
            gain = np.where((one > 1e-12) & (spread > 1e-12), by_y * by_y / np.maximum(spread, 1e-300), 0.0)
            j = gain.argmax(1)
            top = gain[rows, j]
            new = top > best
            best[new], size[new], start[new] = top[new], n, j[new]
            depth[new] = (by_y[rows, j] / np.maximum(spread[rows, j], 1e-300))[new]
        return {"power": np.sqrt(np.maximum(best, 0.0)), "depth": np.where(best > 0, depth, 0.0), "duration": size / bins, "middle": ((start + size / 2) / bins) % 1.0}

    return power


METHODS["tls"] = (tls_kernel(), "power", True)


def tls(lc: DataFrame, grid: Grid, **options: object) -> DataFrame:
    """(objectid, k, freq, power, depth, duration, middle) over the grid; ``options`` are those of tls_kernel()."""
    return search(lc, grid, tls_kernel(**options), ["power", "depth", "duration", "middle"])


def detection_efficiency(scores: DataFrame, score: str = "power") -> DataFrame:
    """(objectid, best, sde): the best score over the mean of all in deviations; null where all are the same."""
    g = scores.where(F.col(score).isNotNull()).groupBy(KEY).agg(F.max(score).alias("best"), F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_dev"))
    sde: Column = F.try_divide(F.col("best") - F.col("_mean"), F.when(F.col("_dev") > 0, F.col("_dev")))
    return g.select(KEY, "best", sde.alias("sde"))
