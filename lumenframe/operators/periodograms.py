"""Period searches: NumPy kernels over blocks of frequencies, one call for each object and stretch of its grid.

A grid is one (first, step, number) for all objects, or a table with a row for each object, which frequency_grids() and
bls_grids() make from its times. Points are joined with their object's grid and shuffled by object and stretch; a stretch
has about WORK pairs of point and frequency, so a small object is one call and a large one is spread over many tasks.
No row is made for a point and a frequency.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fits import savgol
from .series import KEY, dealt, finite_filter, sigclip

TWO_PI = 2.0 * math.pi

#: Pairs of point and frequency in a call of a kernel, and in an array within it, which fits a core's cache; frequencies in
#: such an array, at least.
WORK, BLOCK, ROWS = 1 << 28, 1 << 16, 16

Grid = tuple[float, float, int] | DataFrame
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def frequency_grid(t_min: float, t_max: float, n_points: int, samples_per_peak: int = 5, nyquist_factor: int = 5, min_freq: float | None = None, max_freq: float | None = None) -> tuple[float, float, int]:
    """(first, step, number) of an automatic grid."""
    df = 1.0 / ((t_max - t_min) * samples_per_peak)
    f0 = min_freq if min_freq is not None else 0.5 * df
    n = int(math.ceil((max_freq - f0) / df)) if max_freq is not None else int(0.5 * samples_per_peak * nyquist_factor * n_points)
    return f0, df, n


def frequency_grids(lc: DataFrame, samples_per_peak: int = 5, nyquist_factor: int = 5, min_freq: float | None = None, max_freq: float | None = None, least: int = 10) -> DataFrame:
    """(objectid, first, step, number): the automatic grid of each object with ``least`` points or more at two times or more."""
    g = finite_filter(lc).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span")).where((F.col("n") >= least) & (F.col("span") > 0))
    g = g.withColumn("step", 1.0 / (F.col("span") * samples_per_peak))
    g = g.withColumn("first", F.lit(float(min_freq)) if min_freq is not None else 0.5 * F.col("step"))
    n = F.ceil((F.lit(float(max_freq)) - F.col("first")) / F.col("step")) if max_freq is not None else F.floor(0.5 * samples_per_peak * nyquist_factor * F.col("n"))
    return g.select(KEY, "first", "step", n.cast("long").alias("number")).where("number > 0")


def bls_auto(time_span: float, start_period: float, end_period: float, qmin: float = 0.01) -> tuple[float, float, int, int]:
    """(first, step, number, bins): bins = ceil(2 / qmin), 3000 at most; step 0.25 qmin / span; from 2 / span at least.

    The number follows from the periods before the first frequency is raised, so the grid then goes past the first period.
    """
    low, high = 1.0 / end_period, 1.0 / start_period
    step = 0.25 * qmin / time_span
    return max(low, 2.0 / time_span), step, int(math.ceil((high - low) / step)), min(3000, int(math.ceil(2.0 / qmin)))


def bls_grids(lc: DataFrame, start_period: float | Column = 0.1, end_period: float | Column = 100.0, qmin: float = 0.01, least: int = 10) -> DataFrame:
    """(objectid, first, step, number): bls_auto() of each object's time span."""
    low, high = 1.0 / (end_period if isinstance(end_period, Column) else F.lit(float(end_period))), 1.0 / (start_period if isinstance(start_period, Column) else F.lit(float(start_period)))
    g = finite_filter(lc).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span")).where((F.col("n") >= least) & (F.col("span") > 0))
    g = g.withColumn("step", 0.25 * qmin / F.col("span"))
    return g.select(KEY, F.greatest(low, 2.0 / F.col("span")).alias("first"), "step", F.ceil((high - low) / F.col("step")).cast("long").alias("number")).where("number > 0")


def search(lc: DataFrame, grid: Grid, kernel: Kernel, columns: list[str], work: int = WORK, whole: bool = False) -> DataFrame:
    """(objectid, k, freq, columns): ``kernel(t, m, e, freqs)`` over each object's grid, in stretches.

    Points with a value, time or error that is not finite, or an error of zero, are left out; times are relative to the
    first. Objects without a grid or with no point left give no row. Scores that are not finite are null. With ``whole`` the
    kernel has a fifth argument, the values of all finite points, also of those with an error of zero.
    """
    parts = stretches(lc, grid, work, nonzero_errors=not whole)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        every = [pdf["m"].to_numpy(float)] if whole else []
        t, m, e, k, freqs = opened(pdf[pdf["e"] != 0] if whole else pdf)
        found = [kernel(t, m, e, freqs[i:j], *every) for i, j in _blocks(len(t), len(freqs))]
        got = {c: np.concatenate([q[c] for q in found]) for c in columns}
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "k": k, "freq": freqs, **{c: np.where(np.isfinite(v), v, np.nan) for c, v in got.items()}})

    kind = lc.schema[KEY].dataType.simpleString()
    return parts.groupBy(KEY, "part").applyInPandas(run, f"{KEY} {kind}, k long, freq double, " + ", ".join(f"{c} double" for c in columns))


def stretches(lc: DataFrame, grid: Grid, work: int = WORK, nonzero_errors: bool = True) -> DataFrame:
    """The points of each object, once for each stretch of its grid: (objectid, t, m, e, seq, first, step, number, size, part)."""
    rows = finite_filter(lc, nonzero_errors).select(KEY, "t", "m", "e", "seq")
    n = rows.groupBy(KEY).agg(F.count_if(F.col("e") != 0).alias("_n")).where("_n > 0")
    g = n.join(grid.select(KEY, "first", "step", "number"), KEY) if isinstance(grid, DataFrame) else n.select(KEY, "_n", F.lit(float(grid[0])).alias("first"), F.lit(float(grid[1])).alias("step"), F.lit(int(grid[2])).cast("long").alias("number"))
    size = F.greatest(F.lit(1), F.least(F.col("number"), F.floor(F.lit(work) / F.col("_n")))).cast("long")
    g = g.withColumn("size", size).select(KEY, "first", "step", "number", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("number") - 1) / F.col("size")))).alias("part"))
    return rows.join(g, KEY)


def opened(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(times from the first, m, e, k, frequencies) of a stretch, in order of time."""
    pdf = pdf.sort_values(["t", "seq"], kind="stable")
    t, m, e = (pdf[c].to_numpy(float) for c in ("t", "m", "e"))
    x = pdf.iloc[0]
    k = np.arange(int(x["part"]) * int(x["size"]), min(int(x["number"]), (int(x["part"]) + 1) * int(x["size"])))
    return t - t[0], m, e, k, float(x["first"]) + k * float(x["step"])


def _blocks(points: int, count: int) -> Iterator[tuple[int, int]]:
    """(start, end) of blocks of frequencies whose arrays have about BLOCK elements."""
    size = max(ROWS, BLOCK // max(1, points))
    for i in range(0, count, size):
        yield i, min(i + size, count)


def turns(x: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """exp(2 pi i f x) for each of evenly spaced frequencies and each point: rows by doubling, a product each."""
    number = len(freqs)
    z = np.empty((number, len(x)), complex)
    z[0] = np.exp(TWO_PI * 1j * freqs[0] * x)
    have, ahead = 1, np.exp(TWO_PI * 1j * (freqs[-1] - freqs[0]) / max(1, number - 1) * x)
    while have < number:
        more = min(have, number - have)
        np.multiply(z[:more], ahead, out=z[have : have + more])
        have, ahead = have + more, ahead * ahead
    return z


def gls_power(x: np.ndarray, m: np.ndarray, e: np.ndarray, freqs: np.ndarray) -> dict[str, np.ndarray]:
    """Generalized Lomb-Scargle power with a floating mean; of ``m`` with a row for each of many series, a row for each."""
    w = 1.0 / (e * e)
    w = w / w.sum()
    y = m - (m @ w)[..., None]
    z = turns(x, freqs)
    plain, twice = z @ w, (z * z) @ w
    by_y = z @ (w * y) if y.ndim == 1 else (w * y) @ z.T
    c, s, yc, ys = plain.real, plain.imag, by_y.real, by_y.imag
    cc, ss, cs = 0.5 * (1.0 + twice.real) - c * c, 0.5 * (1.0 - twice.real) - s * s, 0.5 * twice.imag - c * s
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"power": (ss * yc * yc + cc * ys * ys - 2.0 * cs * yc * ys) / (((y * y) @ w)[..., None] * (cc * ss - cs * cs))}


def window_power(x: np.ndarray, m: np.ndarray, e: np.ndarray, freqs: np.ndarray) -> dict[str, np.ndarray]:
    """Lomb-Scargle power of the sampling, of a constant one: with tau from the sums at twice the frequency."""
    z = turns(x, freqs)
    one, two = z.sum(1), (z * z).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        th = np.arctan(two.imag / two.real) / 2.0
        turned = one * np.exp(-1j * th)
        half = (two * np.exp(-2j * th)).real / 2.0
        n = len(x) / 2.0
        return {"power": 0.5 * (turned.real**2 / (n + half) + turned.imag**2 / (n - half))}


def folded(x: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Phases from the first time for each frequency and point."""
    p = np.outer(freqs, x)
    return p - np.floor(p)


def _bins(x: np.ndarray, freqs: np.ndarray, bins: int) -> np.ndarray:
    """Number of the phase bin of each frequency and point; bins of later frequencies follow those of earlier ones."""
    b = np.minimum((folded(x, freqs) * bins).astype(np.int64), bins - 1)
    return b + bins * np.arange(len(freqs))[:, None]


def pdm_kernel(bins: int = 20, least: int = 9) -> Kernel:
    """Phase dispersion minimization; bins with more than ``least`` points count."""

    def theta(x: np.ndarray, m: np.ndarray, e: np.ndarray, freqs: np.ndarray) -> dict[str, np.ndarray]:
        y, number = m - m.mean(), len(freqs)
        b = _bins(x, freqs, bins).ravel()
        sums = lambda v=None: np.bincount(b, None if v is None else np.broadcast_to(v, (number, len(x))).ravel(), number * bins).reshape(number, bins)
        n, s, q = sums(), sums(y), sums(y * y)
        use = n > least
        with np.errstate(divide="ignore", invalid="ignore"):
            top = np.where(use, q - s * s / n, 0.0).sum(1) / ((n * use).sum(1) - use.sum(1))
            return {"theta": np.where(use.any(1), top / y.var(ddof=1), np.nan)}

    return theta


def aov_kernel(bins: int = 20, least: int = 9) -> Kernel:
    """Analysis of variance with medians; s2 takes deviations from the overall median.

    That median and the number of points are those of ``every`` value, if given, or else of ``m``.
    """

    def theta(x: np.ndarray, m: np.ndarray, e: np.ndarray, freqs: np.ndarray, every: np.ndarray | None = None) -> dict[str, np.ndarray]:
        every = m if every is None else every
        order = np.argsort(m, kind="stable")
        y = m[order] - np.median(every)
        out = np.empty(len(freqs))
        for i in range(0, len(freqs), 60_000 // bins):  # keys of 16 bits are sorted in linear time
            k = min(60_000 // bins, len(freqs) - i)
            key = _bins(x[order], freqs[i : i + k], bins).astype(np.uint16).ravel()
            n = np.bincount(key, None, k * bins)
            ys = np.broadcast_to(y, (k, len(y))).ravel()
            by = ys[np.argsort(key, kind="stable")]
            start = np.cumsum(n) - n
            low, high = np.minimum(start + np.maximum(n - 1, 0) // 2, len(by) - 1), np.minimum(start + n // 2, len(by) - 1)
            med = 0.5 * (by[low] + by[high])
            use = (n > least).reshape(k, bins)
            total = np.bincount(key, ys * ys, k * bins).reshape(k, bins)
            groups = use.sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                s1 = np.where(use, (n * med * med).reshape(k, bins), 0.0).sum(1) / (groups - 1)
                out[i : i + k] = np.where(groups > 0, s1 / (np.where(use, total, 0.0).sum(1) / (len(every) - groups)), np.nan)
        return {"theta": out}

    return theta


def string_kernel(x: np.ndarray, m: np.ndarray, e: np.ndarray, freqs: np.ndarray) -> dict[str, np.ndarray]:
    """Length of the folded curve, magnitudes scaled to a quarter around zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        y = (m - m.min()) / (2.0 * (m.max() - m.min())) - 0.25
    p = folded(x, freqs)
    order = np.argsort(p, axis=1, kind="stable")
    dp, dy = np.diff(np.take_along_axis(p, order, 1)), np.diff(y[order])
    return {"length": np.sqrt(dp * dp + dy * dy).sum(1)}


def aovhm_kernel(harmonics: int = 6) -> Kernel:
    """Multi-harmonic analysis of variance, by recursive orthogonal projection."""

    def theta(x: np.ndarray, m: np.ndarray, e: np.ndarray, freqs: np.ndarray) -> dict[str, np.ndarray]:
        w = 1.0 / e
        y = (m - np.sum(m * w * w) / np.sum(w * w)) * w
        total, n, terms = np.sum(y * y), len(x), 2 * harmonics
        z = turns(x, freqs)
        target = y * z**harmonics
        basis, turned = np.broadcast_to(w.astype(complex), z.shape), np.ones_like(z)
        out = np.zeros(len(freqs))
        for _ in range(terms):
            norm = np.maximum(np.sum(np.abs(basis) ** 2, 1), 1e-8)
            out += np.abs(np.sum(basis.conj() * target, 1)) ** 2 / norm
            share = np.sum(w * z * basis, 1) / norm
            basis = basis * z - share[:, None] * turned * basis.conj()
            turned = turned * z
        return {"theta": (n - terms - 1.0) * out / (terms * np.maximum(total - out, 1e-9))}

    return theta


def bls_kernel(bins: int = 200, qmin: float = 0.01, qmax: float = 0.1) -> Kernel:
    """Box least squares: signal residue, depth, duration in phase and phase of ingress of the best box.

    Weighted sums in phase bins, then prefix sums over the doubled circle give every box at once. Of equal boxes the
    shortest, then the earliest counts.
    """
    lengths = range(max(1, int(qmin * bins)), max(2, int(qmax * bins) + 2))

    def power(x: np.ndarray, m: np.ndarray, e: np.ndarray, freqs: np.ndarray) -> dict[str, np.ndarray]:
        w = 1.0 / (e * e)
        w = w / w.sum()
        y, number = m - np.sum(w * m), len(freqs)
        b = _bins(x, freqs, bins).ravel()
        sums = lambda v: np.bincount(b, np.broadcast_to(v, (number, len(x))).ravel(), number * bins).reshape(number, bins)
        around = lambda v: np.cumsum(np.concatenate([np.zeros((number, 1)), v, v], 1), 1)
        cw, cy = around(sums(w)), around(sums(w * y))
        best, size, start = np.full(number, -1.0), np.zeros(number), np.zeros(number)
        rows = np.arange(number)
        r, s, spread = (np.empty((number, bins)) for _ in range(3))  # the same memory for all lengths
        for n in lengths:
            np.subtract(cw[:, n : bins + n], cw[:, :bins], out=r)
            np.subtract(cy[:, n : bins + n], cy[:, :bins], out=s)
            np.subtract(1.0, r, out=spread)
            spread *= r
            np.maximum(spread, 1e-300, out=spread)
            s *= s
            s /= spread
            s[(r <= 1e-12) | (r >= 1 - 1e-12)] = 0.0
            j = s.argmax(1)
            top = s[rows, j]
            new = top > best
            best[new], size[new], start[new] = top[new], n, j[new]
        first, last = start.astype(int), (start + size).astype(int)
        rr, sy = cw[rows, last] - cw[rows, first], cy[rows, last] - cy[rows, first]
        with np.errstate(divide="ignore", invalid="ignore"):
            depth = np.where((rr > 0) & (rr < 1), sy / (rr * (1 - rr)), 0.0)
        return {"power": np.sqrt(np.maximum(best, 0.0)), "depth": depth, "duration": size / bins, "ingress": start / bins}

    return power


def _grid(first: float | DataFrame, step: float | None, number: int | None) -> Grid:
    return first if isinstance(first, DataFrame) else (first, step, number)


def gls(lc: DataFrame, first: float | DataFrame, step: float | None = None, number: int | None = None) -> DataFrame:
    """(objectid, k, freq, power): generalized Lomb-Scargle."""
    return search(lc, _grid(first, step, number), gls_power, ["power"])


def spectral_window(lc: DataFrame, first: float | DataFrame, step: float | None = None, number: int | None = None) -> DataFrame:
    """(objectid, k, freq, power): the periodogram of the sampling itself."""
    return search(lc.withColumns({"m": F.lit(1.0), "e": F.lit(1.0)}), _grid(first, step, number), window_power, ["power"])


def pdm(lc: DataFrame, first: float | DataFrame, step: float | None = None, number: int | None = None, bins: int = 20, least: int = 9) -> DataFrame:
    """(objectid, k, freq, theta); frequencies without a bin that counts are left out."""
    return search(lc, _grid(first, step, number), pdm_kernel(bins, least), ["theta"])


def aov(lc: DataFrame, first: float | DataFrame, step: float | None = None, number: int | None = None, bins: int = 20, least: int = 9, whole: bool = False) -> DataFrame:
    """(objectid, k, freq, theta); with ``whole`` the median and number of all points also count those with an error of zero."""
    return search(lc, _grid(first, step, number), aov_kernel(bins, least), ["theta"], whole=whole)


def string_length(lc: DataFrame, first: float | DataFrame, step: float | None = None, number: int | None = None) -> DataFrame:
    """(objectid, k, freq, length)."""
    return search(lc, _grid(first, step, number), string_kernel, ["length"])


def aovhm(lc: DataFrame, first: float | DataFrame, step: float | None = None, number: int | None = None, harmonics: int = 6) -> DataFrame:
    """(objectid, k, freq, theta)."""
    return search(lc, _grid(first, step, number), aovhm_kernel(harmonics), ["theta"])


def bls(lc: DataFrame, first: float | DataFrame, step: float | None = None, number: int | None = None, bins: int = 200, qmin: float = 0.01, qmax: float = 0.1) -> DataFrame:
    """(objectid, k, freq, power, depth, duration, ingress)."""
    return search(lc, _grid(first, step, number), bls_kernel(bins, qmin, qmax), ["power", "depth", "duration", "ingress"])


def peaks(scores: DataFrame, score: str = "power", best: int = 5, epsilon: float = 0.1, largest: bool = True) -> DataFrame:
    """(objectid, rank, period, score): greedy best peaks, each over ``epsilon`` (relative) away from those before.

    A candidate must differ from the candidate before it in order of score and from every accepted period. The order
    and the walk are array functions on one row for each object.
    """
    value = F.col(score) if largest else -F.col(score)
    ok = scores.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.col("freq") > 0))
    rows = ok.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct((-value).alias("s"), "k", (1.0 / F.col("freq")).alias("p")))).alias("a"))
    walk = f"""aggregate(a, named_struct('got', cast(array() AS array<struct<p: double, s: double>>), 'last', cast(NULL AS double)), (acc, x) ->
        named_struct('got', CASE WHEN size(acc.got) < {best} AND (acc.last IS NULL OR (abs(x.p - acc.last) > {epsilon} * acc.last AND NOT exists(acc.got, y -> abs(x.p - y.p) <= {epsilon} * y.p)))
            THEN concat(acc.got, array(named_struct('p', x.p, 's', x.s))) ELSE acc.got END, 'last', x.p), acc -> acc.got)"""
    got = rows.select(KEY, F.posexplode(F.expr(walk)).alias("rank", "x"))
    return got.select(KEY, (F.col("rank") + 1).alias("rank"), F.col("x.p").alias("period"), (-F.col("x.s") if largest else F.col("x.s")).alias(score))


def walked(s: np.ndarray, p: np.ndarray, best: int, epsilon: float) -> np.ndarray:
    """Places of the peaks that peaks() takes, of values ``s`` (least first, ties in order) at periods ``p``."""
    order = np.argsort(s, kind="stable")
    q = p[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = np.abs(q[1:] - q[:-1]) > epsilon * q[:-1]
    left, got = np.flatnonzero(fresh), []
    while len(left) and len(got) < best:
        got.append(left[0])
        left = left[1:][np.abs(q[left[1:]] - q[left[0]]) > epsilon * q[left[0]]]
    return order[got]


def best_peaks(lc: DataFrame, grid: Grid, methods: list[str], best: int = 5, epsilon: float = 0.1, work: int = WORK) -> DataFrame:
    """(objectid, method, rank, period, score): peaks() of each of ``methods`` (names of METHODS) over one grid.

    All methods run in one call over an object's points. A whole grid in one call leaves only its peaks; of a grid in several
    stretches the scores meet once, packed, eight bytes a frequency and method, and no row is made for a frequency.
    """
    how = {name: METHODS[name] for name in methods}
    kind = lc.schema[KEY].dataType.simpleString()
    names = [KEY, "method", "part", "first", "step", "packed", "period", "score"]

    def found(name: str, v: np.ndarray, freqs: np.ndarray) -> tuple[list[float], list[float]]:
        at = np.flatnonzero(np.isfinite(v) & (freqs > 0))
        p = 1.0 / freqs[at]
        top = walked(-v[at] if how[name][2] else v[at], p, best, epsilon)
        return p[top].tolist(), v[at][top].tolist()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, m, e, _, freqs = opened(pdf)
        x = pdf.iloc[0]
        out = []
        for name, (kernel, score, _) in how.items():
            v = np.concatenate([kernel(t, m, e, freqs[i:j])[score] for i, j in _blocks(len(t), len(freqs))])
            whole = len(freqs) == int(x["number"])
            period, value = found(name, v, freqs) if whole else (None, None)
            out.append((x[KEY], name, int(x["part"]), float(x["first"]), float(x["step"]), None if whole else v.astype(float).tobytes(), period, value))
        return pd.DataFrame(out, columns=names)

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            tops = []
            for name, first, step, period, score, pieces in zip(*(pdf[c] for c in ("method", "first", "step", "period", "score", "pieces")), strict=True):
                if len(pieces):
                    v = np.concatenate([np.frombuffer(b, float) for _, b in sorted((int(y["part"]), y["packed"]) for y in pieces)])
                    period, score = found(name, v, first + np.arange(len(v)) * step)
                tops.append((period, score))
            sizes = [len(x) for x, _ in tops]
            flat = [np.concatenate([np.zeros(0), *(x[c] for x in tops)]) for c in (0, 1)]
            yield pd.DataFrame({KEY: np.repeat(pdf[KEY], sizes), "method": np.repeat(pdf["method"], sizes), "rank": np.concatenate([np.zeros(0), *(np.arange(1, n + 1) for n in sizes)]).astype(np.int32), "period": flat[0], "score": flat[1]})

    rows = stretches(lc, grid, work).groupBy(KEY, "part").applyInPandas(run, f"{KEY} {kind}, method string, part long, first double, step double, packed binary, period array<double>, score array<double>")
    met = rows.groupBy(KEY, "method").agg(F.first("first").alias("first"), F.first("step").alias("step"), F.first("period").alias("period"), F.first("score").alias("score"), F.collect_list(F.when(F.col("packed").isNotNull(), F.struct("part", "packed"))).alias("pieces"))
    return met.mapInPandas(merge, f"{KEY} {kind}, method string, rank int, period double, score double")


def combined(scores: dict[str, tuple[DataFrame, str, bool]], width: float) -> DataFrame:
    """(objectid, bin, freq, methods, power): several periodograms of unlike grids added up in bins of frequency.

    ``scores`` has for each method (rows of objectid and freq, the score's column, whether the largest is best). A method's
    scores become shares of its object's largest, and where the least is best that least over the score; each stands for the
    stretch up to halfway to its neighbours, and counts in every bin of ``width`` that it overlaps, the best in a bin for its
    method. The sums over methods are divided by their object's largest; ``methods`` counts those with a score in the bin.
    """
    parts = None
    for name, (rows, score, largest) in scores.items():
        ok = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.col("freq") > 0)).select(KEY, "freq", F.col(score).alias("v"))
        by = Window.partitionBy(KEY)
        best = F.max("v").over(by) if largest else F.min("v").over(by)
        ok = ok.withColumn("p", F.try_divide("v", F.when(best != 0, best)) if largest else F.try_divide(best, F.when(F.col("v") != 0, F.col("v"))))
        order = by.orderBy("freq")
        low, high = ((F.col("freq") + F.coalesce(f("freq").over(order), F.col("freq"))) / 2 for f in (F.lag, F.lead))
        ok = ok.withColumns({"low": low, "high": high}).where("p IS NOT NULL")
        binned = ok.select(KEY, "p", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))).alias("bin"))
        part = binned.groupBy(KEY, "bin").agg(F.max("p").alias("p")).withColumn("method", F.lit(name))
        parts = part if parts is None else parts.unionAll(part)
    total = parts.groupBy(KEY, "bin").agg(F.count(F.lit(1)).cast("int").alias("methods"), F.sum("p").alias("p"))
    return total.select(KEY, "bin", ((F.col("bin") + 0.5) * width).alias("freq"), "methods", F.try_divide("p", F.max("p").over(Window.partitionBy(KEY))).alias("power"))


def independent_frequencies(freq_span: Column, time_span: Column, n_times: Column, n_freqs: Column) -> Column:
    """The least of number of times, of frequencies, and the product of spans."""
    return F.least(n_times.cast("double"), n_freqs.cast("double"), freq_span * time_span)


def gls_fap(power: Column, n: Column, independent: Column) -> Column:
    """False-alarm probability 1 - (1 - (1 - z)^((n - 3) / 2))^M."""
    return 1.0 - F.pow(1.0 - F.pow(1.0 - power, (n - 3.0) / 2.0), independent)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1e-300, 1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d)
            c = 1.0 + num / c
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * h


def pdm_fap(theta: float, n: int, bins: int, independent: float) -> float:
    return 1.0 - (1.0 - _incomplete_beta((n - bins) / 2.0, (bins - 1) / 2.0, (n - bins) / (n - 1.0) * theta)) ** independent


def f_cdf(x: float, d1: float, d2: float) -> float:
    return _incomplete_beta(d1 / 2.0, d2 / 2.0, d1 * x / (d1 * x + d2))


def aov_fap(theta: float, n: int, bins: int) -> float:
    """By the distribution function, as the method has it (not by the survival function)."""
    return f_cdf(theta, bins - 1.0, float(n - bins))


def aovhm_fap(theta: float, n: int, harmonics: int) -> float:
    return f_cdf(theta, 2.0 * harmonics, n - 2.0 * harmonics - 1.0)


def acf_period(acf: DataFrame, cadence: float, smooth: int = 21, degree: int = 2, most: int = 10, interval: int | None = None) -> DataFrame:
    """(objectid, best_lag, naive_period, period, height) from ``acf`` (objectid, lag, acf), at most a maximum lag's rows each.

    The autocorrelation is smoothed by a Savitzky-Golay filter (or not, where ``smooth`` is 0). Peaks are the first ``most``
    points above all within ``interval`` (half of ``smooth``); a peak's height is over the mean of the minima beside it, and
    peaks without one on either side do not count. Of the first and second peak the higher is the best lag. The period is
    the slope of a line through (0, best lag, later peaks' lags) times the cadence; null with fewer than two peaks.
    """
    near = max(1, smooth // 2) if interval is None else interval

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        lag, y = pdf["lag"].to_numpy(float), pdf["acf"].to_numpy(float)
        y = savgol(y, smooth, degree) if smooth and len(y) >= smooth else y
        n = len(y)
        beside = [[y[min(max(i + s * d, 0), n - 1)] for d in range(1, near + 1) for s in (-1, 1)] for i in range(n)]
        tops = [i for i in range(n) if y[i] > max(beside[i])]
        lows = [i for i in range(n) if y[i] < min(beside[i])]
        heights, lags = [0.0] * most, [0.0] * most
        for rank, i in enumerate(tops[:most]):
            left, right = [j for j in lows if j < i], [j for j in lows if j > i]
            if left and right:
                heights[rank], lags[rank] = y[i] - (y[left[-1]] + y[right[0]]) / 2.0, lag[i]
        best = 0 if most < 2 or heights[0] > heights[1] else 1
        if heights[best] == 0.0:
            return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "best_lag": [None], "naive_period": [None], "period": [None], "height": [None]})
        line = np.array([0.0, lags[best], *[x for x in lags if x > lags[best]]]) * cadence
        slope = np.polyfit(np.arange(len(line)), line, 1)[0] if len(line) > 2 else None
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "best_lag": [int(lags[best])], "naive_period": [lags[best] * cadence], "period": [slope], "height": [heights[best]]})

    kind = acf.schema[KEY].dataType.simpleString()
    return acf.groupBy(KEY).applyInPandas(run, f"{KEY} {kind}, best_lag long, naive_period double, period double, height double")


def bootstrap_fap(lc: DataFrame, grid: Grid, kernel: Kernel = gls_power, score: str = "power", trials: int = 250, largest: bool = True, seed: int = 3, work: int = WORK) -> DataFrame:
    """(objectid, best, fap): the share of ``trials`` in which magnitudes drawn anew, with replacement, score as well or better.

    fap is (1 + such trials) / (trials + 1). Draws follow from seed, object and trial, so a rerun is the same. Each stretch
    of a grid gives the best score of each trial; stretches are combined by object and trial. Of the kernels, gls_power takes
    many trials at once, as a product of matrices: what does not depend on the magnitudes is made once.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, m, e, _, freqs = opened(pdf)
        name = pdf[KEY].iloc[0]
        key, best = xxhash64(str(name)), np.full(trials + 1, np.nan)
        size = max(1, BLOCK // len(m)) if kernel is gls_power else 1
        for a in range(0, trials + 1, size):
            every = range(a, min(trials + 1, a + size))
            drawn = np.stack([m if trial == 0 else m[np.random.default_rng((seed, trial, key)).integers(0, len(m), len(m))] for trial in every])  # trial 0 is the series as it is
            for i, j in _blocks(max(len(t), len(drawn)), len(freqs)):
                v = kernel(t, drawn if kernel is gls_power else drawn[0], e, freqs[i:j])[score].reshape(len(drawn), -1)
                v = np.where(np.isfinite(v), v if largest else -v, -np.inf).max(1)
                best[a : a + size] = np.fmax(best[a : a + size], np.where(np.isfinite(v), v, np.nan))
        return pd.DataFrame({KEY: name, "trial": np.arange(trials + 1), "score": best})

    kind = lc.schema[KEY].dataType.simpleString()
    got = dealt(stretches(lc, grid, max(1, work // (trials + 1))), KEY, "part").groupBy(KEY, "part").applyInPandas(run, f"{KEY} {kind}, trial int, score double")
    top = got.groupBy(KEY, "trial").agg(F.max("score").alias("score"))
    g = top.groupBy(KEY).agg(F.max(F.when(F.col("trial") == 0, F.col("score"))).alias("own"), F.collect_list(F.when(F.col("trial") > 0, F.col("score"))).alias("drawn"))
    best = F.col("own") if largest else -F.col("own")
    return g.select(KEY, best.alias("best"), ((1 + F.size(F.filter("drawn", lambda x: x >= F.col("own")))) / F.lit(trials + 1.0)).alias("fap"))


def xxhash64(text: str) -> int:
    """A hash of a name that is the same in every process."""
    import zlib

    return zlib.crc32(text.encode()) << 32 | zlib.adler32(text.encode())


def _column(f: Callable[..., float]):  # noqa: ANN202
    """``f`` of numbers as a column expression, null where an argument is; for the few rows of a table of peaks."""

    @F.pandas_udf("double")
    def column(*values: pd.Series) -> pd.Series:
        rows = zip(*(v.astype(float) for v in values), strict=True)
        return pd.Series([f(*r) if all(map(math.isfinite, r)) else None for r in rows], dtype="float64")

    return lambda *c: column(*[F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x)) for x in c])


def fap(method: str, score: Column | str, n: Column | str, groups: int, independent: Column | float = 1.0) -> Column:
    """False-alarm probability of a peak by method: pdm (groups: bins), aov (bins), mav (harmonics)."""
    if method == "pdm":
        return _column(lambda z, k, m: pdm_fap(z, int(k), groups, m))(score, n, independent)
    if method == "aov":
        return _column(lambda z, k: aov_fap(z, int(k), groups))(score, n)
    if method == "mav":
        return _column(lambda z, k: aovhm_fap(z, int(k), groups))(score, n)
    raise ValueError(f"no method {method!r}")


#: Period finders by name: (kernel, score, whether the largest score is best). register_method() adds to them.
METHODS: dict[str, tuple[Kernel, str, bool]] = {
    "gls": (gls_power, "power", True), "win": (window_power, "power", True), "pdm": (pdm_kernel(), "theta", False), "aov": (aov_kernel(), "theta", True),
    "mav": (aovhm_kernel(), "theta", True), "bls": (bls_kernel(), "power", True), "string": (string_kernel, "length", False),
}


def register_method(name: str, kernel: Kernel, score: str, largest: bool = True) -> None:
    """Adds a period finder, or replaces one."""
    METHODS[name] = (kernel, score, largest)


def find_periods(lc: DataFrame, methods: list[str], grids: dict[str, Grid] | None = None, best: int = 5, epsilon: float = 0.1, sigma: float | tuple[float, float] | None = 10.0, least: int = 10) -> DataFrame:
    """(objectid, method, rank, period, score): the best peaks of every object by every method, in one table.

    Series are clipped first and need ``least`` points. Methods without a grid of their own share the automatic one, of each
    object. Methods that share a grid read the points once and run in one call; see best_peaks() for what leaves it.
    """
    lc = sigclip(lc, sigma).select(KEY, "t", "m", "e", "seq")
    shared: list[tuple[Grid | None, list[str]]] = []
    for name in methods:
        grid = (grids or {}).get(name)
        same = next((names for g, names in shared if g is grid or isinstance(g, tuple) and g == grid), None)
        if same is None:
            shared.append((grid, [name]))
        else:
            same.append(name)
    out = None
    for grid, names in shared:
        found = best_peaks(lc, frequency_grids(lc, least=least) if grid is None else grid, names, best, epsilon)
        out = found if out is None else out.unionAll(found)
    return out


def box_stats(lc: DataFrame, boxes: DataFrame) -> DataFrame:
    """(objectid, rank, n_in, depth, rms, snr) of boxes (objectid, rank, period, epoch, depth, duration) around phase 0.

    The model is the median less the depth inside the box; snr is sqrt(n_in) |depth| / the deviation of the residuals.
    """
    j = finite_filter(lc).select(KEY, "t", "m").join(boxes.select(KEY, "rank", "period", "epoch", "depth", "duration"), KEY)
    x = (F.col("t") - F.col("epoch")) / F.col("period")
    j = j.withColumn("p", x - F.floor(x)).withColumn("inside", (F.col("p") < F.col("duration") / 2) | (F.col("p") > 1 - F.col("duration") / 2))
    r = F.col("m") + F.when(F.col("inside"), F.col("depth")).otherwise(0.0)
    g = j.groupBy(KEY, "rank").agg(F.count_if("inside").alias("n_in"), F.min("depth").alias("depth"), F.stddev_pop(r).alias("rms"))
    return g.select(KEY, "rank", "n_in", "depth", "rms", F.try_divide(F.sqrt(F.col("n_in").cast("double")) * F.abs("depth"), F.col("rms")).alias("snr"))


def bls_stats(lc: DataFrame, peaks: DataFrame, percent: float = 10.0, bins: int = 200, qmin: float = 0.01, qmax: float = 0.4, ingress: float = 0.1, sigma: float | None = 10.0, least: int = 10) -> DataFrame:
    """(objectid, rank, period, epoch, depth, duration, ingress, n_in, snr, status) of each peak (objectid, rank, period).

    The box search runs again within ``percent`` of the peak's period. A trapezoid that starts from the box, its epoch at the
    faintest point of a spline over phase, is fitted; status is "ok" and snr is sqrt(points in transit) |depth| / the
    deviation of the residuals. Where no fit converges the box stands in, with status "box".
    """
    from .fits import fit_spline, fit_trapezoid, fold

    kernel = bls_kernel(bins, qmin, qmax)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "seq"], kind="stable")
        t, m, e = (pdf[c].to_numpy(float) for c in ("t", "m", "e"))
        out = {c: [pdf[c].iloc[0]] for c in (KEY, "rank")}
        p, span = float(pdf["period"].iloc[0]), t[-1] - t[0]
        if len(t) < least or span <= 0 or not p > 0:
            return pd.DataFrame(out | dict.fromkeys(("period", "epoch", "depth", "duration", "ingress", "n_in", "snr"), [None]) | {"status": ["too few points"]})
        first, step, number, _ = bls_auto(span, p - p * percent / 100.0, p + p * percent / 100.0, qmin)
        freqs = first + step * np.arange(max(1, number))
        found = [kernel(t - t[0], m, e, freqs[i:j]) for i, j in _blocks(len(t), len(freqs))]
        got = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
        i = int(got["power"].argmax())
        period, depth, duration = 1.0 / freqs[i], -float(got["depth"][i]), float(got["duration"][i])
        epoch = fit_spline(t, m, e, period, 0.05)["epoch"]
        fitted = fit_trapezoid(t, m, e, period, epoch, depth, duration, min(ingress * duration, duration / 2))
        status, slope = "ok", None
        if fitted["params"] is not None and np.isfinite(fitted["fit"]).all():
            _, epoch, depth, duration, slope = fitted["params"]
            phase, mags = fold(t, m, e, period, epoch)[:2]
            left = mags - fitted["fit"]
        else:
            status = "box"
            phase, mags = fold(t, m, e, period, epoch)[:2]
            left = mags - np.median(mags) + np.where((phase < duration / 2) | (phase > 1 - duration / 2), depth, 0.0)
        n = int(((phase < duration / 2) | (phase > 1 - duration / 2)).sum())
        rms = float(left.std())
        return pd.DataFrame(out | {"period": [period], "epoch": [epoch], "depth": [depth], "duration": [duration], "ingress": [slope], "n_in": [n], "snr": [math.sqrt(n) * abs(depth) / rms if rms else None], "status": [status]})

    kind = lc.schema[KEY].dataType.simpleString()
    rows = sigclip(lc, sigma).select(KEY, "t", "m", "e", "seq").join(peaks.select(KEY, F.col("rank").cast("int").alias("rank"), "period"), KEY)
    return rows.groupBy(KEY, "rank").applyInPandas(run, f"{KEY} {kind}, rank int, period double, epoch double, depth double, duration double, ingress double, n_in long, snr double, status string")
