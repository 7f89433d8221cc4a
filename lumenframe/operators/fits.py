"""Model fits, one call of a NumPy kernel for each object: linear least squares, or Levenberg-Marquardt within bounds.

A fit is a row: objectid, model, params, errs, chisq, redchisq, epoch, n; null params where it did not converge.
"""

from __future__ import annotations

import contextlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import KEY, dealt, finite_filter


def fold(t: np.ndarray, m: np.ndarray, e: np.ndarray, period: float, epoch: float | None = None) -> tuple[np.ndarray, ...]:
    """(phase, m, e, t) in order of phase; the epoch is the first time if none is given."""
    x = (t - (t.min() if epoch is None else epoch)) / period
    p = x - np.floor(x)
    o = np.argsort(p, kind="stable")
    return p[o], m[o], e[o], t[o]


def scores(m: np.ndarray, fit: np.ndarray, e: np.ndarray, free: int) -> tuple[float, float]:
    """(chi squared, reduced chi squared)."""
    c = float(np.sum(((fit - m) / e) ** 2))
    return c, c / (len(m) - free) if len(m) > free else math.nan


def bspline_basis(x: np.ndarray, knots: np.ndarray, low: float, high: float, degree: int = 3) -> np.ndarray:
    """Values of all B-splines over inner knots at x, by the recursion of Cox and de Boor."""
    t = np.concatenate([[low] * (degree + 1), knots, [high] * (degree + 1)])
    b = np.array([(x >= t[i]) & (x < t[i + 1]) for i in range(len(t) - 1)], float).T
    last = np.flatnonzero(t[:-1] < t[1:])[-1]
    b[x >= high, last] = 1.0
    for d in range(1, degree + 1):
        left = np.array([(x - t[i]) / (t[i + d] - t[i]) if t[i + d] > t[i] else np.zeros_like(x) for i in range(len(t) - d - 1)]).T
        right = np.array([(t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) if t[i + d + 1] > t[i + 1] else np.zeros_like(x) for i in range(len(t) - d - 1)]).T
        b = left * b[:, :-1] + right * b[:, 1:]
    return b


def savgol(y: np.ndarray, window: int, degree: int, mode: str = "interp") -> np.ndarray:
    """Savitzky-Golay filter; edges wrap around or follow the polynomial of the first and last window."""
    h = window // 2
    v = np.vander(np.arange(-h, h + 1), degree + 1, increasing=True)
    coef = np.linalg.pinv(v)[0]
    if mode == "wrap":
        return np.convolve(np.concatenate([y[-h:], y, y[:h]]), coef[::-1], "valid")
    out = np.convolve(y, coef[::-1], "same")
    for part, at in ((slice(0, window), np.arange(h)), (slice(len(y) - window, len(y)), np.arange(len(y) - h, len(y)))):
        c = np.polynomial.polynomial.polyfit(np.arange(len(y))[part] - at[0], y[part], degree)
        out[at] = np.polynomial.polynomial.polyval(at - at[0], c)
    return out


def least_squares(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 100, steps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(parameters, their errors) that minimize the sum of f squared within bounds, or None. ``steps``: of its slopes."""
    x, lam = np.clip(np.asarray(start, float), low, high), 1e-3
    r = f(x)
    cost = r @ r
    j = None
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(x), 1e-4) if steps is None else steps
        j = np.stack([(f(x + d) - (r if steps is None else f(x - d))) / (d.sum() * (1 if steps is None else 2)) for d in np.diag(step)], 1)
        a, g = j.T @ j, j.T @ r
        for _ in range(12):
            try:
                new = np.clip(x - np.linalg.solve(a + lam * np.diag(np.maximum(np.diag(a), 1e-12)), g), low, high)
            except np.linalg.LinAlgError:
                lam *= 10
                continue
            rn = f(new)
            if np.isfinite(rn).all() and rn @ rn < cost:
                break
            lam *= 10
        else:
            break
        done = cost - rn @ rn < 1e-12 * max(cost, 1e-300) or rn @ rn < 1e-12
        x, r, cost, lam = new, rn, rn @ rn, lam / 10
        if done:
            break
    if j is None or not np.isfinite(x).all():
        return None
    cov = np.linalg.pinv(j.T @ j)
    return x, np.sqrt(np.maximum(np.diag(cov), 0.0))


def least_squares_many(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 100, steps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, whether they are finite) of many fits at once, each by the steps of least_squares(); a row a fit.

    ``f(x, at)`` gives residuals of the fits numbered ``at`` at parameters ``x``, zero where a fit has fewer points than others.
    """
    x = np.clip(start, low, high)
    count, width = x.shape
    r = f(x, np.arange(count))
    cost, lam, going = np.einsum("ij,ij->i", r, r), np.full(count, 1e-3), np.arange(count)
    for _ in range(rounds):
        if not len(going):
            break
        j = np.empty((len(going), r.shape[1], width))
        for i in range(width):
            d = np.zeros_like(x[going])
            d[:, i] = 1e-6 * np.maximum(np.abs(x[going, i]), 1e-4) if steps is None else steps[going, i]
            j[:, :, i] = (f(x[going] + d, going) - (r[going] if steps is None else f(x[going] - d, going))) / (d[:, i] * (1 if steps is None else 2))[:, None]
        a, g = np.swapaxes(j, 1, 2) @ j, (np.swapaxes(j, 1, 2) @ r[going][:, :, None])[:, :, 0]
        scale = np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-12)
        left, on = np.arange(len(going)), np.zeros(len(going), bool)
        for _ in range(12):
            if not len(left):
                break
            k = going[left]
            new = np.clip(x[k] - _solved(a[left] + (lam[k, None] * scale[left])[:, :, None] * np.eye(width), g[left]), low[k], high[k])
            rn = f(new, k)
            cn = np.einsum("ij,ij->i", rn, rn)
            ok = np.isfinite(rn).all(1) & (cn < cost[k])
            won = k[ok]
            on[left[ok]] = ~((cost[won] - cn[ok] < 1e-12 * np.maximum(cost[won], 1e-300)) | (cn[ok] < 1e-12))
            x[won], r[won], cost[won], lam[won] = new[ok], rn[ok], cn[ok], lam[won] / 10
            lam[k[~ok]] *= 10
            left = left[~ok]
        going = going[on]
    return x, np.isfinite(x).all(1)


def _solved(a: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solutions of many systems; NaN where one is singular."""
    try:
        return np.linalg.solve(a, g[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        out = np.full_like(g, np.nan)
        for i in range(len(g)):
            with contextlib.suppress(np.linalg.LinAlgError):
                out[i] = np.linalg.solve(a[i], g[i])
        return out


def padded(groups: list[np.ndarray], fill: float) -> np.ndarray:
    """A row for each of ``groups``, as long as the longest."""
    out = np.full((len(groups), max(map(len, groups))), fill)
    for row, v in zip(out, groups, strict=True):
        row[: len(v)] = v
    return out


#: Points that fits of many at once hold in a call, at least one fit's.
POINTS = 1 << 13


def in_groups(rows: DataFrame, keys: list[str], run: Callable[[list[pd.DataFrame]], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` of lists of groups, each in order of t and seq: rows are dealt by ``keys`` and pass sorted, and a call has some
    POINTS of them, or the one group that is larger. Groups of like length come together, as they are padded."""

    def calls(held: list[list[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        found = sorted((pd.concat(g) if len(g) > 1 else g[0] for g in held), key=len)
        while found:
            some = max(1, POINTS // len(found[-1]))
            yield run(found[-some:])
            del found[-some:]

    def passing(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[pd.DataFrame]] = []  # groups, in the pieces they came in; the last may go on
        for pdf in parts:
            if len(pdf):
                k = pdf[keys]
                new = (k != k.shift()).any(axis=1).to_numpy()
                new[0] = not held or any(held[-1][-1][c].iloc[-1] != pdf[c].iloc[0] for c in keys)
                at = [*np.flatnonzero(new).tolist(), len(pdf)]
                if at[0]:
                    held[-1].append(pdf.iloc[: at[0]])
                held += [[pdf.iloc[i:j]] for i, j in itertools.pairwise(at)]
                if sum(len(x) for g in held[:-1] for x in g) >= 8 * POINTS:
                    yield from calls(held[:-1])
                    held = held[-1:]
        yield from calls(held)

    return dealt(rows, *keys).sortWithinPartitions(*keys, "t", "seq").mapInPandas(passing, schema)


def fit_fourier(t: np.ndarray, m: np.ndarray, e: np.ndarray, period: float, order: int = 8, epoch: float | None = None) -> dict:
    """Cosine series of ``order`` amplitudes and phases; the first term is a constant around the median.

    At a fixed period it is linear in a cos + b sin, so no starting values are needed. Epoch: time of the faintest fit.
    """
    p, m, e, t = fold(t, m, e, period, epoch)
    med = np.median(m)
    cols = [np.ones_like(p)] + [g(2 * np.pi * i * p) for i in range(1, order) for g in (np.cos, np.sin)]
    a = np.stack(cols, 1) / e[:, None]
    c, *_ = np.linalg.lstsq(a, (m - med) / e, rcond=None)
    fit = np.stack(cols, 1) @ c + med
    amps = [abs(c[0])] + [math.hypot(c[2 * i - 1], c[2 * i]) for i in range(1, order)]
    phases = [0.0 if c[0] >= 0 else math.pi] + [math.atan2(-c[2 * i], c[2 * i - 1]) for i in range(1, order)]
    chi, red = scores(m, fit, e, 2 * order)
    return {"params": amps + phases, "errs": None, "chisq": chi, "redchisq": red, "epoch": float(t[np.argmin(fit)]), "fit": fit, "phase": p, "t": t, "m": m}


def fit_spline(t: np.ndarray, m: np.ndarray, e: np.ndarray, period: float, knot_fraction: float = 0.01, most_knots: int = 30, epoch: float | None = None) -> dict:
    """Weighted least-squares cubic spline over phase, strictly increasing; evenly spaced inner knots."""
    p, m, e, t = fold(t, m, e, period, epoch)
    keep = np.concatenate([[True], np.diff(p) > 0])
    p, m, e, t = p[keep], m[keep], e[keep], t[keep]
    n = min(most_knots, int(math.floor(knot_fraction * len(p))))
    knots = np.linspace(p[0] + 0.01, p[-1] - 0.01, num=n)
    b = bspline_basis(p, knots, p[0], p[-1])
    c, *_ = np.linalg.lstsq(b / e[:, None], m / e, rcond=None)
    fit = b @ c
    chi, red = scores(m, fit, e, n + 1)
    return {"params": c.tolist(), "errs": None, "chisq": chi, "redchisq": red, "epoch": float(t[np.argmax(fit)]), "fit": fit, "phase": p, "t": t, "m": m}


def fit_savgol(t: np.ndarray, m: np.ndarray, e: np.ndarray, period: float, window: int | None = None, degree: int = 2, epoch: float | None = None) -> dict:
    """Savitzky-Golay over phase, around the circle; no degrees of freedom are defined for it."""
    p, m, e, t = fold(t, m, e, period, epoch)
    w = window or max(degree + 3, int(len(p) / 300))
    w += 1 - w % 2
    fit = savgol(m, w, degree, "wrap")
    return {"params": [float(w), float(degree)], "errs": None, "chisq": scores(m, fit, e, 0)[0], "redchisq": -99.0, "epoch": float(t[np.argmax(fit)]), "fit": fit, "phase": p, "t": t, "m": m}


def fit_legendre(t: np.ndarray, m: np.ndarray, e: np.ndarray, period: float, degree: int = 10, epoch: float | None = None) -> dict:
    """Legendre polynomials over phase, unweighted."""
    p, m, e, t = fold(t, m, e, period, epoch)
    x = 2 * (p - p[0]) / (p[-1] - p[0]) - 1
    c = np.polynomial.legendre.legfit(x, m, degree)
    fit = np.polynomial.legendre.legval(x, c)
    chi, red = scores(m, fit, e, degree + 2)
    return {"params": c.tolist(), "errs": None, "chisq": chi, "redchisq": red, "epoch": float(t[np.argmax(fit)]), "fit": fit, "phase": p, "t": t, "m": m}


def trapezoid(p: np.ndarray, zero: float, depth: float, duration: float, ingress: float) -> np.ndarray:
    """Trapezoid around phase 0, for fits."""
    d = np.minimum(p, 1 - p)
    half = duration / 2
    return zero - depth * np.clip((half - d) / np.maximum(ingress, 1e-9), 0.0, 1.0)


def eclipses(p: np.ndarray, zero: float, depth: float, duration: float, ratio: float, secondary: float) -> np.ndarray:
    """Two inverted Gaussians, for fits."""
    std, half, d = duration / 5, duration / 2, np.minimum(p, 1 - p)
    out = np.where(d <= half, zero - depth * np.exp(-d * d / (2 * std * std)), zero)
    d = p - secondary
    return np.where(np.abs(d) <= half, zero - depth * ratio * np.exp(-d * d / (2 * std * std)), out)


def _bounded(model: Callable, names: int, start: list[float], low: list[float], high: list[float], t: np.ndarray, m: np.ndarray, e: np.ndarray, period: float, epoch: float) -> dict:
    zero = float(np.median(m))
    at = lambda x: fold(t, m, e, period, x[0])

    def residual(x: np.ndarray) -> np.ndarray:
        ph = (t - x[0]) / period
        return (model(ph - np.floor(ph), zero, *x[1:]) - m) / e

    span = 0.05 * period
    got = least_squares(residual, np.array([epoch, *start]), np.array([epoch - span, *low]), np.array([epoch + span, *high]))
    if got is None:
        return {"params": None, "errs": None, "chisq": math.nan, "redchisq": math.nan, "epoch": epoch, "fit": np.full(len(m), math.nan), "phase": at([epoch])[0], "t": t, "m": m}
    x, err = got
    p, ms, es, ts = at(x)
    fit = model(p, zero, *x[1:])
    chi, red = scores(ms, fit, es, names)
    return {"params": [period, *x.tolist()], "errs": [0.0, *err.tolist()], "chisq": chi, "redchisq": red, "epoch": float(x[0]), "fit": fit, "phase": p, "t": ts, "m": ms}


def fit_trapezoid(t: np.ndarray, m: np.ndarray, e: np.ndarray, period: float, epoch: float | None = None, depth: float | None = None, duration: float = 0.1, ingress: float = 0.02) -> dict:
    """Trapezoid transit at a fixed period; the epoch starts at the spline fit's faintest point unless given."""
    epoch = fit_spline(t, m, e, period)["epoch"] if epoch is None else epoch
    deep = float(np.median(m) - np.percentile(m, 2)) if depth is None else depth
    side = max(abs(deep), 1e-6) * 5
    return _bounded(trapezoid, 5, [deep, duration, ingress], [-side, 0.005, 0.0005], [side, 0.5, 0.25], t, m, e, period, epoch)


def fit_eclipses(t: np.ndarray, m: np.ndarray, e: np.ndarray, period: float, epoch: float | None = None, depth: float | None = None, duration: float = 0.1, ratio: float = 0.5, secondary: float = 0.5) -> dict:
    """Double inverted Gaussian eclipses at a fixed period."""
    epoch = fit_spline(t, m, e, period)["epoch"] if epoch is None else epoch
    deep = float(np.median(m) - np.percentile(m, 2)) if depth is None else depth
    side = max(abs(deep), 1e-6) * 5
    return _bounded(eclipses, 6, [deep, duration, ratio, secondary], [-side, 0.005, 0.0, 0.2], [side, 0.5, 1.5, 0.8], t, m, e, period, epoch)


def bounded_many(shape: str, ts: list[np.ndarray], ms: list[np.ndarray], es: list[np.ndarray], period: np.ndarray, epoch: np.ndarray) -> list[tuple[float, float, np.ndarray] | None]:
    """(chi squared, reduced chi squared, fit less magnitudes in the order of ``ts``) of many fits by fit_trapezoid() or
    fit_eclipses(), with their starting values; None where one does not converge."""
    zero, deep = (np.array([f(m) for m in ms], float) for f in (np.median, lambda m: np.median(m) - np.percentile(m, 2)))
    side, span = np.maximum(np.abs(deep), 1e-6) * 5, 0.05 * period
    model, ends = {
        "trapezoid": (trapezoid, ((0.1, 0.005, 0.5), (0.02, 0.0005, 0.25))),
        "eclipses": (eclipses, ((0.1, 0.005, 0.5), (0.5, 0.0, 1.5), (0.5, 0.2, 0.8))),
    }[shape]
    table = lambda *columns: np.stack([np.broadcast_to(c, len(ts)) for c in columns], 1)
    start, low, high = (table(at, d, *[x[i] for x in ends]) for i, (at, d) in enumerate(((epoch, deep), (epoch - span, -side), (epoch + span, side))))
    t, m, e = padded(ts, 0.0), padded(ms, 0.0), padded(es, np.inf)

    def left(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        p = (t[at] - x[:, :1]) / period[at, None]
        return model(p - np.floor(p), zero[at, None], *[c[:, None] for c in x.T[1:]]) - m[at]

    x, ok = least_squares_many(lambda v, at: left(v, at) / e[at], start, low, high)
    out: list[tuple[float, float, np.ndarray] | None] = []
    for i, r in enumerate(left(np.where(ok[:, None], x, start), np.arange(len(ts)))):
        n, free = len(ts[i]), len(ends) + 3
        chi = float(np.sum((r[:n] / es[i]) ** 2))
        out.append((chi, chi / (n - free) if n > free else math.nan, r[:n]) if ok[i] else None)
    return out


MODELS: dict[str, Callable[..., dict]] = {"fourier": fit_fourier, "spline": fit_spline, "savgol": fit_savgol, "legendre": fit_legendre, "trapezoid": fit_trapezoid, "eclipses": fit_eclipses}


def iterative(fit: Callable[..., dict], t: np.ndarray, m: np.ndarray, e: np.ndarray, period: float, sigma: float = 4.0, rounds: int = 10, **options: object) -> dict:
    """Fits again and again without the points whose residual is ``sigma`` times 1.4826 MAD or more."""
    got = fit(t, m, e, period, **options)
    for _ in range(rounds):
        order = np.argsort(t, kind="stable")
        t, m, e = t[order], m[order], e[order]
        r = m - np.interp(((t - t.min()) / period) % 1.0, got["phase"], got["fit"], period=1.0)
        keep = np.abs(r - np.median(r)) < sigma * 1.4826 * np.median(np.abs(r - np.median(r)))
        if keep.all() or keep.sum() < 10:
            break
        t, m, e = t[keep], m[keep], e[keep]
        got = fit(t, m, e, period, **options)
    return got


def fit(lc: DataFrame, model: str, period: str | float = "period", least: int = 10, **options: object) -> DataFrame:
    """(objectid, model, params, errs, chisq, redchisq, epoch, n, residual_mad) of every object."""
    lc = lc.withColumn("_p", F.col(period) if isinstance(period, str) else F.lit(float(period)))
    kernel = MODELS[model]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "seq"])
        if len(pdf) < least:
            return pd.DataFrame(columns=[KEY, "model", "params", "errs", "chisq", "redchisq", "epoch", "n", "residual_mad"])
        t, m, e = (pdf[c].to_numpy(float) for c in ("t", "m", "e"))
        got = kernel(t, m, e, float(pdf["_p"].iloc[0]), **options)
        r = got["m"] - got["fit"]
        mad = float(np.median(np.abs(r - np.median(r)))) if np.isfinite(r).all() else math.nan
        return pd.DataFrame([{KEY: pdf[KEY].iloc[0], "model": model, "params": got["params"], "errs": got["errs"], "chisq": got["chisq"], "redchisq": got["redchisq"], "epoch": got["epoch"], "n": len(t), "residual_mad": mad}])

    kind = lc.schema[KEY].dataType.simpleString()
    return finite_filter(lc).select(KEY, "t", "m", "e", "seq", "_p").groupBy(KEY).applyInPandas(run, f"{KEY} {kind}, model string, params array<double>, errs array<double>, chisq double, redchisq double, epoch double, n long, residual_mad double")


def prewhiten(lc: DataFrame, period: float, order: int = 8) -> DataFrame:
    """The series without its Fourier fit at ``period``, around its median."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "seq"])
        t, m, e = (pdf[c].to_numpy(float) for c in ("t", "m", "e"))
        x = (t - t.min()) / period
        p = x - np.floor(x)
        got = fit_fourier(t, m, e, period, order)
        n = len(got["params"]) // 2
        series = np.median(m) + sum(a * np.cos(2 * np.pi * i * p + f) for i, (a, f) in enumerate(zip(got["params"][:n], got["params"][n:], strict=True)))
        return pdf.assign(m=m - series + np.median(m))

    return finite_filter(lc).select(KEY, "t", "m", "e", "seq").groupBy(KEY).applyInPandas(run, lc.select(KEY, "t", "m", "e", "seq").schema)
