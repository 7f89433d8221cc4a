"""Transits of a limb-darkened star: model, priors, least squares and Metropolis sampling, many objects in a kernel call."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .fits import in_groups, least_squares_many, padded
from .series import KEY, finite_filter

#: Nodes of the integral over the covered part of the disk.
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)
_SINES, _COSINES = np.sin(np.pi / 2 * _NODES), _WEIGHTS * np.pi / 2 * np.cos(np.pi / 2 * _NODES)

#: Parameters of the model in order; those of the line follow where it is fitted.
NAMES = ("t0", "rp", "a", "b")


def separation(t: np.ndarray, t0: float, period: float, a: float, b: float, ecc: float = 0.0, omega: float = 90.0) -> np.ndarray:
    """Distance of the planet from the star's centre on the sky, in stellar radii; infinite where it is behind the star.

    ``a`` is the semi-major axis in stellar radii, ``b`` the impact parameter, ``omega`` the argument of periastron in degrees.
    """
    w = math.radians(omega)
    true0 = math.pi / 2 - w
    e0 = 2 * math.atan(math.sqrt((1 - ecc) / (1 + ecc)) * math.tan(true0 / 2))
    mean = 2 * np.pi * (t - t0) / period + (e0 - ecc * math.sin(e0))
    e = mean.copy()
    for _ in range(30):
        step = (e - ecc * np.sin(e) - mean) / (1 - ecc * np.cos(e))
        e -= step
        if np.max(np.abs(step), initial=0.0) < 1e-12:
            break
    true = 2 * np.arctan2(math.sqrt(1 + ecc) * np.sin(e / 2), math.sqrt(1 - ecc) * np.cos(e / 2))
    r = a * (1 - ecc * np.cos(e))
    at_transit = a * (1 - ecc * ecc) / (1 + ecc * math.sin(w))
    cos_i = np.minimum(1.0, b / at_transit)
    s = np.sin(w + true)
    z = r * np.sqrt(np.maximum(0.0, 1 - s * s * (1 - cos_i * cos_i)))
    return np.where(s > 0, z, np.inf)


def flux(z: np.ndarray, k: float, u: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
    """Flux of a star with quadratic limb darkening ``u`` with a disk of radius ``k`` at distances ``z`` in front of it.

    The covered light is an integral over rings: a ring's share that is covered has a closed form. Substituting the ring's
    radius by a sine takes away the square roots at both ends. ``k`` may be an array that goes with ``z``.
    """
    z = np.asarray(z, float)
    k = np.broadcast_to(np.abs(k), z.shape)
    out = np.ones_like(z)
    near = (z < 1 + k) & (k > 0)
    if not near.any():
        return out
    d, k = np.maximum(z[near], 1e-12), k[near]
    covered = np.zeros_like(d)
    norm = math.pi * (1 - u[0] / 3 - u[1] / 6)

    def light(r: np.ndarray) -> np.ndarray:
        mu = np.sqrt(np.maximum(0.0, 1 - r * r))
        return 1 - u[0] * (1 - mu) - u[1] * (1 - mu) ** 2

    def rings(low: np.ndarray, high: np.ndarray, share: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        half, mid = (high - low)[:, None] / 2, (high + low)[:, None] / 2
        r = mid + half * _SINES
        return np.sum(_COSINES * half * 2 * r * light(r) * share(r), 1)

    whole = np.maximum(0.0, k - d)  # rings that lie under the disk as a whole
    under = whole > 0
    if under.any():
        covered[under] = rings(np.zeros(under.sum()), np.minimum(1.0, whole[under]), lambda r: np.full_like(r, np.pi))
    low, high = np.minimum(1.0, np.abs(d - k)), np.minimum(1.0, d + k)
    covered += rings(low, np.maximum(low, high), lambda r: np.arccos(np.clip((r * r + (d * d - k * k)[:, None]) / np.maximum(2 * r * d[:, None], 1e-300), -1.0, 1.0)))
    out[near] = 1 - covered / norm
    return out


def transit_model(t: np.ndarray, t0: float, period: float, rp: float, a: float, b: float, u: tuple[float, float] = (0.0, 0.0), ecc: float = 0.0, omega: float = 90.0, exposure: float = 0.0, samples: int = 7) -> np.ndarray:
    """Relative flux at times ``t``; averaged over ``samples`` moments of an exposure (days) if there is one."""
    if exposure > 0 and samples > 1:
        moments = ((np.arange(samples) + 0.5) / samples - 0.5) * exposure
        return np.mean([transit_model(t + x, t0, period, rp, a, b, u, ecc, omega) for x in moments], 0)
    return flux(separation(t, t0, period, a, b, ecc, omega), rp, u)


def log_prior(theta: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """Flat within bounds, minus infinity beyond."""
    return 0.0 if np.all((theta >= low) & (theta <= high)) else -math.inf


def log_likelihood(theta: np.ndarray, model: Callable[[np.ndarray], np.ndarray], y: np.ndarray, e: np.ndarray) -> float:
    """Gaussian, without its constant term."""
    return -0.5 * float(np.sum(((y - model(theta)) / e) ** 2))


def log_posterior(theta: np.ndarray, model: Callable[[np.ndarray], np.ndarray], y: np.ndarray, e: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    prior = log_prior(theta, low, high)
    return prior + log_likelihood(theta, model, y, e) if math.isfinite(prior) else -math.inf


def covariances(residuals: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of the parameters at each row of ``x``, from the model's slopes; a parameter that changes nothing has no variance."""
    j = []
    for i in range(x.shape[1]):
        d = np.zeros_like(x)
        d[:, i] = 1e-4 * np.maximum(np.abs(x[:, i]), 1e-2) if i else 1e-5
        j.append((residuals(x + d, at) - residuals(x - d, at)) / (2 * d[:, i, None]))
    out = []
    for s in np.stack(j, 2):
        size = np.sqrt(np.maximum((s * s).sum(0), 1e-300))
        inverse = np.linalg.pinv((s / size).T @ (s / size), rcond=1e-8)
        out.append(np.where((s != 0).any(0)[:, None] & (s != 0).any(0)[None, :], inverse / np.outer(size, size), 0.0))
    return out


def metropolis(posterior: Callable[[np.ndarray], float], start: np.ndarray, cov: np.ndarray, steps: int, seed: int) -> tuple[np.ndarray, float]:
    """(chain without its first half, share of accepted steps): a random walk whose steps follow ``cov``."""
    rng, x = np.random.default_rng(seed), np.array(start, float)
    values, vectors = np.linalg.eigh(cov)
    root = vectors * np.sqrt(np.maximum(values, 0.0)) * (2.0 / math.sqrt(len(x)))
    p, chain, taken = posterior(x), np.empty((steps, len(x))), 0
    for i in range(steps):
        new = x + root @ rng.normal(0.0, 1.0, len(x))
        q = posterior(new)
        if q >= p or rng.random() < math.exp(q - p):
            x, p, taken = new, q, taken + 1
        chain[i] = x
    return chain[steps // 2 :], taken / max(1, steps)


def fit_mandel_agol(t: np.ndarray, y: np.ndarray, e: np.ndarray, period: float, t0: float, rp: float = 0.1, a: float = 8.0, b: float = 0.3, u: tuple[float, float] = (0.3, 0.2), line: bool = False, steps: int = 0, seed: int = 1, exposure: float = 0.0, starts: int = 6) -> dict:
    """Transit fit at a fixed period, of flux around one: the best of ``starts`` least-squares fits and, with ``steps``, a chain.

    Free are t0, rp, a and b and, with ``line``, the slope and level of a line that the flux is multiplied by. Returns
    params, errs (of the curvature, or the chain's deviation), chisq, redchisq, medians of the chain and accepted share.
    """
    options = {"rp": rp, "a": a, "b": b, "u": u, "line": line, "steps": steps, "seed": seed, "exposure": exposure, "starts": starts}
    return fit_many([t], [y], [e], np.array([period]), np.array([t0]), **options)[0]


def metropolis_many(posterior: Callable[[np.ndarray], np.ndarray], start: np.ndarray, cov: np.ndarray, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """metropolis() of many chains at once, a row each; every chain draws as it would alone."""
    rngs, x = [np.random.default_rng(seed) for _ in start], np.array(start, float)
    values, vectors = np.linalg.eigh(cov)
    root = vectors * np.sqrt(np.maximum(values, 0.0))[:, None, :] * (2.0 / math.sqrt(x.shape[1]))
    p, chain, taken = posterior(x), np.empty((len(x), steps, x.shape[1])), np.zeros(len(x))
    for i in range(steps):
        new = x + (root @ np.stack([rng.normal(0.0, 1.0, x.shape[1]) for rng in rngs])[:, :, None])[:, :, 0]
        q = posterior(new)
        ok = np.array([b >= a or rng.random() < math.exp(b - a) for a, b, rng in zip(p.tolist(), q.tolist(), rngs, strict=True)])
        x[ok], p[ok], taken = new[ok], q[ok], taken + ok
        chain[:, i] = x
    return chain[:, steps // 2 :], taken / max(1, steps)


def fit_many(ts: list[np.ndarray], ys: list[np.ndarray], es: list[np.ndarray], period: np.ndarray, t0: np.ndarray, rp: float = 0.1, a: float = 8.0, b: float = 0.3, u: tuple[float, float] = (0.3, 0.2), line: bool = False, steps: int = 0, seed: int = 1, exposure: float = 0.0, starts: int = 6) -> list[dict]:
    """fit_mandel_agol() of many objects at once. Shorter series are filled up with points behind the star that weigh nothing."""
    count, size = len(ts), np.array([len(t) for t in ts])
    t, y, e = padded(ts, np.nan), padded(ys, 1.0), padded(es, np.inf)
    t = np.where(np.isnan(t), (t0 + period / 2)[:, None], t)
    ends = [[(t0 - 0.1 * period, t0 + 0.1 * period), (1e-4, 0.9), (1.05, 300.0), (0.0, 1.0), (-0.5, 0.5), (0.5, 1.5)][i] for i in range(6 if line else 4)]
    table = lambda *columns: np.stack([np.broadcast_to(np.asarray(c, float), count) for c in columns], 1)
    low, high = table(*[x for x, _ in ends]), table(*[x for _, x in ends])
    start = np.clip(table(t0, rp, a, b, *([0.0, 1.0] if line else [])), low, high)
    slopes = table(1e-4 * period, 1e-4, 1e-2, 1e-2, 1e-5, 1e-5)[:, : start.shape[1]]

    def residuals(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        v, when = [c[:, None] for c in x.T], t[at]
        m = transit_model(when, v[0], period[at, None], v[1], v[2], v[3], u, exposure=exposure)
        return (m * ((v[5] + v[4] * (when - t0[at, None])) if line else 1.0) - y[at]) / e[at]

    chi = lambda x: np.sum(residuals(x, every) ** 2, 1)
    every, x, best = np.arange(count), np.full_like(start, np.nan), np.full(count, np.inf)
    for f, at in [(f, at) for f in (1.0, 0.6, 1.6) for at in (b, 0.7)][:starts]:
        begin = start.copy()
        begin[:, 2], begin[:, 3] = start[:, 2] * f, at
        got, ok = least_squares_many(residuals, np.clip(begin, low, high), low, high, 100, slopes)
        c = np.where(ok, chi(np.where(ok[:, None], got, start)), np.inf)
        new = ok & (np.isnan(x[:, 0]) | (c < best))
        x[new], best[new] = got[new], c[new]
    found = np.flatnonzero(~np.isnan(x[:, 0]))
    out = [{"params": None, "errs": None, "chisq": math.nan, "redchisq": math.nan, "medians": None, "accepted": None} for _ in range(count)]
    if not len(found):
        return out
    x = x[found]
    cov = np.stack(covariances(residuals, x, found))
    for i, k in enumerate(found.tolist()):
        c = float(best[k])
        out[k] |= {"params": x[i].tolist(), "errs": np.sqrt(np.diag(cov[i])).tolist(), "chisq": c, "redchisq": c / (size[k] - x.shape[1]) if size[k] > x.shape[1] else math.nan}
    if steps:

        def posterior(v: np.ndarray) -> np.ndarray:
            inside = ((v >= low[found]) & (v <= high[found])).all(1)
            p = np.full(len(v), -math.inf)
            p[inside] = -0.5 * np.sum(residuals(v[inside], found[inside]) ** 2, 1)
            return p

        chain, share = metropolis_many(posterior, x, cov, steps, seed)
        for i, k in enumerate(found.tolist()):
            out[k] |= {"medians": np.median(chain[i], 0).tolist(), "errs": chain[i].std(0).tolist(), "accepted": float(share[i])}
    return out


def fit_transits(lc: DataFrame, ephemeris: DataFrame, least: int = 20, **options: object) -> DataFrame:
    """(objectid, params, errs, chisq, redchisq, medians, accepted, n) of objects with an ``ephemeris`` (objectid, period, t0).

    ``options`` go to fit_mandel_agol(). An object's points meet in one task; objects with fewer points than ``least`` are left
    out.
    """

    cols = [KEY, "params", "errs", "chisq", "redchisq", "medians", "accepted", "n"]

    def run(groups: list[pd.DataFrame]) -> pd.DataFrame:
        groups = [p for p in groups if len(p) >= least]
        if not groups:
            return pd.DataFrame(columns=cols)
        series = ([p[c].to_numpy(float) for p in groups] for c in ("t", "m", "e"))
        first = (np.array([float(p[c].iloc[0]) for p in groups]) for c in ("period", "t0"))
        return pd.DataFrame([{KEY: p[KEY].iloc[0], **got, "n": len(p)} for p, got in zip(groups, fit_many(*series, *first, **options), strict=True)])[cols]

    kind = lc.schema[KEY].dataType.simpleString()
    rows = finite_filter(lc).select(KEY, "t", "m", "e", "seq").join(ephemeris.select(KEY, "period", "t0"), KEY)
    return in_groups(rows, [KEY], run, f"{KEY} {kind}, params array<double>, errs array<double>, chisq double, redchisq double, medians array<double>, accepted double, n long")


def contacts(t0: float, period: float, a: float, rp: float, b: float, t_min: float, t_max: float, widen: float = 1.05) -> list[tuple[float, float, float]]:
    """(middle, start, end) of the transits between two times, by the geometric duration, widened a little."""
    inside = ((1 + rp) ** 2 - b * b) / max(a * a - b * b, 1e-12)
    half = widen * period / math.pi * math.asin(min(1.0, math.sqrt(max(0.0, inside)))) / 2
    return [(t0 + k * period, t0 + k * period - half, t0 + k * period + half) for k in range(math.ceil((t_min - t0) / period), math.floor((t_max - t0) / period) + 1)]
