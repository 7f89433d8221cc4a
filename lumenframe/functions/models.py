"""Model light curves as columns of phase or time, and scores of recovered signals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def phase(t: Column, period: Column | float, epoch: Column | float) -> Column:
    """Phase in [0, 1)."""
    x = (t - epoch) / period
    return x - F.floor(x)


def trapezoid_transit(ph: Column, zero: Column | float, depth: float, duration: float, ingress: float) -> Column:
    """A transit around phase 0 by its contacts; duration and ingress are in phase. Points on a contact stay at zero."""
    first, second, third, fourth = 1.0 - duration / 2, 1.0 - duration / 2 + ingress, duration / 2 - ingress, duration / 2
    slope = depth / ingress
    zero = F.lit(zero) if isinstance(zero, (int, float)) else zero
    return F.when((ph > first) & (ph < second), zero - slope * (ph - first)).when((ph > second) | (ph < third), zero - depth).when((ph > third) & (ph < fourth), zero - depth + slope * (ph - third)).otherwise(zero)


def gaussian(x: Column, amp: float, loc: float, std: float) -> Column:
    return amp * F.exp(-((x - loc) * (x - loc)) / (2.0 * std * std))


def inverted_gaussian_eclipses(ph: Column, zero: Column | float, depth: float, duration: float, depth_ratio: float, secondary: float) -> Column:
    """Two eclipses as Gaussians of a fifth of the duration; where they overlap the secondary wins."""
    zero = F.lit(zero) if isinstance(zero, (int, float)) else zero
    std, half = duration / 5.0, duration / 2.0
    return (
        F.when((ph >= secondary - half) & (ph <= secondary + half), zero + gaussian(ph, -depth * depth_ratio, secondary, std))
        .when((ph >= 0.0) & (ph <= half), zero + gaussian(ph, -depth, 0.0, std))
        .when((ph >= 1.0 - half) & (ph <= 1.0), zero + gaussian(ph, -depth, 1.0, std))
        .otherwise(zero)
    )


def fourier_series(ph: Column, zero: Column | float, amps: Sequence[float], phases: Sequence[float]) -> Column:
    """zero plus a cosine series whose first term has index 0, so it is constant."""
    zero = F.lit(zero) if isinstance(zero, (int, float)) else zero
    return sum((a * F.cos(2.0 * math.pi * i * ph + p) for i, (a, p) in enumerate(zip(amps, phases, strict=True))), zero)


def sine_series(ph: Column, zero: Column | float, amps: Sequence[float], phases: Sequence[float]) -> Column:
    zero = F.lit(zero) if isinstance(zero, (int, float)) else zero
    return sum((a * F.sin(2.0 * math.pi * i * ph + p) for i, (a, p) in enumerate(zip(amps, phases, strict=True))), zero)


def flare(t: Column, mag: Column, zero: Column, amplitude: float, peak: Column | float, rise: float, decay: float) -> Column:
    """Gaussian rise and exponential decay added to the magnitudes; at the very peak the level is zero's."""
    dt = t - peak
    return F.when(dt < 0, mag + amplitude * F.exp(-(dt * dt) / (2.0 * rise * rise))).when(dt > 0, mag + amplitude * F.exp(-dt / decay)).otherwise(zero)


def transit_duration_range(period: Column, low_radius: float, high_radius: float) -> tuple[Column, Column]:
    """Shortest and longest transit duration in phase for stellar radii in solar radii."""
    of = lambda r: 0.076 * r ** (2.0 / 3.0) * F.pow(period, F.lit(-2.0 / 3.0))
    return of(low_radius), of(high_radius)


def dip_snr(n_transit: Column, depth: Column, residual_std: Column) -> Column:
    return F.sqrt(n_transit) * F.try_divide(depth, residual_std)


def achievable_tmid_precision(snr: Column, ingress_min: float, duration_hr: float) -> Column:
    """Days: T / SNR * sqrt(theta / 2)."""
    theta = (ingress_min / 60.0) / duration_hr
    return F.try_divide(F.lit(duration_hr / 24.0 * math.sqrt(theta / 2.0)), snr)


def precision(tp: Column, fp: Column) -> Column:
    return F.try_divide(tp.cast("double"), tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return F.try_divide(tp.cast("double"), tp + fn)


def matthews(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    d = lambda c: c.cast("double")
    return F.try_divide(d(tp) * d(tn) - d(fp) * d(fn), F.sqrt((d(tp) + d(fp)) * (d(tp) + d(fn)) * (d(tn) + d(fp)) * (d(tn) + d(fn))))


#: Names of the ways in which a period can be found wrong, and the period found for a true period P.
ALIASES: list[tuple[str, str]] = [
    ("actual", "P"), ("twice", "2 * P"), ("half", "0.5 * P"),
    ("ratio_over_1plus", "P / (1.0 + P)"), ("ratio_over_1minus", "P / (1.0 - P)"), ("ratio_over_1plus_twice", "P / (1.0 + 2.0 * P)"), ("ratio_over_1minus_twice", "P / (1.0 - 2.0 * P)"),
    ("ratio_over_1plus_thrice", "P / (1.0 + 3.0 * P)"), ("ratio_over_1minus_thrice", "P / (1.0 - 3.0 * P)"), ("ratio_over_minus1", "P / (P - 1.0)"), ("ratio_over_twice_minus1", "P / (2.0 * P - 1.0)"),
]


def alias_type(found: Column, actual: Column, tolerance: float = 1e-3) -> Column:
    """The first alias within tolerance + 1e-5 of the expected period, else "other"."""
    cases = []
    for name, form in ALIASES:
        top, _, bottom = form.partition(" / ")
        p = {"P": actual, "2 * P": 2 * actual, "0.5 * P": 0.5 * actual}[top]
        if bottom:
            k = {"(1.0 + P)": 1 + actual, "(1.0 - P)": 1 - actual, "(1.0 + 2.0 * P)": 1 + 2 * actual, "(1.0 - 2.0 * P)": 1 - 2 * actual, "(1.0 + 3.0 * P)": 1 + 3 * actual, "(1.0 - 3.0 * P)": 1 - 3 * actual, "(P - 1.0)": actual - 1, "(2.0 * P - 1.0)": 2 * actual - 1}[bottom]
            p = F.try_divide(actual, k)
        cases.append(F.when(F.abs(found - p) <= tolerance + 1e-5 * F.abs(p), F.lit(name)))
    return F.coalesce(*cases, F.lit("other"))
