"""Iterated searches, transit least squares, mid-times and flares against planted signals and brute force; neighbours."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import flares, neighbours, periodograms, prewhitening, single_transits, tls, transit_fits

COLS = "objectid int, t double, m double, e double, seq int"


def frame(spark, series):
    return spark.createDataFrame([(k, float(t), float(m), float(e), i) for k, (ts, ms, es) in series.items() for i, (t, m, e) in enumerate(zip(ts, ms, es, strict=True))], COLS)


def times(seed, n=200, span=60.0):
    return np.sort(np.random.default_rng(seed).uniform(0, span, n))


# ------------------------------------------------------------------------------------------------------- prewhitening


@pytest.fixture(scope="module")
def two_signals():
    t = times(1, 300)
    r = np.random.default_rng(2)
    m = 12 + 0.5 * np.cos(2 * np.pi * t / 3.7) + 0.2 * np.sin(2 * np.pi * t / 1.31 + 0.4) + 0.05 * r.normal(size=len(t))
    return t, m, np.full(len(t), 0.05)


def test_signals_come_out_one_after_the_other(spark, two_signals):
    noise = times(3, 100)
    lc = frame(spark, {1: two_signals, 2: (noise, 10 + 0.01 * np.random.default_rng(4).normal(size=100), np.full(100, 0.01))})
    got = prewhitening.prewhiten_rounds(lc, (0.05, 0.00005, 20000), rounds=4, order=1, worst_fap=1e-6).orderBy("objectid", "round").collect()
    assert [r.objectid for r in got] == [1, 1]  # noise has no signal, and two are all that there are
    assert [r.period for r in got] == pytest.approx([3.7, 1.31], rel=2e-3) and [r.amplitude for r in got] == pytest.approx([0.5, 0.2], abs=0.02)
    assert got[0].rms_after == pytest.approx(got[1].rms_before) and got[1].rms_after < 0.08
    left = prewhitening.prewhitened(lc, (0.05, 0.00005, 20000), rounds=4, order=1, worst_fap=1e-6)
    by = {r.objectid: r.s for r in left.groupBy("objectid").agg(F.stddev_pop("m").alias("s")).collect()}
    assert by[1] == pytest.approx(got[1].rms_after) and by[2] == pytest.approx(0.01, rel=0.3)


def test_rounds_are_those_of_plain_least_squares(two_signals):
    t, m, e = two_signals
    freqs = 0.05 + 0.002 * np.arange(500)
    got, left = prewhitening.rounds_of(t, m, e, freqs, 3, 3, None)

    def lsq(y, f, order):
        a = np.stack([np.ones_like(t)] + [g(2 * np.pi * i * f * t) for i in range(1, order) for g in (np.cos, np.sin)], 1)
        return a @ np.linalg.lstsq(a, y, rcond=None)[0]

    y = m.copy()
    for row in got:
        falls = [np.sum((y - y.mean()) ** 2) - np.sum((y - lsq(y, f, 2)) ** 2) for f in freqs]
        f = freqs[int(np.argmax(falls))]
        assert row["period"] == pytest.approx(1 / f)
        y = y - lsq(y, f, 3) + np.median(y)
    assert left == pytest.approx(y, abs=1e-8)


# -------------------------------------------------------------------------------------------- transit least squares


def planted(seed, period, t0, rp=0.1, n=1500, noise=5e-4):
    t = times(seed, n, 40.0)
    y = transit_fits.transit_model(t, t0, period, rp, 9.0, 0.2, (0.3, 0.2)) + noise * np.random.default_rng(seed + 1).normal(size=n)
    return t, y, np.full(n, noise)


def test_planted_transits_are_found(spark):
    lc = frame(spark, {1: planted(5, 3.21, 1.1), 2: planted(7, 2.4, 0.3, 0.06)})
    grid = (0.2, 0.0004, 800)
    found = periodograms.find_periods(lc, ["tls", "bls"], {"tls": grid, "bls": grid}, best=1, sigma=None).collect()
    assert {(r.objectid, r.method): round(r.period, 1) for r in found} == {(k, m): p for k, p in ((1, 3.2), (2, 2.4)) for m in ("tls", "bls")}
    scores = tls.tls(lc, grid)
    best = {r.objectid: r for r in scores.orderBy("power").collect()}
    assert best[1].depth == pytest.approx(-0.011, rel=0.25) and best[1].duration == pytest.approx(1.1 * 2 / 9.0 / (2 * math.pi), rel=0.35)
    first = times(5, 1500, 40.0)[0]
    assert (best[1].middle / best[1].freq + first - 1.1) % (1 / best[1].freq) == pytest.approx(0, abs=0.1) or (1.1 - best[1].middle / best[1].freq - first) % (1 / best[1].freq) == pytest.approx(0, abs=0.1)
    assert all(r.sde > 6 for r in tls.detection_efficiency(scores).collect())


def test_every_shape_at_every_bin_by_brute_force():
    t, m, e = planted(9, 2.0, 0.4, n=150)
    e = e * np.random.default_rng(1).uniform(0.5, 2, len(e))
    bins, freqs = 25, np.array([0.31, 0.5, 0.77])
    got = tls.tls_kernel(bins, 0.08, 0.24)(t - t[0], m, e, freqs)
    w = 1 / e**2 / np.sum(1 / e**2)
    for i, f in enumerate(freqs):
        at = np.minimum(((t - t[0]) * f % 1 * bins).astype(int), bins - 1)
        best = (-1.0,)
        for n in tls.widths(bins, 0.08, 0.24):
            s = tls.shape(n)
            for j in range(bins):
                x = np.zeros(bins)
                x[(j + np.arange(n)) % bins] = s
                a = np.stack([np.ones_like(t), x[at]], 1)
                if np.ptp(a[:, 1]) == 0:
                    continue
                c = np.linalg.lstsq(a * np.sqrt(w)[:, None], m * np.sqrt(w), rcond=None)[0]
                level = np.sum(w * m)
                gain = np.sum(w * (m - level) ** 2) - np.sum(w * (m - a @ c) ** 2)
                if gain > best[0] + 1e-15:
                    best = (gain, c[1], n / bins, (j + n / 2) / bins % 1)
        assert (got["power"][i] ** 2, got["depth"][i], got["duration"][i], got["middle"][i]) == pytest.approx(best, rel=1e-6)


# ------------------------------------------------------------------------------------------------------- mid-times


def test_midtimes_and_their_line(spark):
    period, t0, late = 2.5, 1.0, {2: 0.02, 5: -0.03}
    t = np.arange(0.0, 25.0, 0.02)
    number = np.round((t - t0) / period).astype(int)
    y = np.ones_like(t)
    for k in np.unique(number):
        here = number == k
        y[here] = transit_fits.transit_model(t[here], t0 + k * period + late.get(k, 0.0), period, 0.12, 7.0, 0.1, (0.3, 0.2)) * (1.0 + 0.001 * (t[here] - t0 - k * period))
    y += 2e-4 * np.random.default_rng(3).normal(size=len(t))
    y[number == 7] = np.nan  # a transit without points
    lc = frame(spark, {1: (t, y, np.full(len(t), 2e-4)), 2: (t[:60], y[:60], np.full(60, 2e-4))})
    eph = spark.createDataFrame([(1, period, t0, 0.13, 0.12, 7.0, 0.1), (2, period, t0, 0.13, 0.12, 7.0, 0.1), (3, 0.0, t0, 0.13, 0.12, 7.0, 0.1)], "objectid int, period double, t0 double, duration double, rp double, a double, b double")
    found = single_transits.midtimes(lc, eph)
    got = {(r.objectid, r.transit): r for r in found.collect()}
    assert {k for o, k in got if o == 1} == {0, 1, 2, 3, 4, 5, 6, 8, 9} and {k for o, k in got if o == 2} == {0}
    for (o, k), r in got.items():
        assert r.tmid == pytest.approx(t0 + k * period + late.get(k, 0.0), abs=max(6 * r.err, 2e-3)) and 0 < r.err < 5e-3
        assert r.before > 0 and r.after > 0 and r.n_in >= 3 and r.slope == pytest.approx(0.001, abs=2e-3)
    oc = {r.transit: r for r in single_transits.observed_minus_calculated(found.where("objectid = 1")).collect()}
    assert oc[5].oc < -0.02 and oc[2].oc > 0.012 and oc[1].period == pytest.approx(period, abs=5e-3)
    assert single_transits.observed_minus_calculated(found.where("objectid = 2")).first().oc is None


# ----------------------------------------------------------------------------------------------------------- flares


def test_flares_are_fitted(spark):
    t = np.arange(0.0, 10.0, 0.02)
    m = flares.flare_curve(t, -0.8, 3.003, 0.03, 0.25, 11.0) + flares.flare_curve(t, -0.3, 7.5, 0.05, 0.1, 0.0) + 0.003 * np.random.default_rng(6).normal(size=len(t))
    lc = frame(spark, {1: (t, m, np.full(len(t), 0.003))})
    windows = spark.createDataFrame([(1, 1, 2.96, 3.3), (1, 2, 7.44, 7.6), (1, 3, 50.0, 51.0), (2, 1, 1.0, 2.0)], "objectid int, flare int, start double, end double")
    got = {r.flare: r for r in flares.fit_flares(lc, windows, 0.5, 1.0).collect()}
    assert set(got) == {1, 2}
    for k, (a, p, rise, decay) in {1: (-0.8, 3.003, 0.03, 0.25), 2: (-0.3, 7.5, 0.05, 0.1)}.items():
        r = got[k]
        assert (r.amplitude, r.peak, r.rise, r.decay, r.level) == pytest.approx((a, p, rise, decay, 11.0), rel=0.1, abs=0.01) and 0.6 < r.redchisq < 1.5 and r.amplitude_err < 0.02


# -------------------------------------------------------------------------------------------------------- neighbours


def test_neighbours_series_and_signals(spark):
    t = times(11, 80)
    signal = lambda a: a * np.sin(2 * np.pi * t / 4.0)
    lc = frame(spark, {1: (t, 10 + signal(1.0), np.full(80, 0.01)), 2: (t, 12 + signal(0.5), np.full(80, 0.01)), 3: (t[:40], 9 + signal(0.1)[:40], np.full(40, 0.01))})
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (4, 1)], "objectid int, neighbor int")
    assert {(r.objectid, r.neighbor, r["count"]) for r in neighbours.curves(lc, pairs).groupBy("objectid", "neighbor").count().collect()} == {(1, 2, 80), (2, 1, 80), (4, 1, 80)}
    periods = spark.createDataFrame([(1, "gls", 4.0, 0.0), (2, "gls", 4.0, None)], "objectid int, method string, period double, epoch double")
    folded = neighbours.curves(lc, pairs, periods)
    own = lc.where("objectid = 1").select("objectid", F.lit("gls").alias("method"), "m", F.expr("t / 4 - floor(t / 4)").alias("phase"))
    got = {(r.objectid, r.neighbor): r for r in neighbours.blends(folded, own, bins=8).collect()}
    assert got[1, 2].amplitude == pytest.approx(1.0, abs=0.15) and got[1, 2].correlation > 0.99 and got[2, 1].correlation is None
    cat = spark.createDataFrame([(1, 10.0, 9.0, float("nan")), (2, 12.5, 11.0, 8.0)], "objectid int, jmag double, kmag double, vmag double")
    d = {(r.objectid, r.neighbor): r for r in neighbours.differences(pairs, cat, ["jmag", "kmag", "vmag"]).collect()}
    assert (d[1, 2].d_jmag, d[1, 2].d_jkcolor, d[1, 2].d_vmag, d[1, 2].d_vkcolor, d[1, 3].d_jmag) == (-2.5, -0.5, None, None, None)
