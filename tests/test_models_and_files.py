"""Transit models and fits, features of periods, centroids, light travel time, files of every format, external catalogs."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import times
from lumenframe.operators import periodic, periodograms, transit_fits, trends
from lumenframe.sources import readers, writers

COLS = "objectid int, t double, m double, e double, seq long"


def disk_flux(z, k, u, n=400_001):
    """Covered light by a sum over thin rings."""
    r = (np.arange(n) + 0.5) / n
    mu = np.sqrt(1 - r * r)
    light = 1 - u[0] * (1 - mu) - u[1] * (1 - mu) ** 2
    share = np.arccos(np.clip((r * r + z * z - k * k) / (2 * r * z), -1, 1)) / math.pi
    return 1 - np.sum(light * r * share) / np.sum(light * r)


@pytest.mark.parametrize("z", [1e-6, 0.05, 0.3, 0.89, 0.9, 0.97, 1.0, 1.05, 1.0999])
@pytest.mark.parametrize("u", [(0.0, 0.0), (0.4, 0.25)])
def test_flux_of_a_darkened_star(z, u):
    assert transit_fits.flux(np.array([z]), 0.1, u)[0] == pytest.approx(disk_flux(z, 0.1, u), abs=2e-6)


def test_flux_beyond_and_behind():
    assert transit_fits.flux(np.array([1.1, 5.0, np.inf]), 0.1).tolist() == [1.0, 1.0, 1.0]
    t = np.array([0.0, 1.5, 3.0])
    assert transit_fits.transit_model(t, 0.0, 3.0, 0.1, 8.0, 0.0) == pytest.approx([0.99, 1.0, 0.99])
    z = transit_fits.separation(np.array([0.0]), 0.0, 3.0, 8.0, 0.3, ecc=0.3, omega=40.0)
    assert z[0] == pytest.approx(0.3, abs=1e-9)
    smooth = transit_fits.transit_model(np.array([0.0]), 0.0, 3.0, 0.1, 8.0, 0.0, exposure=0.5)
    assert 0.99 < smooth[0] < 1.0


def test_fit_finds_the_transit(spark):
    r = np.random.default_rng(2)
    t = np.sort(r.uniform(0, 9, 1500))
    y = transit_fits.transit_model(t, 1.0, 3.0, 0.1, 8.0, 0.3, (0.3, 0.2)) * (1.0 + 1e-3 * (t - 1.0)) + r.normal(0, 3e-4, 1500)
    got = transit_fits.fit_mandel_agol(t, y, np.full(1500, 3e-4), 3.0, 1.01, 0.08, 7.0, 0.2, line=True, steps=800)
    assert got["params"][0] == pytest.approx(1.0, abs=0.003) and got["params"][1] == pytest.approx(0.1, rel=0.05) and got["redchisq"] == pytest.approx(1.0, abs=0.15)
    assert 0.05 < got["accepted"] < 0.9 and all(e > 0 for e in got["errs"])
    lc = spark.createDataFrame([(1, float(a), float(b), 3e-4, i) for i, (a, b) in enumerate(zip(t, y, strict=True))] + [(2, 1.0, 1.0, 0.1, 0)], COLS)
    rows = transit_fits.fit_transits(lc, spark.createDataFrame([(1, 3.0, 1.01), (2, 3.0, 1.0)], "objectid int, period double, t0 double"), line=True).collect()
    assert [(x.objectid, x.n) for x in rows] == [(1, 1500)]


def test_posterior_and_contacts():
    low, high = np.array([0.0]), np.array([1.0])
    model = lambda x: np.full(3, x[0])
    y, e = np.array([0.5, 0.6, 0.4]), np.full(3, 0.1)
    assert transit_fits.log_posterior(np.array([2.0]), model, y, e, low, high) == -math.inf
    assert transit_fits.log_posterior(np.array([0.5]), model, y, e, low, high) == pytest.approx(-1.0)
    chain, _ = transit_fits.metropolis(lambda x: transit_fits.log_posterior(x, model, y, e, low, high), np.array([0.5]), np.array([[0.1**2 / 3]]), 8000, 3)
    assert chain.mean() == pytest.approx(0.5, abs=0.01) and chain.std() == pytest.approx(0.1 / math.sqrt(3), rel=0.15)
    c = transit_fits.contacts(1.0, 3.0, 8.0, 0.1, 0.3, 0.0, 9.0, widen=1.0)
    assert [x[0] for x in c] == [1.0, 4.0, 7.0]
    z = transit_fits.separation(np.array([c[0][1], c[0][2]]), 1.0, 3.0, 8.0, 0.3)
    assert z == pytest.approx([1.1, 1.1], abs=0.01)


def test_centroids_without_their_drift(spark):
    t = np.concatenate([np.linspace(0, 20, 400), np.linspace(25, 45, 400)])
    rows = [(1, float(a), i, float(0.01 * a + 1e-4 * a * a), float(np.sin(a / 9)), 0 if i % 50 else 1) for i, a in enumerate(t)]
    got = trends.detrend_centroids(spark.createDataFrame(rows, "objectid int, t double, seq long, x double, y double, quality int"), 0.5).collect()
    assert max(abs(r.dx) for r in got) < 1e-3 and max(abs(r.dy) for r in got) < 0.02
    assert all(1.0 < r.t < 19.5 or 25.5 < r.t < 44.0 for r in got) and all(r.seq % 50 for r in got)
    assert [trends.centroid_degree(n) for n in (10, 100, 400, 2000, 9000)] == [4, 4, 5, 12, 15]


def test_light_travel_time(spark):
    d = spark.createDataFrame([(2460310.5 + k, 0.0, 90.0) for k in range(0, 365, 5)] + [(2460389.0, 0.0, 0.0), (2460389.0, 180.0, 0.0)], "jd double, ra double, decl double")
    s = [x[0] for x in d.select(((times.jd_corr(F.col("jd"), F.col("ra"), F.col("decl")) - F.col("jd")) * 86400).alias("s")).collect()]
    assert max(map(abs, s[:-2])) < 203  # the celestial pole: sin of the tilt times 499 seconds
    assert s[-2] == pytest.approx(-499, abs=12) and s[-1] == pytest.approx(499, abs=12)  # at the March equinox the Sun is at right ascension 0


def test_peaks_against_the_sampling(spark):
    peaks = spark.createDataFrame([(1, "gls", 1, 2.0, 0.8), (1, "gls", 2, 0.5, 0.2), (1, "pdm", 1, 2.00001, 0.3), (1, "pdm", 2, 1.0027, 0.9)], "objectid int, method string, rank int, period double, score double")
    scores = spark.createDataFrame([(1, "gls", x) for x in (0.0, 0.2, 0.8)] + [(1, "pdm", x) for x in (0.3, 0.9, 1.1)], "objectid int, method string, score double")
    window = spark.createDataFrame([(1, 0.5, 0.1), (1, 2.0, 1.0), (1, 1 / 1.0027, 0.5), (1, 3.0, 0.0)], "objectid int, freq double, power double")
    r = {(x.method, x["rank"]): x for x in periodic.sampling_ratios(peaks, scores, window).collect()}
    assert r["gls", 1].ratio == pytest.approx(10.0) and r["gls", 2].ratio == pytest.approx(0.25) and r["pdm", 1].ratio == pytest.approx((0.7 / 0.8) / 0.1) and r["pdm", 2].ratio == pytest.approx((0.1 / 0.8) / 0.5)
    assert r["gls", 2].sidereal and not r["gls", 2].near_sidereal and r["pdm", 2].near_sidereal and not r["gls", 1].sidereal
    f = periodic.periodogram_features(peaks, scores, window).first()
    assert (f.n_abovesampling, f.n_sidereal, f.n_near_sidereal, f.n_pairs, f.n_close_pairs) == (2, 2, 1, 6, 1)


def test_features_of_fits(spark):
    r = np.random.default_rng(5)
    t = np.sort(r.uniform(0, 30, 300))
    m = 10 + 0.3 * np.sin(2 * np.pi * t / 2.5) + r.normal(0, 0.01, 300)
    lc = spark.createDataFrame([(1, float(a), float(b), 0.01, i) for i, (a, b) in enumerate(zip(t, m, strict=True))] + [(2, 0.0, 1.0, 0.1, 0)], COLS)
    got = periodic.fit_features(lc, spark.createDataFrame([(1, 2.5), (2, 1.0)], "objectid int, period double")).collect()
    assert [x.objectid for x in got] == [1]
    x = got[0]
    assert x.fourier_redchisq == pytest.approx(1.0, abs=0.3) and x.fourier_residual_mad_over_lcmad < 0.1 < x.planet_residual_mad_over_lcmad


@pytest.mark.parametrize("fmt", sorted(writers.WRITERS))
@pytest.mark.parametrize("pack", ["", ".gz", ".bz2"])
def test_files_come_back(spark, tmp_path, fmt, pack):
    lc = spark.createDataFrame([(7, 2.5, 9.25, 0.125, 1), (7, 1.5, -9.5, 0.25, 2), (8, 1.0, 3.0, 0.5, 3)], COLS)
    writers.store(writers.encode(lc, fmt, pack=pack), f"file://{tmp_path}/files")
    found = readers.files(spark, f"file://{tmp_path}/files", "*")
    got = sorted((int(r.objectid), r.t, r.m, r.e) for r in readers.parsed(found, fmt).collect())
    assert got == [(7, 1.5, -9.5, 0.25), (7, 2.5, 9.25, 0.125), (8, 1.0, 3.0, 0.5)]


def test_an_external_catalog(spark, tmp_path):
    text = '# {"colsep": "|", "columns": [{"key": "id", "name": "id", "dtype": "i8", "unit": ""},\n# {"key": "n", "name": "n", "dtype": "U9", "unit": ""}, {"key": "v", "name": "v", "dtype": "f8", "unit": "mag"}]}\n1|a b|2.5\n\n2|c|\n'
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(text.encode()))
    got = readers.read_catalog(spark, f"file://{tmp_path}/c.csv.gz", ["id", "v", "n", "missing"])
    assert got.dtypes == [("id", "bigint"), ("v", "double"), ("n", "string")]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 2.5, "a b"), (2, None, "c")]
    with pytest.raises(ValueError, match="no catalog definition"):
        readers.catalog_header("1|2")


def test_methods_can_be_added(spark):
    lc = spark.createDataFrame([(1, float(k), float(k % 3), 0.1, k) for k in range(30)], COLS)
    periodograms.register_method("flat", lambda x, m, e, f: {"power": -np.abs(f - 0.3)}, "power")
    got = periodograms.find_periods(lc, ["flat"], {"flat": (0.1, 0.1, 5)}, best=1, sigma=None).first()
    assert got.method == "flat" and got.period == pytest.approx(1 / 0.3)
