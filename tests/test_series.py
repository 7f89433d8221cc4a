"""Series operators against NumPy on small light curves with the awkward cases: ties, gaps, NaN, constants, few points."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import coords, models, photometry, times
from lumenframe.operators import catalog, features, fits, periodograms, selection, series, simulate, spatial, transits, trends

COLS = "objectid long, t double, m double, e double, seq long"


@pytest.fixture(scope="module")
def waves(spark):
    """Object 1: a sinusoid of period 2.5; 2: a constant; 3: nine points; 4: NaN and zero errors among good points."""
    rng = np.random.default_rng(4)
    rows = []
    t = np.sort(rng.uniform(0, 40, 300))
    rows += [(1, float(x), float(10 + 0.3 * math.sin(2 * math.pi * x / 2.5) + 0.01 * rng.normal()), 0.01, i) for i, x in enumerate(t)]
    rows += [(2, float(i), 5.0, 0.1, i) for i in range(20)]
    rows += [(3, float(i), float(i % 3), 0.1, i) for i in range(9)]
    rows += [(4, float(i), math.nan if i == 3 else float(i % 4), 0.0 if i == 5 else 0.1, i) for i in range(30)]
    return spark.createDataFrame(rows, COLS).cache()


def arrays(df, objectid):
    r = df.where(F.col("objectid") == objectid).orderBy("t", "seq").collect()
    return [np.array([x[c] for x in r], float) for c in ("t", "m", "e")]


def test_finite_filter_drops_nan_and_zero_errors(waves):
    assert series.finite_filter(waves.where("objectid = 4")).count() == 28
    assert series.finite_filter(waves.where("objectid = 4"), nonzero_errors=False).count() == 29


def test_clipping_is_strict_so_a_constant_series_loses_all(waves):
    assert series.sigclip(waves.where("objectid = 2"), 3.0).count() == 0
    t, m, e = arrays(waves, 1)
    keep = np.abs(m - np.median(m)) < 1.0 * 1.483 * np.median(np.abs(m - np.median(m)))
    assert series.sigclip(waves.where("objectid = 1"), 1.0).count() == keep.sum()


def test_timegroups_split_at_gaps_over_the_limit(spark):
    lc = spark.createDataFrame([(1, t, 0.0, 1.0, i) for i, t in enumerate([0.0, 1.0, 5.0, 9.1, 9.2])], COLS)
    assert [r.tgroup for r in series.timegroups(lc, 4.0).orderBy("t").collect()] == [0, 0, 0, 1, 1]


def test_point_on_a_bin_edge_counts_in_both(spark):
    lc = spark.createDataFrame([(1, t, t, 1.0, i) for i, t in enumerate([0.0, 0.5, 1.0])], COLS)
    got = {r.bin: r.n for r in series.time_bin(lc, 86400.0, least=1).collect()}
    assert got == {0: 2, 1: 2}


def test_features_need_ten_points(waves):
    ids = {r.objectid for r in features.moments(waves).collect()}
    assert ids == {1, 2, 4}


def test_stetson_against_numpy(waves):
    t, m, e = arrays(waves, 1)
    n = len(m)
    s = n / (n - 1) * (m - np.median(m)) / e
    w = np.exp(-np.diff(t) / np.median(np.diff(t)))
    p = w * s[1:] * s[:-1]
    r = features.stetson(waves.where("objectid = 1")).first()
    assert r.stetson_j == pytest.approx(np.sum(np.sign(p) * np.sqrt(np.abs(p))) / n, rel=1e-9)
    assert r.stetson_k == pytest.approx(np.sum(np.abs(s)) / np.sqrt(np.sum(s * s)) / np.sqrt(n), rel=1e-9)


@pytest.mark.parametrize(("search", "score", "largest"), [(periodograms.gls, "power", True), (periodograms.pdm, "theta", False), (periodograms.aov, "theta", True), (periodograms.aovhm, "theta", True), (periodograms.string_length, "length", False)])
def test_searches_find_the_period(waves, search, score, largest):
    p = search(waves.where("objectid = 1"), 0.3, 0.002, 150)
    best = periodograms.peaks(p, score, best=3, largest=largest).orderBy("rank").first()
    assert best["period"] == pytest.approx(2.5, rel=0.01)


def test_box_search_finds_a_transit(spark):
    t = np.linspace(0, 30, 900)
    m = np.where((t % 3.0) / 3.0 < 0.05, 0.98, 1.0) + 1e-4 * np.sin(17 * t)
    p = periodograms.bls(spark.createDataFrame([(1, float(a), float(b), 0.001, i) for i, (a, b) in enumerate(zip(t, m, strict=True))], COLS), 0.2, 0.001, 300)
    assert 1 / p.orderBy(F.desc("power")).first().freq == pytest.approx(3.0, rel=0.01)


def test_gls_matches_the_weighted_fit(waves):
    t, m, e = arrays(waves, 1)
    r = periodograms.gls(waves.where("objectid = 1"), 0.37, 0.01, 1).first()
    w = 1 / e**2
    a = np.stack([np.ones_like(t), np.cos(2 * np.pi * 0.37 * t), np.sin(2 * np.pi * 0.37 * t)], 1) * np.sqrt(w)[:, None]
    c, *_ = np.linalg.lstsq(a, m * np.sqrt(w), rcond=None)
    chi, base = np.sum((m * np.sqrt(w) - a @ c) ** 2), np.sum(w * (m - np.sum(w * m) / np.sum(w)) ** 2)
    assert r.power == pytest.approx(1 - chi / base, rel=1e-7)


@pytest.mark.parametrize("name", ["gls", "win", "pdm", "aov", "mav", "bls", "string"])
def test_kernels_equal_one_frequency_at_a_time(name):
    """A block of frequencies gives what each frequency gives alone, where no power is carried from one to the next."""
    r = np.random.default_rng(7)
    x = np.sort(np.append(r.uniform(0, 40, 219), 0.0))
    m, e = np.sin(2 * np.pi * x / 3.3) + r.normal(0, 0.3, 220), r.uniform(0.05, 0.2, 220)
    freqs = 0.011 + 0.013 * np.arange(130)
    kernel, score, _ = periodograms.METHODS[name]
    one = np.concatenate([kernel(x, m, e, freqs[i : i + 1])[score] for i in range(130)])
    assert np.allclose(kernel(x, m, e, freqs)[score], one, rtol=1e-7, atol=1e-9)


def test_stretches_of_a_grid_are_the_grid(waves):
    whole = periodograms.search(waves, (0.1, 0.01, 50), periodograms.gls_power, ["power"])
    parts = periodograms.search(waves, (0.1, 0.01, 50), periodograms.gls_power, ["power"], work=1500)
    a, b = ({(r.objectid, r.k): (r.freq, r.power) for r in x.collect()} for x in (whole, parts))
    assert a.keys() == b.keys() and len(a) == 50 * waves.select("objectid").distinct().count()
    assert all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


def test_grids_of_objects(waves):
    some = series.finite_filter(waves)
    for g in periodograms.frequency_grids(waves).collect():
        t = arrays(some, g.objectid)[0]
        assert (g["first"], g.step, g.number) == pytest.approx(periodograms.frequency_grid(t.min(), t.max(), len(t)))
    for g in periodograms.bls_grids(waves, 0.5, 10.0, 0.05).collect():
        t = arrays(some, g.objectid)[0]
        assert (g["first"], g.step, g.number) == pytest.approx(periodograms.bls_auto(t.max() - t.min(), 0.5, 10.0, 0.05)[:3])


def test_statistics_of_a_transit(spark):
    t = np.linspace(0, 30, 1500)
    r = np.random.default_rng(3)
    p = (t - 1.0) / 3.0 % 1.0
    m = 10.0 + 0.02 * ((p < 0.04) | (p > 0.96)) + r.normal(0, 0.002, 1500)  # fainter: larger magnitudes
    lc = spark.createDataFrame([(1, float(a), float(b), 0.002, i) for i, (a, b) in enumerate(zip(t, m, strict=True))], COLS)
    s = periodograms.bls_stats(lc, spark.createDataFrame([(1, 1, 3.05), (1, 2, 1.2)], "objectid int, rank int, period double"), qmax=0.2).orderBy("rank").collect()
    assert [x["rank"] for x in s] == [1, 2]
    assert s[0].status == "ok" and s[0].period == pytest.approx(3.0, rel=0.01) and abs(s[0].depth) == pytest.approx(0.02, rel=0.15) and s[0].duration == pytest.approx(0.08, rel=0.4)
    assert s[0].snr > 40 > s[1].snr
    box = periodograms.box_stats(lc, spark.createDataFrame([(1, 1, 3.0, 1.0, -0.02, 0.08)], "objectid int, rank int, period double, epoch double, depth double, duration double")).first()
    inside = (p < 0.04) | (p > 0.96)
    assert box.n_in == inside.sum() and box.rms == pytest.approx(np.std(m - 0.02 * inside), rel=1e-6)


def test_bootstrap_tells_signal_from_noise(spark):
    r = np.random.default_rng(9)
    t = np.sort(r.uniform(0, 20, 60))
    rows = [(k, float(a), float(b), 0.1, i) for k, y in ((1, np.sin(2 * np.pi * t / 2.5) + r.normal(0, 0.1, 60)), (2, r.normal(0, 1, 60))) for i, (a, b) in enumerate(zip(t, y, strict=True))]
    lc = spark.createDataFrame(rows, COLS)
    got = {x.objectid: x.fap for x in periodograms.bootstrap_fap(lc, (0.1, 0.02, 40), trials=99).collect()}
    assert got[1] == 0.01 and got[2] > 0.05
    again = {x.objectid: x.fap for x in periodograms.bootstrap_fap(lc, (0.1, 0.02, 40), trials=99, work=200_000).collect()}
    assert again == got
    pdm = periodograms.bootstrap_fap(lc, (0.1, 0.02, 40), periodograms.pdm_kernel(5, 5), "theta", trials=49, largest=False)
    assert {x.objectid: x.fap for x in pdm.collect()}[1] == 0.02


def test_period_of_an_autocorrelation(spark):
    lags = np.arange(200)
    acf = np.cos(2 * np.pi * lags / 24) * np.exp(-lags / 300)
    d = spark.createDataFrame([(1, int(k), float(v)) for k, v in zip(lags, acf)] + [(2, int(k), float(np.exp(-k / 30))) for k in lags], "objectid int, lag int, acf double")
    got = {x.objectid: x for x in periodograms.acf_period(d, 0.5).collect()}
    assert got[1].period == pytest.approx(12.0, rel=0.02) and got[1].naive_period == pytest.approx(12.0, rel=0.05) and got[1].height > 0.5
    assert got[2].best_lag is None and got[2].period is None


def test_one_table_for_all_methods(waves):
    got = periodograms.find_periods(waves, ["gls", "pdm", "bls"], {"bls": (0.3, 0.002, 150)}, best=2).collect()
    assert {x.method for x in got} == {"gls", "pdm", "bls"}
    assert all(x.period == pytest.approx(2.5, rel=0.05) for x in got if x.objectid == 1 and x["rank"] == 1 and x.method == "gls")


def test_faps_as_columns(spark):
    d = spark.createDataFrame([(0.4, 80), (None, 80)], "theta double, n int")
    r = d.select(periodograms.fap("pdm", "theta", "n", 20, 50.0).alias("p"), periodograms.fap("aov", "theta", "n", 20).alias("a"), periodograms.fap("mav", "theta", "n", 6).alias("m")).collect()
    assert tuple(r[0]) == pytest.approx((periodograms.pdm_fap(0.4, 80, 20, 50.0), periodograms.aov_fap(0.4, 80, 20), periodograms.aovhm_fap(0.4, 80, 6)))
    assert tuple(r[1]) == (None, None, None)


def test_fap_functions():
    assert periodograms.f_cdf(1.0, 4, 4) == pytest.approx(0.5, abs=1e-9)
    assert periodograms._incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-4)


@pytest.mark.parametrize("model", ["fourier", "spline", "savgol", "legendre"])
def test_fits_leave_little_residual(waves, model):
    options = {"fourier": {"order": 3}, "spline": {"knot_fraction": 0.05}, "savgol": {"window": 31}, "legendre": {"degree": 8}}[model]
    r = fits.fit(waves.where("objectid = 1"), model, 2.5, **options).first()
    assert r.residual_mad < 0.02


def test_trapezoid_fit_recovers_depth():
    t = np.linspace(0, 20, 800)
    ph = ((t - 0.7) / 2.0) % 1.0
    m = fits.trapezoid(ph, 10.0, 0.4, 0.12, 0.03)
    got = fits.fit_trapezoid(t, m, np.full(800, 0.01), 2.0, 0.69)
    assert got["params"][2] == pytest.approx(0.4, abs=0.02)


def test_sexagesimal_and_julian_dates(spark):
    r = spark.range(1).select(coords.hms_str_to_decimal(F.lit("12:30:00")).alias("a"), coords.dms_str_to_decimal(F.lit("-00 30 00")).alias("b"), coords.hms_str_to_decimal(F.lit("x")).alias("c"), times.mjd_to_jd(F.lit(0.0)).alias("d"), coords.hms_to_decimal(F.lit(25), F.lit(0), F.lit(0.0)).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (187.5, -0.5, None, 2400000.5, None)


def test_precession_over_a_century(spark):
    ra, dec = coords.precess(F.lit(0.0), F.lit(0.0), 2000.0, 2100.0)
    r = spark.range(1).select(ra.alias("ra"), dec.alias("dec")).first()
    assert r.ra == pytest.approx(1.2813, abs=1e-3)
    assert r.dec == pytest.approx(0.5567, abs=1e-3)


def test_cross_match_near_the_pole_and_over_zero(spark):
    a = spark.createDataFrame([(1, 0.001, 10.0), (2, 10.0, 89.9999), (3, 200.0, 0.0)], "objectid long, ra double, decl double")
    b = spark.createDataFrame([(1, 359.999, 10.0), (2, 190.0, 89.9999), (3, 20.0, 0.0)], "objectid long, ra double, decl double")
    got = {(r.objectid, r.x_objectid) for r in spatial.xmatch(a, b, 30.0).collect()}
    assert got == {(1, 1), (2, 2)}


@pytest.mark.parametrize("radius", [20.0, 3600.0, 3 * 3600.0])
def test_cross_match_equals_brute_force(spark, radius):
    rng = np.random.default_rng(2)
    make = lambda n: [(i, float(rng.uniform(0, 360)), float(np.degrees(np.arcsin(rng.uniform(-1, 1))))) for i in range(n)]
    a, b = (spark.createDataFrame(make(200), "objectid long, ra double, decl double") for _ in range(2))
    got = {(r.objectid, r.x_objectid) for r in spatial.xmatch(a, b, radius).collect()}
    cross = a.crossJoin(b.selectExpr("objectid AS k", "ra AS r2", "decl AS d2")).where(coords.great_circle_dist(F.col("ra"), F.col("decl"), F.col("r2"), F.col("d2")) < radius)
    assert got == {(r.objectid, r.k) for r in cross.collect()}


def test_filters_are_checked():
    cols = ["ra", "name"]
    assert catalog.checked_filter("ra > 5 and name like 'a''b%'", cols)
    assert catalog.checked_filter("ra > 5; drop table x", cols) is None
    assert catalog.checked_filter("system('x')", cols) is None
    with pytest.raises(ValueError, match="unknown operator"):
        catalog.column_filter("ra|zz|1")


def test_alias_types(spark):
    r = spark.createDataFrame([(2.0, 2.0), (4.0, 2.0), (1.0, 2.0), (2 / 3, 2.0), (9.0, 2.0), (5.0, 1.0)], "f double, p double").select(models.alias_type(F.col("f"), F.col("p")).alias("a")).collect()
    assert [x.a for x in r] == ["actual", "twice", "half", "ratio_over_1plus", "other", "other"]


def test_boundary_of_m_subtypes_has_no_class(spark):
    name, sti, _ = photometry.mdwarf_subtype(F.col("a"), F.col("b"))
    r = spark.createDataFrame([(0.9, 0.1), (5.0, 5.0)], "a double, b double").select(name.alias("n")).collect()
    assert [x.n for x in r] == ["M0", None]


def test_out_of_transit(waves):
    w = transits.transit_times(waves.where("objectid = 2").groupBy("objectid").agg(F.min("t").alias("t0"), F.max("t").alias("t1")), 5.0, 2.0, 1.0)
    assert sorted(r.tmid for r in w.collect()) == [2.0, 7.0, 12.0, 17.0]
    assert transits.out_of_transit(waves.where("objectid = 2"), w).count() == 16


def test_injection_is_repeatable(waves):
    kinds = waves.select("objectid").distinct().withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in simulate.KINDS]), F.col("objectid").cast("int")))
    a, b = (sorted(r.m for r in simulate.inject(series.finite_filter(waves), kinds).collect()) for _ in range(2))
    assert a == b and all(math.isfinite(x) for x in a)


def test_confusion_of_nothing_found_is_null(spark):
    r = selection.confusion(spark.createDataFrame([(1, True, False), (1, False, False)], "g int, actual boolean, found boolean"), ["g"]).first()
    assert (r.tp, r.fn, r.tn, r.precision, r.recall) == (0, 1, 1, None, 0.0)


def test_template_filtering_removes_a_common_trend(spark):
    rng = np.random.default_rng(1)
    t = np.linspace(0, 10, 100)
    trend = np.sin(t)
    rows = [(o, float(x), float(10 + a * y + 0.001 * rng.normal()), 0.01, i) for o, a in ((1, 1.0), (2, 0.5), (3, 2.0)) for i, (x, y) in enumerate(zip(t, trend, strict=True))]
    lc = spark.createDataFrame(rows, COLS)
    pos = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 20.0, 0.0)], "objectid long, ra double, decl double")
    out = trends.tfa(lc, lc, pos).where("objectid = 1").agg(F.stddev("m_tfa")).first()[0]
    assert out < 0.05


def test_empty_table(spark):
    none = spark.createDataFrame([], COLS)
    assert features.nonperiodic(none).count() == 0
    assert periodograms.gls(none, 0.1, 0.1, 5).count() == 0
    assert series.fill_gaps(none, 0.5).count() == 0


@pytest.mark.parametrize("work", [1 << 28, 1500])
def test_peaks_within_tasks_are_those_of_all_scores(spark, work):
    import numpy as np

    r = np.random.default_rng(12)
    waves = spark.createDataFrame([(k, float(t), float(np.sin(2 * np.pi * t / (2.0 + k)) + 0.2 * r.normal()), 0.1, i) for k in range(3) for i, t in enumerate(np.sort(r.uniform(0, 50, 90)))], "objectid int, t double, m double, e double, seq int")
    grid = (0.1, 0.003, 400)
    got = {tuple(r) for r in periodograms.best_peaks(waves, grid, ["gls", "pdm", "bls"], 4, 0.05, work).collect()}
    want = set()
    for name in ("gls", "pdm", "bls"):
        kernel, score, largest = periodograms.METHODS[name]
        scores = periodograms.search(waves, grid, kernel, [score])
        want |= {(r.objectid, name, r["rank"], r.period, r[score]) for r in periodograms.peaks(scores, score, 4, 0.05, largest).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in want} and len(want) > 6
    assert [v for x in sorted(got) for v in x[3:]] == pytest.approx([v for x in sorted(want) for v in x[3:]])
