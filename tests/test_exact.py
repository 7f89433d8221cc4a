"""Results that need every pair or point: no cap, and points that the SQL of a query keeps."""

import datetime
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from lumenframe.operators import fits, flares, neighbours, periodic, periodograms, single_transits, spatial, transit_fits
from lumenframe.plans import catalog_queries, registry
from lumenframe.sources import datasource, readers, writers


def test_neighbor_features_count_all(spark):
    """130 stars at one place and 3 beside it: more than any cap, and none of one's own place."""
    rows = [(i, 10.0, 0.0) for i in range(130)] + [(200 + i, 10.0, 0.01 * (i + 1)) for i in range(3)] + [(300, 200.0, 80.0), (301, None, 1.0)]
    got = {r.objectid: (r.n_neighbors, r.closest_arcsec) for r in spatial.neighbor_features(spark.createDataFrame(rows, "objectid int, ra double, decl double"), 100.0).collect()}
    assert len(got) == 135 and {got[i][0] for i in range(130)} == {2} and {round(got[i][1], 6) for i in range(130)} == {36.0}
    assert [got[200 + i][0] for i in range(3)] == [132, 132, 2] and got[300] == (0, None) and got[301] == (0, None)


def test_pairs_have_no_cap_and_curves_keep_points_as_asked(spark):
    """121 stars beside one; the neighbour's points with an error of zero stay where nonzero_errors is false."""
    cat = spark.createDataFrame([(i, 10.0 + 0.001 * i, 0.0) for i in range(122)], "objectid int, ra double, decl double")
    assert spatial.close_pairs(cat, 1000.0).where("objectid = 0").count() == 121
    assert spatial.neighbors(cat, 1000.0).where("objectid = 0").count() == 100
    lc = spark.createDataFrame([(2, 0.1 * i, float(i % 7), 0.0 if i % 7 == 0 else 0.1, i) for i in range(70)], "objectid int, t double, m double, e double, seq long")
    pairs = spark.createDataFrame([(1, 2)], "objectid int, neighbor int")
    assert neighbours.curves(lc, pairs).count() == 60 and neighbours.curves(lc, pairs, nonzero_errors=False).count() == 70


ZERO = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """Tables of two stars near each other, in whose events some values, and so errors, are zero; of a third half are, times
    are equal, and one point lies far from the others, but not from the whole."""
    top = str(tmp_path_factory.mktemp("zeros"))
    value = lambda i, u: 0.0 if i % 17 == u % 5 else round(20 + 9 * math.sin(i * (1.3 + u)) + i % 5, 2)
    when = lambda i, u: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(hours=9.7 * i + 3.1 * u + (i * 37 % 11) / 7)
    rows = [(100 * u + i, when(i, u), u, "view", value(i, u), "") for u in (0, 17) for i in range(70)]
    rows += [(5000 + i, when(i // 4 * 4, 2), 2, "view", 0.0 if i % 2 else 130.0 if i == 34 else 100.0 + i % 5 / 2, "") for i in range(70)]
    spark.createDataFrame(rows, ZERO).write.parquet(f"{top}/events.parquet")
    spark.createDataFrame([(0, 100.0, 1), (17, 50.0, 2), (1, 200.0, 1)], "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(f"{top}/customer.parquet")
    return top


NAMES = ["neighbour_curves", "neighbour_blends", "fill_gaps", "autocorrelation", "acf_period", "moments", "flux_measures", "linear_fit", "kepler_mags", "fit_fourier", "fit_legendre", "fit_savgol", "aov_theta"]


@pytest.mark.parametrize("name", NAMES)
def test_points_without_an_error_count_as_in_sql(spark, zeros, name):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{zeros}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, zeros)
    cur = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    show = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else f"{v + 0.0:.7g}" if isinstance(v, (int, float)) else str(v)
    want = sorted([show(r[i]) for i in at] for r in cur.fetchall())
    assert want and sorted([show(v) for v in r] for r in df.collect()) == want


def test_bootstrap_takes_many_trials_at_once(spark):
    """As one trial after another: the same draws, and calls of the kernel with many rows."""
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 20, 40))
    m, e, freqs = 10 + 0.3 * np.sin(t) + rng.normal(0, 0.2, 40), rng.uniform(0.1, 0.3, 40), 0.05 + 0.01 * np.arange(90)
    drawn = np.stack([m, *(m[np.random.default_rng((3, k, periodograms.xxhash64("7"))).integers(0, 40, 40)] for k in range(1, 31))])
    one = np.stack([periodograms.gls_power(t - t[0], x, e, freqs)["power"] for x in drawn])
    assert np.allclose(periodograms.gls_power(t - t[0], drawn, e, freqs)["power"], one, rtol=1e-9, atol=1e-12)
    lc = spark.createDataFrame([(7, *map(float, x), i) for i, x in enumerate(zip(t, m, e, strict=True))], "objectid int, t double, m double, e double, seq int")
    got = periodograms.bootstrap_fap(lc, (0.05, 0.01, 90), trials=30).first()
    assert abs(got.best - one[0].max()) < 1e-9 and got.fap == (1 + (one[1:].max(1) >= one[0].max()).sum()) / 31
    other = periodograms.bootstrap_fap(lc, (0.05, 0.01, 90), kernel=lambda *x: periodograms.gls_power(*x), trials=30, work=40 * 31 * 20).first()
    assert abs(other.best - got.best) < 1e-9 and other.fap == got.fap


def test_groups_come_whole_and_many_in_a_call(spark):
    """Groups of unlike sizes, also over several batches of Arrow: each comes once, in order of t, and not one a call."""
    sizes = {i: 1 + i * 7 % 13 for i in range(200)} | {500: 300}
    rows = [(i, float(n - j), 0.5, 0.1, j) for i, n in sizes.items() for j in range(n)]
    lc = spark.createDataFrame(rows, "objectid int, t double, m double, e double, seq int")

    def run(groups):
        return pd.DataFrame({"objectid": [g["objectid"].iloc[0] for g in groups], "n": [len(g) for g in groups], "calls": [len(groups)] * len(groups), "ok": [bool((g["t"].diff().dropna() > 0).all()) for g in groups]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = fits.in_groups(lc, ["objectid"], run, "objectid int, n int, calls int, ok boolean").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.objectid: r.n for r in got} == sizes and len(got) == len(sizes) and all(r.ok for r in got) and min(r.calls for r in got) > 1


def test_many_fits_are_as_each_alone():
    """Of unlike lengths, one of them without a fit: filled-up points weigh nothing."""
    rng = np.random.default_rng(4)
    ts = [np.sort(rng.uniform(0, 12, n)) for n in (60, 90, 75)]
    es = [np.full(len(t), 1e-3) for t in ts]
    ys = [transit_fits.transit_model(t, 1.0 + 0.01 * i, 2.0, 0.1, 6.0, 0.2, (0.3, 0.2)) + rng.normal(0, 1e-4, len(t)) for i, t in enumerate(ts)]
    p, t0 = np.full(3, 2.0), np.full(3, 1.0)
    many = transit_fits.fit_many(ts, ys, es, p, t0, starts=2, steps=20)
    for i, got in enumerate(many):
        alone = transit_fits.fit_mandel_agol(ts[i], ys[i], es[i], 2.0, 1.0, starts=2, steps=20)
        assert np.allclose(got["params"], alone["params"], rtol=1e-6) and abs(got["chisq"] - alone["chisq"]) < 1e-6
        assert abs(got["params"][0] - 1.0 - 0.01 * i) < 0.05
    at = np.array([[1.0 + 0.01 * i, 2.0, 0.2, 0.1, 6.0, 0.2] for i in range(3)])
    near = [np.abs(t - a[0]) < 0.8 for t, a in zip(ts, at, strict=True)]
    cut = [[x[k] for x, k in zip(v, near, strict=True)] for v in (ts, ys, es)]
    mids = single_transits.fit_many(*cut, at, (0.3, 0.2))
    alone = [single_transits.fit_many([a], [b], [c], d[None], (0.3, 0.2))[0] for a, b, c, d in zip(*cut, at, strict=True)]
    assert np.allclose(mids, alone, rtol=1e-6, atol=1e-6)
    t = np.linspace(0, 3, 80)
    m = [flares.flare_curve(t[:n], 2.0 + n / 100, 1.0, 0.1, 0.3, 5.0) for n in (80, 60, 5)]
    e = [np.full(len(x), 0.01) for x in m]
    got = flares.fit_many([t[: len(x)] for x in m], m, e, [0.9] * 3, [1.3] * 3)
    assert got[2] is None and all(abs(g["amplitude"] - a) < 1e-4 and abs(g["peak"] - 1.0) < 1e-4 and g["n"] == n for g, a, n in zip(got, (2.8, 2.6), (80, 60), strict=False))


def test_bounded_fits_of_many_are_as_each_alone():
    rng = np.random.default_rng(8)
    ts = [np.sort(rng.uniform(0, 30, n)) for n in (70, 120, 95)]
    ms = [10 + 0.3 * fits.trapezoid(((t - 0.4) / p) % 1.0, 0.0, 1.0, 0.2, 0.05) + rng.normal(0, 0.01, len(t)) for t, p in zip(ts, (2.1, 3.3, 4.7), strict=True)]
    es, p = [np.full(len(t), 0.01) for t in ts], np.array([2.1, 3.3, 4.7])
    epoch = np.array([fits.fit_spline(t, m, e, x)["epoch"] for t, m, e, x in zip(ts, ms, es, p, strict=True)])
    for shape, alone in (("trapezoid", fits.fit_trapezoid), ("eclipses", fits.fit_eclipses)):
        for got, *series in zip(fits.bounded_many(shape, ts, ms, es, p, epoch), ts, ms, es, p, strict=True):
            want = alone(*series)
            assert np.allclose(got[:2], (want["chisq"], want["redchisq"]), rtol=1e-4) and len(got[2]) == len(series[0])


def test_searched_features_are_those_of_the_tables_of_scores(spark, zeros):
    """Of a whole grid and of one in stretches, with points whose error is zero in the sampling alone."""
    lc, peaks, scores, window = catalog_queries._searched(spark, zeros)
    want = {tuple(r) for r in periodic.periodogram_features(peaks, scores, window).collect()}
    period = {r.objectid: r.period for r in peaks.where("rank = 1").collect()}
    for work in (periodograms.WORK, 5000):
        got = periodic.searched_features(lc, periodograms.frequency_grids(lc), work=work).collect()
        assert len(got) == 3 and {tuple(r)[:-1] for r in got} == want and {r.objectid: r.period for r in got} == period


def test_small_files_share_a_partition(spark, tmp_path, monkeypatch):
    """Each file once, a large one alone; a folder without files is no row."""
    for i in range(40):
        (tmp_path / f"{i}-hatlc.csv").write_bytes(writers.csv_file(str(i), pd.DataFrame({"t": [1.0, 2.0], "m": [3.0, 4.0], "e": [0.1, 0.1], "seq": [0, 1]})))
    schema = T.StructType([T.StructField("objectid", T.StringType()), T.StructField("rjd", T.DoubleType())])
    r = datasource.LightCurveReader(schema, f"file://{tmp_path}", readers.FORMATS["hat-csv"], None)
    assert len(r.partitions()) == 40
    monkeypatch.setattr(datasource, "LEAST", 1)
    assert len(r.partitions()) == 1 and sorted(r.read(r.partitions()[0])) == sorted((str(i), t) for i in range(40) for t in (1.0, 2.0))
    monkeypatch.setattr(datasource, "PARTITION", 10 * (datasource.OPENING + 200))
    parts = r.partitions()
    assert 4 <= len(parts) <= 5 and sorted(row for p in parts for row in r.read(p)) == sorted((str(i), t) for i in range(40) for t in (1.0, 2.0))
    monkeypatch.setattr(datasource, "PARTITION", 1)
    assert len(r.partitions()) == 40
    (tmp_path / "none").mkdir()
    assert datasource.scan(spark, f"file://{tmp_path}/none", "hat-csv", {"rjd": "double"}).count() == 0
