"""Queries over iterated searches and fits of single events, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flares, periodograms, prewhitening, single_transits, tls, trends
from .series_queries import FOLDED, GLS, LC, rounded
from .series_queries import Q as SERIES
from .tables import events

Q: dict[str, tuple] = {}


def prewhiten_first(s: SparkSession, d: str) -> DataFrame:
    """The first round over every object's automatic grid: the best period of the plain search."""
    found = prewhitening.prewhiten_rounds(events(s, d), rounds=1, sigma=None)
    return rounded(found.select("objectid", "period", "power"), power=4)


Q["prewhiten_first"] = (prewhiten_first, SERIES["gls_best_period"][1])


def prewhiten_rounds(s: SparkSession, d: str) -> DataFrame:
    return rounded(prewhitening.prewhiten_rounds(events(s, d), rounds=3, order=2, sigma=None))


Q["prewhiten_rounds"] = (prewhiten_rounds, None)


def tls_periodogram(s: SparkSession, d: str) -> DataFrame:
    lc = events(s, d)
    return rounded(tls.tls(lc, periodograms.bls_grids(lc, 2.0, 8.0, 0.05), bins=50, shortest=0.04, longest=0.2))


Q["tls_periodogram"] = (tls_periodogram, None)


def tls_efficiency(s: SparkSession, d: str) -> DataFrame:
    lc = events(s, d)
    return rounded(tls.detection_efficiency(tls.tls(lc, periodograms.bls_grids(lc, 2.0, 8.0, 0.05), bins=50, shortest=0.04, longest=0.2)))


Q["tls_efficiency"] = (tls_efficiency, None)


def transit_windows(s: SparkSession, d: str) -> DataFrame:
    """The points of events within a day of the mid-times of a period of a few days, counted by transit."""
    lc = events(s, d)
    eph = lc.groupBy("objectid").agg((F.lit(2.5) + F.col("objectid") % 4).alias("period"), F.lit(60310.25).alias("t0"), F.lit(0.5).alias("duration"))
    w = single_transits.with_transits(lc, eph)
    return rounded(w.groupBy("objectid", "transit").agg(F.count(F.lit(1)).alias("n"), F.min("predicted").alias("predicted"), F.avg("m").alias("level")))


_WINDOWS = f"{LC}, p AS (SELECT *, 2.5::DOUBLE + objectid % 4 AS period FROM lc), w AS (SELECT *, round((t - 60310.25) / period)::BIGINT AS transit FROM p), x AS (SELECT *, 60310.25::DOUBLE + transit * period AS predicted FROM w)"
Q["transit_windows"] = (transit_windows, f"{_WINDOWS} SELECT objectid, transit, count(*) AS n, round(min(predicted), 6) AS predicted, round(avg(m), 6) AS level FROM x WHERE abs(t - predicted) <= 1.0 GROUP BY 1, 2")


def transit_timing(s: SparkSession, d: str) -> DataFrame:
    """O-C of the mean times of the points of each window, their error that of a mean."""
    lc = events(s, d)
    eph = lc.groupBy("objectid").agg((F.lit(2.5) + F.col("objectid") % 4).alias("period"), F.lit(60310.25).alias("t0"), F.lit(0.5).alias("duration"))
    seen = single_transits.with_transits(lc, eph).groupBy("objectid", "transit").agg(F.avg("t").alias("tmid"), (F.lit(0.5) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("err"))
    return rounded(single_transits.observed_minus_calculated(seen), period=5, calculated=4, oc=4, t0=3)


Q["transit_timing"] = (
    transit_timing,
    f"{_WINDOWS}, o AS (SELECT objectid, transit, avg(t) AS tmid, 0.5 / sqrt(count(*)) AS err FROM x WHERE abs(t - predicted) <= 1.0 GROUP BY 1, 2), z AS (SELECT *, 1 / (err * err) AS wt, min(tmid) OVER (PARTITION BY objectid) AS base FROM o), mn AS (SELECT objectid, sum(wt * transit) / sum(wt) AS mx, sum(wt * (tmid - base)) / sum(wt) AS my FROM z GROUP BY 1), ln AS (SELECT z.objectid, CASE WHEN sum(wt * (transit - mx) ^ 2) > 0 THEN sum(wt * (transit - mx) * (tmid - base)) / sum(wt * (transit - mx) ^ 2) END AS period FROM z JOIN mn ON z.objectid = mn.objectid GROUP BY 1) SELECT z.objectid, transit, round(tmid, 6) AS tmid, round(err, 6) AS err, round(base + my + period * (transit - mx), 4) AS calculated, round(tmid - (base + my + period * (transit - mx)), 4) AS oc, round(period, 5) AS period, round(base + my - period * mx, 3) AS t0 FROM z JOIN mn ON z.objectid = mn.objectid JOIN ln ON z.objectid = ln.objectid",
)


def transit_midtimes(s: SparkSession, d: str) -> DataFrame:
    """Fits of single transits to the events as a flux around one, with a transit of known shape put in."""
    lc = events(s, d)
    eph = lc.groupBy("objectid").agg(F.lit(3.0).alias("period"), F.lit(60311.0).alias("t0"), F.lit(0.6).alias("duration"), F.lit(0.2).alias("rp"), F.lit(1.9).alias("a"), F.lit(0.2).alias("b"))
    off = F.abs(F.pmod(F.col("t") - 60311.0 + 1.5, F.lit(3.0)) - 1.5)
    flat = lc.withColumn("m", 1.0 + 1e-5 * F.col("m") - F.when(off < 0.3, 0.05).otherwise(0.0)).withColumn("e", F.lit(0.005))
    return rounded(single_transits.midtimes(flat, eph, least=6).select("objectid", "transit", "tmid", "n", "n_in", "before", "after"), tmid=3)


Q["transit_midtimes"] = (transit_midtimes, None)


def flare_fits(s: SparkSession, d: str) -> DataFrame:
    """A fit of each run of points that stands out of an object's events, with three days around it."""
    lc = events(s, d)
    return rounded(flares.fit_flares(lc, trends.find_flares(lc, sigma=3.0), 3.0, 3.0).select("objectid", "flare", "n", "amplitude", "level"), 2)


Q["flare_fits"] = (flare_fits, None)


def combined_periodogram(s: SparkSession, d: str) -> DataFrame:
    """GLS on a grid of its own and PDM on one of a third of the frequencies, three times as far apart, added up."""
    lc = events(s, d)
    grids = periodograms.frequency_grids(lc)
    coarse = grids.withColumns({"step": 3 * F.col("step"), "number": F.ceil(F.col("number") / 3).cast("long")})
    pdm = periodograms.pdm(lc, coarse, bins=5, least=5)
    return rounded(periodograms.combined({"gls": (periodograms.gls(lc, grids), "power", True), "pdm": (pdm, "theta", False)}, 0.02), power=4)


_ADDED = ", ".join(
    f"{n}1 AS (SELECT objectid, freq, {share} AS p, (freq + coalesce(lag(freq) OVER w, freq)) / 2 AS low, (freq + coalesce(lead(freq) OVER w, freq)) / 2 AS high FROM {src} WINDOW w AS (PARTITION BY objectid ORDER BY freq)), {n}2 AS (SELECT objectid, bin, max(p) AS p FROM (SELECT objectid, p, unnest(range(floor(low / 0.02)::BIGINT, floor(high / 0.02)::BIGINT + 1)) AS bin FROM {n}1) GROUP BY ALL)"
    for n, src, share in (("a", "gls", "power / max(power) OVER (PARTITION BY objectid)"), ("b", "pt", "min(theta) OVER (PARTITION BY objectid) / theta"))
)
Q["combined_periodogram"] = (
    combined_periodogram,
    f"{LC}, {GLS}, {FOLDED.split(', gr AS')[0]}, fb AS {FOLDED.split(', fb AS ')[1]}, v AS (SELECT objectid, var_samp(m) AS v0 FROM lc GROUP BY 1), "
    f"b AS (SELECT objectid, k, freq, bin, count(*) AS n, var_samp(m) AS s2 FROM fb WHERE k % 3 = 0 GROUP BY ALL HAVING count(*) > 5), g AS (SELECT objectid, k, freq, sum(s2 * (n - 1)) AS top, sum(n) AS n, count(*) AS bins FROM b GROUP BY ALL), pt AS (SELECT g.objectid, k, freq, top / (n - bins) / v0 AS theta FROM g JOIN v ON g.objectid = v.objectid), {_ADDED}, t AS (SELECT objectid, bin, count(*)::INT AS methods, sum(p) AS p FROM (SELECT * FROM a2 UNION ALL SELECT * FROM b2) GROUP BY ALL) SELECT objectid, bin, round((bin + 0.5)::DOUBLE * 0.02::DOUBLE, 6) AS freq, methods, round(p / max(p) OVER (PARTITION BY objectid), 4) AS power FROM t",
)
