"""Queries over catalogs, scalars, selection, simulation and model kernels, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords, models, photometry, times
from ..operators import catalog, features, fits, periodic, periodograms, selection, series, simulate, spatial, transit_fits, transits, trends
from ..sources import readers
from .series_queries import BIN, CLIP, GLS, LC, REC, WALK, rounded
from .tables import STARS_SQL, SUPPLIES_SQL, events, stars, supplies, table

Q: dict[str, tuple] = {}
ST = f"WITH st AS ({STARS_SQL})"


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        Q[name] = (f, sql)
        return f

    return put


HAV = "degrees(2 * asin(least(sqrt(sin((radians({d2}) - radians({d1})) / 2) ^ 2 + cos(radians({d1})) * cos(radians({d2})) * sin((radians({r2}) - radians({r1})) / 2) ^ 2), 1.0))) * 3600"


@query("great_circle", f"{ST} SELECT objectid, round({HAV.format(r1='ra', d1='decl', r2='120.5', d2='33.25')}, 3) AS dist FROM st")
def great_circle(s: SparkSession, d: str) -> DataFrame:
    return rounded(stars(s, d).select("objectid", coords.great_circle_dist(F.col("ra"), F.col("decl"), F.lit(120.5), F.lit(33.25)).alias("dist")), 3)


@query("cone_search", f"{ST} SELECT objectid, round({HAV.format(r1='ra', d1='decl', r2='120.5', d2='33.25')}, 2) AS dist_arcsec FROM st WHERE {HAV.format(r1='ra', d1='decl', r2='120.5', d2='33.25')} <= 20 * 3600.0")
def cone_search(s: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.cone_search(stars(s, d), 120.5, 33.25, 20.0).select("objectid", "dist_arcsec"), 2)


@query("box_search", f"{ST} SELECT objectid, ra, decl FROM st WHERE (ra >= 350 OR ra <= 20) AND decl BETWEEN -30 AND 30")
def box_search(s: SparkSession, d: str) -> DataFrame:
    return spatial.box_search(stars(s, d), 350.0, 20.0, -30.0, 30.0).select("objectid", "ra", "decl")


#: A second catalog: suppliers at positions of their own.
SUP = "sup AS (SELECT s_suppkey AS objectid, ((s_suppkey * 137) % 360 + 0.75)::DOUBLE AS ra, ((s_suppkey * 53) % 180 - 89.25)::DOUBLE AS decl FROM supplier)"


def _suppliers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").selectExpr("s_suppkey AS objectid", "(s_suppkey * 137) % 360 + 0.75D AS ra", "(s_suppkey * 53) % 180 - 89.25D AS decl")


PAIR = HAV.format(r1="st.ra", d1="st.decl", r2="sup.ra", d2="sup.decl")


@query("xmatch_all", f"{ST}, {SUP} SELECT st.objectid, sup.objectid AS x_objectid, round({PAIR}, 3) AS dist_arcsec FROM st JOIN sup ON {PAIR} < 5400")
def xmatch_all(s: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.xmatch(stars(s, d).select("objectid", "ra", "decl"), _suppliers(s, d), 5400.0).select("objectid", "x_objectid", "dist_arcsec"), 3)


@query("xmatch_nearest", f"{ST}, {SUP}, m AS (SELECT st.objectid, sup.objectid AS x, {PAIR} AS dist FROM st JOIN sup ON {PAIR} < 5400), b AS (SELECT objectid, min(dist) AS dist, min_by(x, (dist, x)) AS x FROM m GROUP BY 1) SELECT st.objectid, b.x IS NOT NULL AS matched, b.x AS x_objectid, round(b.dist, 3) AS dist_arcsec FROM st LEFT JOIN b ON st.objectid = b.objectid")
def xmatch_nearest(s: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.xmatch_nearest(stars(s, d), _suppliers(s, d), 5400.0).select("objectid", "matched", "x_objectid", "dist_arcsec"), 3)


TWO = HAV.format(r1="a.ra", d1="a.decl", r2="b.ra", d2="b.decl")


@query("neighbors", f"{ST}, m AS (SELECT a.objectid, b.objectid AS n, {TWO} AS dist FROM st a JOIN st b ON abs(a.decl - b.decl) < 3 AND {TWO} < 7200 WHERE {TWO} > 0) SELECT a.objectid, count(m.n) AS n_neighbors, round(min(m.dist), 3) AS closest_arcsec FROM st a LEFT JOIN m ON a.objectid = m.objectid GROUP BY 1")
def neighbors(s: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.neighbor_features(stars(s, d), 7200.0), 3)


XYZ = "xyz AS (SELECT objectid, cos(radians(decl)) * cos(radians(ra)) AS x, cos(radians(decl)) * sin(radians(ra)) AS y, sin(radians(decl)) AS z FROM st)"


@query("xi_eta", f"{ST}, {XYZ}, r AS (SELECT objectid, cos(radians(20)) * cos(radians(100)) * x + cos(radians(20)) * sin(radians(100)) * y + sin(radians(20)) * z AS u, cos(radians(100)) * y - sin(radians(100)) * x AS v, cos(radians(20)) * z - sin(radians(20)) * cos(radians(100)) * x - sin(radians(20)) * sin(radians(100)) * y AS w FROM xyz) SELECT objectid, round(v * degrees(atan2(sqrt(v * v + w * w), u)) / sqrt(v * v + w * w), 5) AS xi, round(w * degrees(atan2(sqrt(v * v + w * w), u)) / sqrt(v * v + w * w), 5) AS eta FROM r")
def xi_eta(s: SparkSession, d: str) -> DataFrame:
    xi, eta = coords.xi_eta(F.col("ra"), F.col("decl"), 100.0, 20.0)
    return rounded(stars(s, d).select("objectid", xi.alias("xi"), eta.alias("eta")), 5)


_G = coords.GALACTIC
_ROW = lambda i: " + ".join(f"({_G[i][j]})::DOUBLE * {v}" for j, v in enumerate(("cos(radians(ra)) * cos(radians(decl))", "sin(radians(ra)) * cos(radians(decl))", "sin(radians(decl))")))


@query("galactic", f"{ST}, r AS (SELECT objectid, {_ROW(0)} AS x, {_ROW(1)} AS y, {_ROW(2)} AS z FROM st) SELECT objectid, round((degrees(atan2(y, x)) + 360) % 360, 6) AS gl, round(degrees(asin(z)), 6) AS gb FROM r")
def galactic(s: SparkSession, d: str) -> DataFrame:
    gl, gb = coords.equatorial_to_galactic(F.col("ra"), F.col("decl"))
    return rounded(stars(s, d).select("objectid", gl.alias("gl"), gb.alias("gb")))


@query("galactic_roundtrip", f"{ST} SELECT objectid, round(ra, 6) AS ra, round(decl, 6) AS decl FROM st")
def galactic_roundtrip(s: SparkSession, d: str) -> DataFrame:
    gl, gb = coords.equatorial_to_galactic(F.col("ra"), F.col("decl"))
    g = stars(s, d).select("objectid", gl.alias("gl"), gb.alias("gb"))
    ra, decl = coords.galactic_to_equatorial(F.col("gl"), F.col("gb"))
    return rounded(g.select("objectid", ra.alias("ra"), decl.alias("decl")))


#: The three angles of the precession from 2000 to 2015.5 in SQL.
ARC = {"zeta": "(2306.2181 * q + 0.30188 * q ^ 2 + 0.017998 * q ^ 3)", "z": "(2306.2181 * q + 1.09468 * q ^ 2 + 0.018203 * q ^ 3)", "theta": "(2004.3109 * q - 0.42665 * q ^ 2 - 0.041833 * q ^ 3)"}


@query("precess", f"{ST}, q AS (SELECT 0.155::DOUBLE AS q), an AS (SELECT radians({ARC['zeta']} / 3600) AS ze, radians({ARC['z']} / 3600) AS zz, radians({ARC['theta']} / 3600) AS th FROM q), r AS (SELECT objectid, cos(radians(decl)) * sin(radians(ra) + ze) AS a, cos(th) * cos(radians(decl)) * cos(radians(ra) + ze) - sin(th) * sin(radians(decl)) AS b, sin(th) * cos(radians(decl)) * cos(radians(ra) + ze) + cos(th) * sin(radians(decl)) AS c, zz FROM st, an) SELECT objectid, round((degrees(atan2(a, b) + zz) + 720) % 360, 6) AS ra, round(degrees(asin(c)), 6) AS decl FROM r")
def precess(s: SparkSession, d: str) -> DataFrame:
    ra, decl = coords.precess(F.col("ra"), F.col("decl"), 2000.0, 2015.5)
    return rounded(stars(s, d).select("objectid", ra.alias("ra"), decl.alias("decl")))


@query("sexagesimal", f"{ST}, h AS (SELECT objectid, decl, ra / 15.0 AS hh, abs(decl) AS a FROM st) SELECT objectid, floor(hh)::INT AS h, floor((hh - floor(hh)) * 60)::INT AS hm, CASE WHEN decl < 0 THEN '-' ELSE '+' END AS sign, floor(a)::INT AS dd, floor((a - floor(a)) * 60)::INT AS dm FROM h")
def sexagesimal(s: SparkSession, d: str) -> DataFrame:
    c = stars(s, d).select("objectid", coords.decimal_to_hms(F.col("ra")).alias("h"), coords.decimal_to_dms(F.col("decl")).alias("d"))
    return c.selectExpr("objectid", "h.h AS h", "h.m AS hm", "d.sign AS sign", "d.d AS dd", "d.m AS dm")


@query("sexagesimal_parse", f"{ST} SELECT objectid, round(((objectid % 24) + 30 / 60.0 + 15.5 / 3600) * 15, 6) AS ra, round(-((objectid % 90) + 20 / 60.0 + 45.25 / 3600), 6) AS decl FROM st")
def sexagesimal_parse(s: SparkSession, d: str) -> DataFrame:
    h = F.concat((F.col("objectid") % 24).cast("string"), F.lit(":30:15.5"))
    g = F.concat(F.lit("-"), (F.col("objectid") % 90).cast("string"), F.lit(" 20 45.25"))
    return rounded(stars(s, d).select("objectid", coords.hms_str_to_decimal(h).alias("ra"), coords.dms_str_to_decimal(g).alias("decl")))


@query("angle_wrap", f"{ST} SELECT objectid, round((ra - 200 + 360) % 360, 6) AS wrapped FROM st")
def angle_wrap(s: SparkSession, d: str) -> DataFrame:
    return rounded(stars(s, d).select("objectid", coords.angle_wrap(F.col("ra") - 200).alias("wrapped")))


@query("proper_motion", f"{ST} SELECT objectid, round(sqrt(jmag * jmag + hmag * hmag * cos(radians(decl)) ^ 2), 6) AS pm, round(jmag + 5 * log10(sqrt(jmag * jmag + hmag * hmag * cos(radians(decl)) ^ 2) / 1000), 6) AS rpm FROM st")
def proper_motion(s: SparkSession, d: str) -> DataFrame:
    pm = coords.total_proper_motion(F.col("hmag"), F.col("jmag"), F.col("decl"))
    return rounded(stars(s, d).select("objectid", pm.alias("pm"), coords.reduced_proper_motion(F.col("jmag"), pm).alias("rpm")))


@query("julian_dates", "SELECT event_id, round(epoch_us(ts)::DOUBLE / 86400000000.0 + 2440587.5, 6) AS jd, round(epoch_us(ts)::DOUBLE / 86400000000.0 + 40587.0, 6) AS mjd, abs(epoch_us(ts) - epoch_us(ts)) <= 50 AS same FROM events")
def julian_dates(s: SparkSession, d: str) -> DataFrame:
    jd = times.timestamp_to_jd(F.col("ts"))
    back = F.abs(F.unix_micros(times.jd_to_timestamp(jd)) - F.unix_micros(F.col("ts").cast("timestamp"))) <= 50
    return rounded(table(s, d, "events").select("event_id", jd.alias("jd"), times.jd_to_mjd(jd).alias("mjd"), back.alias("same")))


def _jhk(band: str, n: int, cols: tuple[str, ...]) -> str:
    c = photometry.FROM_JHK[band][n]
    return " + ".join([str(c[0]), *[f"({a}) * {x}" for a, x in zip(c[1:], cols, strict=True)]])


@query("jhk_to_bands", f"{ST} SELECT objectid, " + ", ".join(f"round({_jhk(b, 0, ('jmag', 'hmag', 'kmag'))}, 6) AS {b}" for b in photometry.FROM_JHK) + " FROM st")
def jhk_to_bands(s: SparkSession, d: str) -> DataFrame:
    j, h, k = F.col("jmag"), F.col("hmag"), F.col("kmag")
    return rounded(stars(s, d).select("objectid", *[photometry.from_jhk(b, j, h, k).alias(b) for b in photometry.FROM_JHK]))


HOLES = "ho AS (SELECT objectid, CASE WHEN objectid % 2 = 0 THEN jmag END AS j, CASE WHEN objectid % 3 <> 0 THEN hmag END AS h, CASE WHEN objectid % 5 < 3 THEN kmag END AS k FROM st)"


@query("jhk_missing", f"{ST}, {HOLES} SELECT objectid, round(coalesce(" + ", ".join(_jhk("sdssr", i, c) for i, c in enumerate((("j", "h", "k"), ("j", "h"), ("j", "k"), ("h", "k"), ("j",), ("h",), ("k",)))) + "), 6) AS sdssr FROM ho")
def jhk_missing(s: SparkSession, d: str) -> DataFrame:
    h = stars(s, d).selectExpr("objectid", "CASE WHEN objectid % 2 = 0 THEN jmag END AS j", "CASE WHEN objectid % 3 <> 0 THEN hmag END AS h", "CASE WHEN objectid % 5 < 3 THEN kmag END AS k")
    return rounded(h.select("objectid", photometry.from_jhk("sdssr", F.col("j"), F.col("h"), F.col("k")).alias("sdssr")))


@query("gaia_absolute_mag", f"{ST} SELECT objectid, round(5 - 5 * log10(1000 / kmag) + jmag, 6) AS abs_mag, round(sqrt((5 / (1000 / kmag * ln(10))) ^ 2 * (1000 / (kmag * kmag) * 0.1) ^ 2 + 0.0004), 6) AS abs_err FROM st")
def gaia_absolute_mag(s: SparkSession, d: str) -> DataFrame:
    m, e = photometry.absolute_gaia_magnitude(F.col("jmag"), F.col("kmag"), F.lit(0.02), F.lit(0.1))
    return rounded(stars(s, d).select("objectid", m.alias("abs_mag"), e.alias("abs_err")))


@query("kepler_mags", f"{LC} SELECT seq, round(12 - 2.5 * log10(m / 174000), 6) AS kepmag, round(m, 4) AS flux, round(-2.5 * log10(1 - m / 1000000), 9) AS ppm_mag FROM lc")
def kepler_mags(s: SparkSession, d: str) -> DataFrame:
    k = photometry.keplerflux_to_keplermag(F.col("m"))
    return rounded(events(s, d).select("seq", k.alias("kepmag"), photometry.keplermag_to_keplerflux(k).alias("flux"), photometry.flux_ppm_to_magnitudes(F.col("m")).alias("ppm_mag")), flux=4, ppm_mag=9)


MAGS = ", ".join(f"{_jhk(b, 0, ('jmag', 'hmag', 'kmag'))} + (objectid % {p}) * 0.05 AS {x}" for b, x, p in (("sdssu", "u", 47), ("sdssg", "g", 31), ("sdssr", "r", 17), ("sdssi", "i", 13), ("sdssz", "z", 7)))
INDEX = "0.283*(u-g)-0.354*(g-r)+0.455*(r-i)+0.766*(i-z) AS v_color, 0.91*(u-g)+0.415*(g-r)-1.28 AS p1_color, -0.436*u+1.129*g-0.119*r-0.574*i+0.1984 AS l_color, -0.249*u+0.794*g-0.555*r+0.124 AS s_color, (u-g)+0.67*(g-r)-1.07 AS d_ug, 0.45*(u-g)-(g-r)-0.12 AS d_gr, 0.875274*(r-i)+0.483628*(i-z+0.00438) AS sti"
SUBTYPE = "CASE " + " ".join(f"WHEN sti > {a} AND sti < {b} THEN 'M{i}'" for i, (a, b) in enumerate(zip(photometry.M_BOUNDS, photometry.M_BOUNDS[1:], strict=False))) + " END"


def _colors(s: SparkSession, d: str) -> DataFrame:
    j, h, k = F.col("jmag"), F.col("hmag"), F.col("kmag")
    c = stars(s, d).select("objectid", j.alias("j"), h.alias("h"), k.alias("k"), *[(photometry.from_jhk(b, j, h, k) + (F.col("objectid") % p) * 0.05).alias(x) for b, x, p in (("sdssu", "u", 47), ("sdssg", "g", 31), ("sdssr", "r", 17), ("sdssi", "i", 13), ("sdssz", "z", 7))])
    c = c.selectExpr("*", *[f"{x} AS {x}m" for x in "ugriz"], "j + 2 AS rpmj")
    name, sti, sts = photometry.mdwarf_subtype(F.col("r") - F.col("i"), F.col("i") - F.col("z"))
    return c.withColumns(photometry.color_indices(*[F.col(x) for x in "ugriz"])).withColumns({"m_class": name, "sti": sti, "sts": sts})


_CUTS = ", ".join(f"CASE WHEN {cut} THEN '{n}' END" for n, cut in photometry.CLASSES)
for _x in "ugriz":
    _CUTS = _CUTS.replace(f"{_x}m", _x)


@query("color_classes", f"{ST}, c1 AS (SELECT objectid, jmag AS j, hmag AS h, kmag AS k, {MAGS} FROM st), c2 AS (SELECT *, {INDEX} FROM c1), c3 AS (SELECT *, {SUBTYPE} AS m_class FROM c2) SELECT objectid, round(v_color, 6) AS v_color, round(p1_color, 6) AS p1_color, round(s_color, 6) AS s_color, m_class, coalesce(list_aggregate([CASE WHEN m_class IS NOT NULL THEN 'd' || m_class END, {_CUTS}], 'string_agg', ';'), '') AS classes FROM c3")
def color_classes(s: SparkSession, d: str) -> DataFrame:
    c = _colors(s, d).withColumn("classes", F.array_join(photometry.color_classes(), ";"))
    return rounded(c.select("objectid", "v_color", "p1_color", "s_color", "m_class", "classes"))


@query("catalog_build", f"{LC}, st AS ({STARS_SQL}), n AS (SELECT objectid, count(*) FILTER (isfinite(m)) AS ndet, min(t) AS a, max(t) AS b FROM lc GROUP BY 1), di AS (SELECT objectid, ra, decl FROM st UNION ALL SELECT objectid, ra + 0.5, decl FROM st WHERE objectid % 10 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY objectid ORDER BY ra, decl) AS k FROM di) SELECT r.objectid, CASE WHEN k > 1 THEN objectid || '-' || k ELSE objectid::VARCHAR END AS name, ra, decl, coalesce(ndet, 0) AS ndet, round(a, 6) AS mintime FROM r LEFT JOIN n USING (objectid)")
def catalog_build(s: SparkSession, d: str) -> DataFrame:
    i = stars(s, d).select("objectid", "ra", "decl")
    info = i.unionAll(i.where("objectid % 10 = 0").withColumn("ra", F.col("ra") + 0.5))
    return rounded(catalog.build(events(s, d), info).select("objectid", "name", "ra", "decl", "ndet", "mintime"))


@query("catalog_filter", f"{ST} SELECT objectid, ra, round(jmag, 9) AS jmag FROM st WHERE st.jmag > 11 AND decl < 20 AND ra > 30 AND ra < 300 AND nation <> 7")
def catalog_filter(s: SparkSession, d: str) -> DataFrame:
    return rounded(catalog.filter_catalog(stars(s, d), ["jmag|gt|11", "decl|lt|20", "ra|cb|30,300", "nation|ne|7"]).select("objectid", "ra", "jmag"), 9)


@query("sql_filter", f"{ST} SELECT objectid FROM st WHERE ra BETWEEN 10 AND 50 AND (decl < 0 OR nation IN (1, 2, 3))")
def sql_filter(s: SparkSession, d: str) -> DataFrame:
    return catalog.sql_filter(stars(s, d), "ra between 10 and 50 and (decl < 0 or nation in (1, 2, 3))").select("objectid")


@query("catalog_sort_top", f"{ST} SELECT objectid, round(jmag, 9) AS jmag FROM st ORDER BY st.jmag DESC, objectid LIMIT 25")
def catalog_sort_top(s: SparkSession, d: str) -> DataFrame:
    return rounded(catalog.sort_catalog(stars(s, d), "jmag|desc").limit(25).select("objectid", "jmag"), 9)


#: A uniform number from an object's id, a name and a seed, and more columns, as operators.simulate makes it.
U = lambda name, low, high, seed=1, more="", key="objectid": f"({low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE) * (('0x' || substr(md5({key} || '/{name}/{seed}'{more}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE))"


@query("sample_sort_limit", f"{ST} SELECT objectid, round(jmag, 9) AS jmag FROM st WHERE {U('sample', 0.0, 1.0, 0)} * 3 < 1 ORDER BY st.jmag, objectid LIMIT 50")
def sample_sort_limit(s: SparkSession, d: str) -> DataFrame:
    return rounded(catalog.sample_sort_limit(stars(s, d), 1, 3, "jmag|asc", 50).select("objectid", "jmag"), 9)


@query("add_info", f"{ST} SELECT st.objectid, o.o_orderkey, o.o_orderstatus FROM st LEFT JOIN (SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min_by(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1) o ON st.objectid = o.o_custkey")
def add_info(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "objectid")
    return catalog.add_info(stars(s, d).select("objectid"), o, ["o_orderkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])


@query("color_magnitude", f"{ST} SELECT objectid, 'jmag-kmag' AS color, round(jmag - kmag, 6) AS x, round(kmag, 6) AS y FROM st UNION ALL SELECT objectid, 'jmag-hmag', round(jmag - hmag, 6), round(hmag, 6) FROM st")
def color_magnitude(s: SparkSession, d: str) -> DataFrame:
    return rounded(catalog.color_magnitude(stars(s, d), [("jmag", "kmag", "kmag"), ("jmag", "hmag", "hmag")]))


def _feats(s: SparkSession, d: str) -> DataFrame:
    return stars(s, d).selectExpr("objectid", "jmag AS mag", "1 + pmod(objectid * 7919, 1000) / 100D AS idx1", "2 + pmod(objectid * 104729, 1000) / 200D AS idx2")


VT = "ft AS (SELECT objectid, jmag AS mag, 1 + (objectid * 7919) % 1000 / 100.0 AS idx1, 2 + (objectid * 104729) % 1000 / 200.0 AS idx2 FROM st), fb AS (SELECT *, CASE WHEN mag < 8 THEN 0 WHEN mag >= 16.25 THEN 34 ELSE floor((mag - 8) / 0.25)::INT + 1 END AS magbin FROM ft), k AS (SELECT magbin, median(idx1) AS m1, median(idx2) AS m2 FROM fb GROUP BY 1 HAVING count(*) >= 5), j AS (SELECT fb.*, m1, m2 FROM fb JOIN k USING (magbin)), z AS (SELECT magbin, median(abs(idx1 - m1)) AS a1, median(abs(idx2 - m2)) AS a2 FROM j GROUP BY 1), vt AS (SELECT j.*, idx1 > m1 + 1.1 * 1.483 * a1 AS v1, idx2 > m2 + 1.1 * 1.483 * a2 AS v2 FROM j JOIN z USING (magbin))"


@query("variability_threshold", f"{ST}, {VT} SELECT objectid, magbin, v1 AS idx1_var, v2 AS idx2_var, v1 AND v2 AS all_var FROM vt")
def variability_threshold(s: SparkSession, d: str) -> DataFrame:
    return selection.variability_threshold(_feats(s, d), ["idx1", "idx2"], 1.1).select("objectid", "magbin", "idx1_var", "idx2_var", "all_var")


CONF = "count(*) FILTER (a AND f) AS tp, count(*) FILTER (NOT a AND f) AS fp, count(*) FILTER (NOT a AND NOT f) AS tn, count(*) FILTER (a AND NOT f) AS fn"
SCORE = "tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc"


@query("recovery_confusion", f"{ST}, {VT}, c AS (SELECT magbin, objectid % 3 = 0 AS a, v1 AS f FROM vt), g AS (SELECT magbin, {CONF} FROM c GROUP BY 1) SELECT magbin, {SCORE} FROM g")
def recovery_confusion(s: SparkSession, d: str) -> DataFrame:
    v = selection.variability_threshold(_feats(s, d), ["idx1"], 1.1).withColumns({"actual": F.col("objectid") % 3 == 0, "found": F.col("idx1_var")})
    return rounded(selection.confusion(v, ["magbin"]))


@query("threshold_grid", f"{ST}, {VT}, c AS (SELECT magbin, cut, objectid % 3 = 0 AS a, idx1 > cut AS f FROM fb, (VALUES (3.0), (6.0), (9.0)) q(cut)), g AS (SELECT magbin, cut::DOUBLE AS cut, {CONF} FROM c GROUP BY ALL) SELECT magbin, cut, {SCORE} FROM g")
def threshold_grid(s: SparkSession, d: str) -> DataFrame:
    f = _feats(s, d).withColumns({"magbin": selection.magnitude_bin(F.col("mag")), "actual": F.col("objectid") % 3 == 0})
    return rounded(selection.threshold_grid(f, "idx1", [3.0, 6.0, 9.0]))


@query("recovery_tallies", f"{ST}, {VT} SELECT magbin, n3, count(*) AS n, count(*) FILTER (v1) AS n_recovered, round(count(*) FILTER (v1) / count(*), 6) AS share FROM (SELECT *, objectid % 3 AS n3 FROM vt) GROUP BY CUBE (magbin, n3)")
def recovery_tallies(s: SparkSession, d: str) -> DataFrame:
    v = selection.variability_threshold(_feats(s, d), ["idx1"], 1.1).withColumns({"n3": F.col("objectid") % 3, "recovered": F.col("idx1_var")})
    return rounded(selection.recovery_tallies(v, ["magbin", "n3"]))


def _two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = stars(s, d).select("objectid")
    return c.where("objectid % 2 = 0"), c.where("objectid % 3 = 0")


@query("set_intersect", f"{ST} SELECT objectid FROM st WHERE objectid % 2 = 0 INTERSECT SELECT objectid FROM st WHERE objectid % 3 = 0")
def set_intersect(s: SparkSession, d: str) -> DataFrame:
    return selection.both(*_two(s, d))


@query("set_except", f"{ST} SELECT objectid FROM st WHERE objectid % 2 = 0 EXCEPT SELECT objectid FROM st WHERE objectid % 3 = 0")
def set_except(s: SparkSession, d: str) -> DataFrame:
    return selection.only_first(*_two(s, d))


@query("set_union", f"{ST} SELECT objectid FROM st WHERE objectid % 2 = 0 UNION SELECT objectid FROM st WHERE objectid % 3 = 0")
def set_union(s: SparkSession, d: str) -> DataFrame:
    return selection.either(*_two(s, d))


@query("alias_type", f"{ST}, p AS (SELECT objectid, 0.3 + (objectid % 17) * 0.1 AS p FROM st), q AS (SELECT objectid, p, CASE objectid % 5 WHEN 0 THEN p WHEN 1 THEN 2 * p WHEN 2 THEN 0.5 * p WHEN 3 THEN p / (1 + p) ELSE 99.0 END AS f FROM p) SELECT objectid, " + "CASE " + " ".join(f"WHEN abs(f - {e}) <= 0.001 + 0.00001 * abs({e}) THEN '{n}'" for n, e in (("actual", "p"), ("twice", "2 * p"), ("half", "0.5 * p"), ("ratio_over_1plus", "p / (1 + p)"), ("ratio_over_1minus", "p / nullif(1 - p, 0)"), ("ratio_over_1plus_twice", "p / (1 + 2 * p)"), ("ratio_over_1minus_twice", "p / nullif(1 - 2 * p, 0)"), ("ratio_over_1plus_thrice", "p / (1 + 3 * p)"), ("ratio_over_1minus_thrice", "p / nullif(1 - 3 * p, 0)"), ("ratio_over_minus1", "p / nullif(p - 1, 0)"), ("ratio_over_twice_minus1", "p / nullif(2 * p - 1, 0)"))) + " ELSE 'other' END AS alias_type FROM q")
def alias_type(s: SparkSession, d: str) -> DataFrame:
    p = stars(s, d).selectExpr("objectid", "0.3D + (objectid % 17) * 0.1D AS p")
    f = F.expr("CASE objectid % 5 WHEN 0 THEN p WHEN 1 THEN 2 * p WHEN 2 THEN 0.5D * p WHEN 3 THEN p / (1 + p) ELSE 99.0D END")
    return p.select("objectid", models.alias_type(f, F.col("p")).alias("alias_type"))


PH = f"{LC}, ph AS (SELECT objectid, seq, x - floor(x) AS p, t, m FROM (SELECT *, (t - 60310.5) / 1.7 AS x FROM lc))"


def _phased(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).withColumn("p", models.phase(F.col("t"), 1.7, 60310.5))


@query("trapezoid_model", f"{PH} SELECT objectid, seq, round(CASE WHEN p > 0.95 AND p < 0.97 THEN 10 - 0.5 / 0.02 * (p - 0.95) WHEN p > 0.97 OR p < 0.03 THEN 9.5 WHEN p > 0.03 AND p < 0.05 THEN 9.5 + 0.5 / 0.02 * (p - 0.03) ELSE 10 END, 6) AS model FROM ph")
def trapezoid_model(s: SparkSession, d: str) -> DataFrame:
    return rounded(_phased(s, d).select("objectid", "seq", models.trapezoid_transit(F.col("p"), 10.0, 0.5, 0.1, 0.02).alias("model")))


@query("eclipse_model", f"{PH} SELECT objectid, seq, round(CASE WHEN p >= 0.45 AND p <= 0.55 THEN 10 - 0.25 * exp(-((p - 0.5) ^ 2) / (2 * 0.02 ^ 2)) WHEN p <= 0.05 THEN 10 - 0.5 * exp(-(p ^ 2) / (2 * 0.02 ^ 2)) WHEN p >= 0.95 THEN 10 - 0.5 * exp(-((p - 1) ^ 2) / (2 * 0.02 ^ 2)) ELSE 10 END, 6) AS model FROM ph")
def eclipse_model(s: SparkSession, d: str) -> DataFrame:
    return rounded(_phased(s, d).select("objectid", "seq", models.inverted_gaussian_eclipses(F.col("p"), 10.0, 0.5, 0.1, 0.5, 0.5).alias("model")))


@query("fourier_model", f"{PH} SELECT objectid, seq, round(10 + 0.3 * cos(0.1) + 0.2 * cos(2 * pi() * p + 0.2) + 0.1 * cos(4 * pi() * p + 0.3), 6) AS model, round(10 + 0.3 * sin(0.1) + 0.2 * sin(2 * pi() * p + 0.2), 6) AS sines FROM ph")
def fourier_model(s: SparkSession, d: str) -> DataFrame:
    return rounded(_phased(s, d).select("objectid", "seq", models.fourier_series(F.col("p"), 10.0, [0.3, 0.2, 0.1], [0.1, 0.2, 0.3]).alias("model"), models.sine_series(F.col("p"), 10.0, [0.3, 0.2], [0.1, 0.2]).alias("sines")))


@query("flare_model", f"{LC} SELECT objectid, seq, round(CASE WHEN t < 60320 THEN m + 2 * exp(-((t - 60320) ^ 2) / (2 * 0.25)) WHEN t > 60320 THEN m + 2 * exp(-(t - 60320) / 1.5) ELSE 0 END, 6) AS model FROM lc")
def flare_model(s: SparkSession, d: str) -> DataFrame:
    return rounded(events(s, d).select("objectid", "seq", models.flare(F.col("t"), F.col("m"), F.lit(0.0), 2.0, 60320.0, 0.5, 1.5).alias("model")))


@query("transit_scalars", f"{ST} SELECT objectid, round(0.076 * 0.8 ^ (2.0 / 3) * jmag ^ (-2.0 / 3), 6) AS lo, round(0.076 * 1.2 ^ (2.0 / 3) * jmag ^ (-2.0 / 3), 6) AS hi, round(sqrt(nation + 1) * hmag / jmag, 6) AS snr, round(2.0 / 24 * sqrt((30 / 60.0 / 2.0) / 2) / jmag, 6) AS tmid FROM st")
def transit_scalars(s: SparkSession, d: str) -> DataFrame:
    lo, hi = models.transit_duration_range(F.col("jmag"), 0.8, 1.2)
    return rounded(stars(s, d).select("objectid", lo.alias("lo"), hi.alias("hi"), models.dip_snr((F.col("nation") + 1).cast("double"), F.col("hmag"), F.col("jmag")).alias("snr"), models.achievable_tmid_precision(F.col("jmag"), 30.0, 2.0).alias("tmid")))


@query("transit_epochs", f"{LC} SELECT objectid, seq, round((t - 60310.5) / 1.7)::BIGINT AS epoch FROM lc")
def transit_epochs(s: SparkSession, d: str) -> DataFrame:
    m = events(s, d).select("objectid", "seq", F.col("t").alias("tmid"), F.lit(0.1).alias("err"))
    return transits.epochs(m, 1.7, 60310.5).select("objectid", "seq", "epoch")


@query("distinct_periods", f"{ST}, p AS (SELECT nation AS objectid, jmag AS period, lag(jmag) OVER (PARTITION BY nation ORDER BY jmag) AS b FROM st), q AS (SELECT objectid, period FROM p WHERE period > 0 AND (b IS NULL OR period - b > 0.001 * b)) SELECT objectid, row_number() OVER (PARTITION BY objectid ORDER BY period)::INT AS rank, round(period, 6) AS period FROM q")
def distinct_periods(s: SparkSession, d: str) -> DataFrame:
    return rounded(selection.distinct_periods(stars(s, d).selectExpr("nation AS objectid", "jmag AS period")))


@query("update_documents", f"{ST}, o AS (SELECT objectid, jmag AS a, hmag AS b FROM st WHERE objectid % 2 = 0), n AS (SELECT objectid, CASE WHEN objectid % 3 = 0 THEN 1.0 END AS b, kmag AS c FROM st WHERE objectid % 5 < 4) SELECT objectid, round(o.a, 6) AS a, round(coalesce(n.b, o.b), 6) AS b, round(n.c, 6) AS c FROM o FULL JOIN n USING (objectid)")
def update_documents(s: SparkSession, d: str) -> DataFrame:
    c = stars(s, d)
    old = c.where("objectid % 2 = 0").selectExpr("objectid", "jmag AS a", "hmag AS b")
    new = c.where("objectid % 5 < 4").selectExpr("objectid", "CASE WHEN objectid % 3 = 0 THEN 1.0D END AS b", "kmag AS c")
    return rounded(catalog.update_documents(old, new))


@query("documents_assemble", None)
def documents_assemble(s: SparkSession, d: str) -> DataFrame:
    lc = events(s, d)
    peaks = periodograms.peaks(periodograms.gls(lc, periodograms.frequency_grids(lc)), best=3)
    binned = series.phase_bin(series.phase_fold(lc, 2.5), 0.1, 5)
    info = lc.groupBy("objectid").agg(F.count(F.lit(1)).alias("ndet"))
    return catalog.assemble(info, {"peaks": (peaks, ["rank"]), "phased": (binned, ["bin"])})


#: Least squares on 1, f and g with weights w, by Cramer's rule (from table fb: objectid, y, f, g, w).
CRAMER = "su AS (SELECT objectid, sum(w) AS a, sum(w * f) AS b, sum(w * g) AS c, sum(w * f * f) AS d, sum(w * f * g) AS e, sum(w * g * g) AS h, sum(w * y) AS p, sum(w * y * f) AS q, sum(w * y * g) AS r FROM fb GROUP BY 1), de AS (SELECT *, a * (d * h - e * e) - b * (b * h - e * c) + c * (b * e - d * c) AS det FROM su), co AS (SELECT objectid, (p * (d * h - e * e) - b * (q * h - e * r) + c * (q * e - d * r)) / det AS k0, (a * (q * h - e * r) - p * (b * h - e * c) + c * (b * r - q * c)) / det AS k1, (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det AS k2 FROM de)"
#: A clipped, folded series: phase, and median of the whole.
FIT = f"{LC}, {CLIP.format(a='lc', b='c5', cond='abs(m - med) < 5.0 * sg')}, ok AS (SELECT objectid, t, m, e, seq, count(*) OVER p AS n, median(m) OVER p AS med, (t - min(t) OVER p) / 2.5 AS x FROM c5 WHERE e <> 0 WINDOW p AS (PARTITION BY objectid)), fo AS (SELECT *, x - floor(x) AS p FROM ok WHERE n >= 10)"
SCORES = "SELECT objectid, '{model}' AS model, round(sum(((fit - m) / e) ^ 2), 3) AS chisq, {red} AS redchisq, count(*) AS n, round(median(abs(m - fit - mr)), 5) AS residual_mad FROM (SELECT *, median(m - fit) OVER (PARTITION BY objectid) AS mr FROM fi) GROUP BY 1"
RED = "round(sum(((fit - m) / e) ^ 2) / (count(*) - {free}), 5)"

FOURIER = f"{FIT}, fb AS (SELECT *, m - med AS y, cos(2 * pi() * p) AS f, sin(2 * pi() * p) AS g, 1 / (e * e) AS w FROM fo), {CRAMER}, fi AS (SELECT fb.*, med + k0 + k1 * f + k2 * g AS fit FROM fb JOIN co USING (objectid)) {SCORES.format(model='fourier', red=RED.format(free=4))}"
LEGENDRE = f"{FIT}, fb AS (SELECT *, m AS y, p AS f, p * p AS g, 1.0 AS w FROM fo), {CRAMER}, fi AS (SELECT fb.*, k0 + k1 * f + k2 * g AS fit FROM fb JOIN co USING (objectid)) {SCORES.format(model='legendre', red=RED.format(free=4))}"
#: Rows of the projection on quadratics over five points: of the first, second and middle point.
HAT = [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31]]
WRAPPED = f"{FIT}, li AS (SELECT objectid, list(m ORDER BY p, t, seq) AS v, list(e ORDER BY p, t, seq) AS es FROM fo GROUP BY 1), ix AS (SELECT objectid, v, es, unnest(range(len(v))) AS i FROM li), fi AS (SELECT objectid, v[i + 1] AS m, es[i + 1] AS e, list_sum(list_transform(range(-2, 3), lambda j: {HAT[2]}[j + 3] * v[1 + (i + j + len(v)) % len(v)])) / 35.0 AS fit FROM ix) {SCORES.format(model='savgol', red='-99.0::DOUBLE')}"


def _fit(model: str, **options: object):  # noqa: ANN202
    def run(s: SparkSession, d: str) -> DataFrame:
        found = fits.fit(series.sigclip(events(s, d), 5.0, nonzero_errors=False), model, 2.5, **options).select("objectid", "model", "chisq", "redchisq", "n", "residual_mad")
        return rounded(found, chisq=3, redchisq=5, residual_mad=5)

    return run


for _m, _o, _sql in (("fourier", {"order": 2}, FOURIER), ("spline", {"knot_fraction": 0.1}, None), ("savgol", {}, WRAPPED), ("legendre", {"degree": 2}, LEGENDRE), ("trapezoid", {}, None), ("eclipses", {}, None)):
    Q[f"fit_{_m}"] = (_fit(_m, **_o), _sql)


WHITE = f"{LC}, ok AS (SELECT objectid, t, m, e, seq, median(m) OVER p AS med, (t - min(t) OVER p) / 2.5 AS x FROM lc WHERE e <> 0 WINDOW p AS (PARTITION BY objectid)), fb AS (SELECT *, m - med AS y, cos(2 * pi() * (x - floor(x))) AS f, sin(2 * pi() * (x - floor(x))) AS g, 1 / (e * e) AS w FROM ok), {CRAMER} SELECT fb.objectid, seq, round(m - (k0 + k1 * f + k2 * g), 3) AS m FROM fb JOIN co ON co.objectid = fb.objectid"


@query("prewhiten", WHITE)
def prewhiten(s: SparkSession, d: str) -> DataFrame:
    return rounded(fits.prewhiten(events(s, d), 2.5, 2).select("objectid", "seq", "m"), 3)


#: Savitzky-Golay over five points with quadratics, the ends by the first and last window (table sg: objectid, seq, t, m, e, smooth).
SAVGOL = f"li AS (SELECT objectid, list(m ORDER BY t, seq) AS v, list(seq ORDER BY t, seq) AS q, list(t ORDER BY t, seq) AS ts, list(e ORDER BY t, seq) AS es FROM sr GROUP BY 1), ix AS (SELECT *, unnest(range(len(v))) AS i FROM li), aw AS (SELECT *, greatest(0, least(i - 2, len(v) - 5)) AS s FROM ix), sg AS (SELECT objectid, q[i + 1] AS seq, ts[i + 1] AS t, v[i + 1] AS m, es[i + 1] AS e, CASE WHEN len(v) < 5 THEN v[i + 1] ELSE list_sum(list_transform(range(5), lambda j: {HAT}[i - s + 1][j + 1] * v[s + j + 1])) / 35.0 END AS smooth FROM aw)"


@query("running_savgol", f"{LC}, sr AS (SELECT * FROM lc), {SAVGOL} SELECT objectid, seq, round(smooth, 5) AS smooth FROM sg")
def running_savgol(s: SparkSession, d: str) -> DataFrame:
    return rounded(trends.running_savgol(events(s, d), 5).select("objectid", "seq", "smooth"), 5)


@query("cdpp", f"WITH lc AS ({SUPPLIES_SQL}), sr AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY objectid) AS n0 FROM lc) WHERE n0 >= 15 AND e <> 0), {SAVGOL}, rs AS (SELECT objectid, t, m - smooth AS m, e, seq FROM sg), b AS ({BIN.format(v='t', w='20.0::DOUBLE', src='rs')}), g AS (SELECT objectid, bin, median(m) AS m FROM b WHERE abs(v - (lo + bin * 20.0::DOUBLE)) <= 10.0 GROUP BY ALL HAVING count(*) >= 7) SELECT objectid, round(1.168 * stddev_pop(m), 3) AS cdpp FROM g GROUP BY 1")
def cdpp(s: SparkSession, d: str) -> DataFrame:
    return rounded(trends.gilliland_cdpp(supplies(s, d), window=5, seconds=20 * 86400.0), 3)


@query("epd_line", f"{LC}, md AS (SELECT *, median(m) OVER (PARTITION BY objectid) AS med FROM lc), dv AS (SELECT *, 1.483 * median(abs(m - med)) OVER (PARTITION BY objectid) AS sg, sin(t) AS a FROM md), kp AS (SELECT objectid, a, median(m) OVER (PARTITION BY objectid ORDER BY t, seq ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS y FROM dv WHERE abs(m - med) < 3.0 * sg), rg AS (SELECT objectid, regr_slope(y, a) AS b, regr_intercept(y, a) AS c FROM kp GROUP BY 1 HAVING count(*) > 2) SELECT dv.objectid, seq, round(CASE WHEN b IS NULL THEN m ELSE med + m - (b * a + c) END, 5) AS m_epd FROM dv LEFT JOIN rg ON rg.objectid = dv.objectid")
def epd_line(s: SparkSession, d: str) -> DataFrame:
    """Decorrelation on one external column, of which SQL has the fit in closed form."""
    import numpy as np

    lc = events(s, d).withColumn("a", F.sin("t"))
    return rounded(trends.epd(lc, ("a",), terms=lambda a: np.stack([a, np.ones_like(a)], 1)).select("objectid", "seq", "m_epd"), 5)


@query("epd", None)
def epd(s: SparkSession, d: str) -> DataFrame:
    import numpy as np

    lc = events(s, d).withColumns({"a": F.sin("t"), "b": F.cos(F.col("t") * 2)})
    terms = lambda a, b: np.stack([a, b, a * a, a * b, b * b, np.ones_like(a)], 1)
    return trends.epd(lc, ("a", "b"), terms=terms).select("objectid", "seq", "m_epd")


@query("rf_epd", None)
def rf_epd(s: SparkSession, d: str) -> DataFrame:
    lc = events(s, d).withColumns({"a": F.sin("t"), "b": F.cos(F.col("t") * 2)})
    return trends.rf_epd(lc, ["a", "b"], trees=10, depth=5).select("objectid", "seq", "m_rfepd")


@query("tfa", None)
def tfa(s: SparkSession, d: str) -> DataFrame:
    lc = events(s, d)
    pos = lc.select("objectid").distinct().selectExpr("objectid", "(objectid * 137) % 360 + 0.25D AS ra", "(objectid * 53) % 180 - 89.75D AS decl")
    f = features.nonperiodic(lc, is_flux=True).select("objectid", F.col("median").alias("mag"), "mad", "eta_normal", "ndet")
    chosen = trends.tfa_templates(f, most=20, low=0.0, high=1e4, max_rms=1e4)
    return trends.tfa(lc, lc.join(F.broadcast(chosen), "objectid", "left_semi"), pos).select("objectid", "seq", "m_tfa")


def _simulated() -> str:
    kinds = simulate.KINDS
    sines = simulate.SINE_KINDS
    case = lambda of: "CASE kind " + " ".join(f"WHEN '{k}' THEN {of(k)}" for k in kinds if of(k)) + " END"
    cap = lambda name, ranges: case(lambda k: U(name, *ranges[k]) if k in ranges else None)
    n = lambda name, more="": f"sqrt(-2.0 * ln(1.0 - {U(name + '-a', 0.0, 1.0, 1, more)})) * cos(2 * pi() * {U(name + '-b', 0.0, 1.0, 1, more)})"
    cols = {
        "period": cap("period", {"planet": (0.1, 50.0), "eb": (0.2, 100.0)} | {k: v[0] for k, v in sines.items()}),
        "depth": cap("depth", {"planet": (1e-4, 0.0201), "eb": (1e-4, 0.7001)}),
        "duration": cap("duration", {"planet": (0.01, 0.30), "eb": (0.01, 0.45)}),
        "ratio": U("ratio", 0.01, 1.0), "secondary": f"0.5 + 0.1 * {n('secondary')}",
        "amplitude": cap("amplitude", {"flare": (0.01, 1.0)} | {k: v[2] for k, v in sines.items()}),
        "rise": U("rise", 0.007, 0.047), "decay": U("decay", 0.04, 0.203), "ingress_share": U("ingress", 0.05, 0.5),
        "peaks": f"[{', '.join(U(f'peak{i}', 0.0, 1.0) for i in range(4))}][1:floor({U('n', 1.0, 5.0)})::INT]",
        "ord": case(lambda k: f"floor({U('order', sines[k][1][0], sines[k][1][1] + 1)})" if k in sines else None),
        "shift": case(lambda k: f"{sines[k][3]}::DOUBLE" if k in sines else None), "onset": U("epoch", 0.0, 1.0),
    }
    bell = lambda d: f"exp(-({d}) * ({d}) / (2 * (duration / 5) * (duration / 5)))"
    near = "least(x, 1 - x)"
    variation = f"""CASE WHEN kind IS NULL THEN 0.0
      WHEN kind = 'planet' THEN depth * greatest(0, least(1, (duration / 2 - {near}) / (duration * ingress_share)))
      WHEN kind = 'eb' THEN depth * CASE WHEN abs(x - secondary) <= duration / 2 THEN ratio * {bell('x - secondary')} WHEN {near} <= duration / 2 THEN {bell(near)} ELSE 0 END
      WHEN kind = 'flare' THEN -amplitude * list_sum(list_transform(peaks, lambda q: CASE WHEN t < t0 + q * (t1 - t0) THEN exp(-((t - t0 - q * (t1 - t0)) ^ 2) / (2 * rise * rise)) ELSE exp(-(t - t0 - q * (t1 - t0)) / decay) END))
      ELSE amplitude * list_sum(list_transform(range(1, ord::BIGINT + 1), lambda i: sin(2 * pi() * i * x + (i + 1) * shift) / 2 ^ (i - 1))) END"""
    seq = " || '/' || seq"
    return f"""{LC}, few AS (SELECT objectid FROM (SELECT DISTINCT objectid FROM lc) ORDER BY {U('chosen', 0.0, 1.0)}, objectid LIMIT 60),
    ki AS (SELECT objectid, {kinds}[floor({U('kind', 1.0, len(kinds) + 1.0)})::INT] AS kind FROM few), pa AS (SELECT objectid, kind, {', '.join(f'{v} AS {k}' for k, v in cols.items())} FROM ki),
    a AS (SELECT *, min(t) OVER w AS t0, max(t) OVER w AS t1, median(m) OVER w AS mm, median(e) OVER w AS me FROM lc WINDOW w AS (PARTITION BY objectid)),
    b AS (SELECT *, median(abs(m - mm)) OVER (PARTITION BY objectid) AS dm, median(abs(e - me)) OVER (PARTITION BY objectid) AS de FROM a),
    c AS (SELECT b.objectid, b.t, b.seq, mm, me, dm, de, t0, t1, pa.* EXCLUDE (objectid), (t - t0 - onset * period) / period AS xx FROM b LEFT JOIN pa ON pa.objectid = b.objectid), d AS (SELECT *, xx - floor(xx) AS x FROM c)
    SELECT objectid, round(t, 6) AS t, round(mm + {variation} + {n('m', seq)} * 1.483 * dm, 5) AS m, round(me + {n('e', seq)} * 1.483 * de, 6) AS e, seq, kind FROM d"""


@query("simulate_variables", _simulated())
def simulate_variables(s: SparkSession, d: str) -> DataFrame:
    lc = events(s, d)
    return rounded(simulate.inject(lc, simulate.choose(lc.select("objectid").distinct(), 60)), m=5)


@query("classify_random_forest", None)
def classify_random_forest(s: SparkSession, d: str) -> DataFrame:
    f = stars(s, d).selectExpr("objectid", "jmag", "hmag", "kmag", "ra", "decl")
    labels = f.selectExpr("objectid", "CASE WHEN jmag > 11.5 THEN 1 ELSE 0 END AS label")
    v = selection.feature_vectors(f, ["jmag", "hmag", "kmag", "ra", "decl"], labels)
    model, _ = selection.train_classifier(v, folds=2, trees=(10,), depths=(3,))
    return selection.classify(model, v)


@query("light_time", f"{ST}, j AS (SELECT objectid, ra, decl, 2460310.5 + (objectid % 366)::DOUBLE AS jd FROM st), k AS (SELECT *, jd - 2451545.0 AS n FROM j), g AS (SELECT *, radians(357.528 + 0.9856003 * n) AS g, radians(23.439 - 0.0000004 * n) AS ep FROM k), l AS (SELECT *, radians(280.460 + 0.9856474 * n + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS lon, 1.00014 - 0.01671 * cos(g) - 0.00014 * cos(2 * g) AS r FROM g) SELECT objectid, round(-r * (cos(lon) * cos(radians(decl)) * cos(radians(ra)) + cos(ep) * sin(lon) * cos(radians(decl)) * sin(radians(ra)) + sin(ep) * sin(lon) * sin(radians(decl))) * 499.004784, 4) AS seconds FROM l")
def light_time(s: SparkSession, d: str) -> DataFrame:
    jd = 2460310.5 + (F.col("objectid") % 366).cast("double")
    return rounded(stars(s, d).select("objectid", (times.light_delay(jd, F.col("ra"), F.col("decl")) * 86400.0).alias("seconds")), 4)


@query("external_catalog", f"{ST} SELECT objectid AS id, ra, round(jmag, 6) AS jmag FROM st")
def external_catalog(s: SparkSession, d: str) -> DataFrame:
    head = '# {"colsep": "|", "columns": [{"key": "id", "name": "id", "dtype": "i8", "unit": ""},\n# {"key": "name", "name": "name", "dtype": "U20", "unit": ""}, {"key": "ra", "name": "ra", "dtype": "f8", "unit": "deg"},\n# {"key": "jmag", "name": "J", "dtype": "f8", "unit": "mag"}]}'
    lines = stars(s, d).select(F.concat_ws("|", "objectid", F.lit("a, b"), "ra", "jmag").alias("value"))
    comment = s.createDataFrame([(x,) for x in head.split("\n")], "value string")
    return rounded(readers.catalog_columns(comment.unionAll(lines), readers.catalog_header(head), ["id", "ra", "jmag", "none"]))


UNIFORM = "CASE WHEN z >= 1.1 THEN 1.0 WHEN z <= 0.9 THEN 1 - 0.01 ELSE 1 - (0.01 * acos((0.01 + z * z - 1) / (0.2 * z)) + acos((1 - 0.01 + z * z) / (2 * z)) - sqrt(greatest(0, 4 * z * z - (1 + z * z - 0.01) ^ 2)) / 2) / pi() END"


@query("transit_model", f"{LC}, a AS (SELECT objectid, seq, 2 * pi() * (t - 60310.5) / 3.3 AS f FROM lc), b AS (SELECT objectid, seq, cos(f) > 0 AS front, 8.0 * sqrt(sin(f) ^ 2 + (0.3 / 8.0) ^ 2 * cos(f) ^ 2) AS z FROM a) SELECT objectid, seq, round(CASE WHEN front THEN {UNIFORM} ELSE 1 END, 6) AS flux FROM b")
def transit_model(s: SparkSession, d: str) -> DataFrame:
    """A star without limb darkening, of which the SQL has the closed form."""
    return rounded(trends.per_object(events(s, d).select("objectid", "t", "seq"), lambda p: p.assign(flux=transit_fits.transit_model(p["t"].to_numpy(float), 60310.5, 3.3, 0.1, 8.0, 0.3)), "flux double").select("objectid", "seq", "flux"))


@query("fit_mandelagol")
def fit_mandelagol(s: SparkSession, d: str) -> DataFrame:
    """Transits put on the events' times, and fitted with a line and a short chain."""
    lc = events(s, d).withColumns({"e": F.lit(0.0005)})
    made = trends.per_object(lc.select("objectid", "t", "m", "e", "seq"), lambda p: p.assign(m=transit_fits.transit_model(p["t"].to_numpy(float), 60310.9, 1.7, 0.1, 5.0, 0.2, (0.3, 0.2)) * (1 + 1e-4 * (p["t"].to_numpy(float) - 60310.9)))).select("objectid", "t", "m", "e", "seq")
    at = lc.select("objectid").distinct().selectExpr("objectid", "1.7D AS period", "60310.88D AS t0")
    return transit_fits.fit_transits(made, at, line=True, steps=100, starts=1)


@query("detrend_centroids", f"{LC}, c AS (SELECT objectid, t, seq, sin(t) + 0.01 * t AS x, cos(t) AS y, seq % 2 AS quality FROM lc), ok AS (SELECT * FROM c WHERE quality = 0), m1 AS (SELECT *, median(x) OVER w AS mx, median(y) OVER w AS my FROM ok WINDOW w AS (PARTITION BY objectid)), m2 AS (SELECT *, 1.483 * median(abs(x - mx)) OVER w AS sx, 1.483 * median(abs(y - my)) OVER w AS sy FROM m1 WINDOW w AS (PARTITION BY objectid)), k AS (SELECT objectid, t, seq, x, y FROM m2 WHERE abs(x - mx) < 30 * sx AND abs(y - my) < 30 * sy), g AS (SELECT *, sum(CASE WHEN t - pt > 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY objectid ORDER BY t, seq) AS tg FROM (SELECT *, lag(t) OVER (PARTITION BY objectid ORDER BY t, seq) AS pt FROM k)), i1 AS (SELECT * FROM (SELECT *, min(t) OVER w AS lo, max(t) OVER w AS hi FROM g WINDOW w AS (PARTITION BY objectid, tg)) WHERE t > lo + 2.0::DOUBLE AND t < hi - 2.0::DOUBLE), i2 AS (SELECT objectid, t, seq, x, y FROM (SELECT * EXCLUDE (lo, hi), min(t) OVER w AS lo, max(t) OVER w AS hi FROM i1 WINDOW w AS (PARTITION BY objectid)) WHERE t > lo + 2.0::DOUBLE AND t < hi - 2.0::DOUBLE), r AS (SELECT objectid, count(*) AS n, regr_slope(x, t) AS bx, regr_intercept(x, t) AS ax, regr_slope(y, t) AS by_, regr_intercept(y, t) AS ay, avg(x) AS mx, avg(y) AS my FROM i2 GROUP BY 1) SELECT i2.objectid, seq, round(CASE WHEN n > 1 THEN x - (ax + bx * t) ELSE x - mx END, 5) AS dx, round(CASE WHEN n > 1 THEN y - (ay + by_ * t) ELSE y - my END, 5) AS dy FROM i2 JOIN r USING (objectid)")
def detrend_centroids(s: SparkSession, d: str) -> DataFrame:
    """Lines instead of higher degrees, of which SQL has the fit in closed form."""
    lc = events(s, d).selectExpr("objectid", "t", "seq", "sin(t) + 0.01D * t AS x", "cos(t) AS y", "seq % 2 AS quality")
    return rounded(trends.detrend_centroids(lc, 2.0, degree=1).select("objectid", "seq", "dx", "dy"), 5)


@query("star_features", f"{ST}, r AS (SELECT objectid, {_ROW(0)} AS x, {_ROW(1)} AS y, {_ROW(2)} AS z FROM st), ga AS (SELECT objectid, round((degrees(atan2(y, x)) + 360) % 360, 6) AS gl, round(degrees(asin(z)), 6) AS gb FROM r), c1 AS (SELECT objectid, jmag AS j, hmag AS h, kmag AS k, {MAGS} FROM st), c2 AS (SELECT *, {INDEX} FROM c1), c3 AS (SELECT *, {SUBTYPE} AS m_class FROM c2), m AS (SELECT a.objectid, b.objectid AS n, {TWO} AS dist FROM st a JOIN st b ON abs(a.decl - b.decl) < 3 AND {TWO} < 7200 WHERE {TWO} > 0), nb AS (SELECT a.objectid, count(m.n) AS n_neighbors, round(min(m.dist), 3) AS closest_arcsec FROM st a LEFT JOIN m ON a.objectid = m.objectid GROUP BY 1) SELECT objectid, gl, gb, round(v_color, 6) AS v_color, m_class, n_neighbors, closest_arcsec FROM ga JOIN c3 USING (objectid) JOIN nb USING (objectid)")
def star_features(s: SparkSession, d: str) -> DataFrame:
    j, h, k = F.col("jmag"), F.col("hmag"), F.col("kmag")
    bands = {x: photometry.from_jhk(b, j, h, k) + (F.col("objectid") % p) * 0.05 for b, x, p in (("sdssu", "u", 47), ("sdssg", "g", 31), ("sdssr", "r", 17), ("sdssi", "i", 13), ("sdssz", "z", 7))}
    f = periodic.star_features(stars(s, d), 7200.0, bands)
    return rounded(f.select("objectid", "gl", "gb", "v_color", "m_class", "n_neighbors", "closest_arcsec"), closest_arcsec=3)


def _searched(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    lc = events(s, d)
    grids = periodograms.frequency_grids(lc)
    gls, win = periodograms.gls(lc, grids), periodograms.spectral_window(lc, grids)
    peaks = periodograms.peaks(gls, best=3).select("objectid", F.lit("gls").alias("method"), "rank", "period", F.col("power").alias("score"))
    return lc, peaks, gls.select("objectid", F.lit("gls").alias("method"), F.col("power").alias("score")), win


WIN = "gx AS (SELECT objectid, t - min(t) OVER (PARTITION BY objectid) AS x FROM lc), wa AS (SELECT gx.objectid, k, freq, count(*) AS n, sum(cos(2 * pi() * freq * x)) AS c1, sum(sin(2 * pi() * freq * x)) AS s1, sum(cos(4 * pi() * freq * x)) AS c2, sum(sin(4 * pi() * freq * x)) AS s2 FROM gx JOIN f ON gx.objectid = f.objectid GROUP BY ALL), wb AS (SELECT *, atan(s2 / c2) / 2 AS th FROM wa), wi AS (SELECT objectid, freq, 0.5 * ((c1 * cos(th) + s1 * sin(th)) ^ 2 / (n / 2 + (c2 * cos(2 * th) + s2 * sin(2 * th)) / 2) + (s1 * cos(th) - c1 * sin(th)) ^ 2 / (n / 2 - (c2 * cos(2 * th) + s2 * sin(2 * th)) / 2)) AS power FROM wb)"


@query("periodogram_features", f"{REC}, {GLS}, sc AS (SELECT objectid, k, freq, -power AS v FROM gls), {WALK.format(best=3)}, {WIN}, sp AS (SELECT objectid, max(power) - min(power) AS span FROM gls GROUP BY 1), wo AS (SELECT objectid, max(power) - min(power) AS own FROM wi GROUP BY 1), wn AS (SELECT wi.objectid, 1 / freq AS p, power / own AS w FROM wi JOIN wo ON wo.objectid = wi.objectid), at_ AS (SELECT pk.objectid, rank, avg(w) AS mean FROM pk JOIN wn ON wn.objectid = pk.objectid AND abs(p - period) < 0.0001 GROUP BY ALL), rt AS (SELECT pk.objectid, pk.rank, period, (-v / span) / mean AS ratio FROM pk JOIN sp ON sp.objectid = pk.objectid LEFT JOIN at_ ON at_.objectid = pk.objectid AND at_.rank = pk.rank), pr AS (SELECT a.objectid, count(*) AS n, count(*) FILTER (abs(a.period - b.period) < 0.0001) AS c FROM pk a JOIN pk b ON a.objectid = b.objectid AND a.rank < b.rank GROUP BY 1) SELECT rt.objectid, count(*) FILTER (ratio > 5.0) AS n_abovesampling, count(*) FILTER ((period - 1.0027379) / period < 0.0001 OR (period - 0.9972696) / period < 0.0001) AS n_sidereal, count(*) FILTER (abs(period - 1.0027379) / period < 0.0001 OR abs(period - 0.9972696) / period < 0.0001) AS n_near_sidereal, coalesce(any_value(pr.n), 0) AS n_pairs, coalesce(any_value(c), 0) AS n_close_pairs FROM rt LEFT JOIN pr ON pr.objectid = rt.objectid GROUP BY rt.objectid")
def periodogram_features(s: SparkSession, d: str) -> DataFrame:
    _, peaks, scores, window = _searched(s, d)
    return periodic.periodogram_features(peaks, scores, window)


@query("periodic_features")
def periodic_features(s: SparkSession, d: str) -> DataFrame:
    """All features of every object at its best period."""
    lc = events(s, d)
    return periodic.periodic_features(lc, periodic.searched_features(lc, periodograms.frequency_grids(lc)))
