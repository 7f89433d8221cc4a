"""Smoothing and detrending: running filters, external parameter decorrelation and trend filtering."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fits import savgol
from .series import KEY, MAD_STD, by_time, finite, finite_filter, timegroups, whole

#: Bytes of a template matrix that may go to every task.
TEMPLATE_BYTES = 256 << 20


def running_median(lc: DataFrame, window: int = 5, out: str = "smooth", edges: str = "reflect") -> DataFrame:
    """Adds the median of ``window`` points around each.

    Beyond the ends the series is reflected ("reflect": its end point comes twice), zero ("zero"), or the window shrinks
    ("shrink"). Series shorter than half a window shrink it, too.
    """
    h = window // 2
    lc = lc.withColumns({"_near": F.collect_list("m").over(by_time().rowsBetween(-h, h)), "_i": F.row_number().over(by_time()), "_n": F.count(F.lit(1)).over(whole())})
    left, right = F.greatest(F.lit(0), h + 1 - F.col("_i")), F.greatest(F.lit(0), h - F.col("_n") + F.col("_i")).cast("int")
    if edges == "reflect":
        near = F.concat("_near", F.slice("_near", F.lit(1), left), F.slice(F.reverse("_near"), F.lit(1), right))
    elif edges == "zero":
        near = F.concat("_near", F.array_repeat(F.lit(0.0), (left + right).cast("int")))
    else:
        near = F.col("_near")
    lc = lc.withColumn("_near", F.sort_array(near))
    at = lambda i: F.element_at("_near", i.cast("int"))
    return lc.withColumn(out, (at(F.floor((F.size("_near") + 1) / 2)) + at(F.floor(F.size("_near") / 2) + 1)) / 2).drop("_near", "_i", "_n")


def running_gauss(lc: DataFrame, window: int = 5, sigma: float = 3.0, out: str = "smooth") -> DataFrame:
    """Adds the Gaussian-weighted mean of ``window`` points; beyond the ends the end points repeat."""
    h = window // 2
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-h, h + 1)]
    first, last = F.first("m").over(by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("m").over(by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    terms = [w * F.coalesce((F.lag("m", -i) if i < 0 else F.lead("m", i)).over(by_time()), first if i < 0 else last) if i else w * F.col("m") for i, w in zip(range(-h, h + 1), weights, strict=True)]
    return lc.withColumn(out, sum(terms[1:], terms[0]) / sum(weights))


def per_object(lc: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], extra: str = "") -> DataFrame:
    """``f`` over each object's rows in order of time; ``extra`` names the columns it adds."""
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in lc.schema.fields)
    return lc.groupBy(KEY).applyInPandas(lambda p: f(p.sort_values(["t", "seq"])), schema + (f", {extra}" if extra else ""))


def running_savgol(lc: DataFrame, window: int = 11, degree: int = 2) -> DataFrame:
    """Adds ``smooth``; series shorter than the window keep their values."""
    return per_object(lc, lambda p: p.assign(smooth=savgol(p["m"].to_numpy(float), window, degree) if len(p) >= window else p["m"]), "smooth double")


def gilliland_cdpp(lc: DataFrame, window: int = 97, degree: int = 2, seconds: float = 23400.0, least: int = 7) -> DataFrame:
    """(objectid, cdpp): 1.168 times the scatter of the residuals in 6.5 hour bins; needs three windows of points."""
    from .series import time_bin

    enough = lc.withColumn("_n", F.count(F.lit(1)).over(whole())).where(F.col("_n") >= 3 * window).drop("_n")
    flat = running_savgol(finite_filter(enough), window, degree).withColumn("m", F.col("m") - F.col("smooth")).drop("smooth")
    return time_bin(flat, seconds, least).groupBy(KEY).agg((1.168 * F.stddev_pop("m")).alias("cdpp"))


def epd_terms(s: np.ndarray, d: np.ndarray, k: np.ndarray, x: np.ndarray, y: np.ndarray, bg: np.ndarray, bge: np.ndarray, ha: np.ndarray, zd: np.ndarray) -> np.ndarray:
    """The 22 terms of the decorrelation: shape S, D, K, centroid x, y, background and its error, hour angle, zenith distance."""
    w = 2 * np.pi
    return np.stack([s * s, s, d * d, d, k * k, k, np.ones_like(s), s * d, s * k, d * k, np.sin(w * x), np.cos(w * x), np.sin(w * y), np.cos(w * y), np.sin(2 * w * x), np.cos(2 * w * x), np.sin(2 * w * y), np.cos(2 * w * y), bg, bge, ha, zd], 1)


def epd(lc: DataFrame, names: tuple[str, ...] = ("fsv", "fdv", "fkv", "xcc", "ycc", "bgv", "bge", "iha", "izd"), sigma: float = 3.0, window: int = 21, terms: Callable[..., np.ndarray] = epd_terms) -> DataFrame:
    """Adds ``m_epd``: median + m - fit, the fit linear in ``terms`` of the external columns, made on smoothed clipped points."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        m = p["m"].to_numpy(float)
        med = np.median(m)
        keep = np.abs(m - med) < sigma * MAD_STD * np.median(np.abs(m - med))
        a = terms(*(p[c].to_numpy(float) for c in names))
        if keep.sum() <= a.shape[1]:
            return p.assign(m_epd=m)
        h = window // 2
        smooth = pd.Series(m[keep]).rolling(2 * h + 1, center=True, min_periods=1).median().to_numpy()
        c, *_ = np.linalg.lstsq(a[keep], smooth, rcond=None)
        return p.assign(m_epd=med + m - a @ c)

    return per_object(finite_filter(lc, nonzero_errors=False), run, "m_epd double")


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, tried: int, depth: int, least: int) -> tuple | float:
    """A regression tree: (feature, threshold, left, right), or the mean of a leaf. Splits lower the sum of squares most."""
    if depth == 0 or len(y) < 2 * least or np.ptp(y) == 0:
        return float(y.mean())
    best = (0.0, -1, 0.0)
    for f in rng.choice(x.shape[1], min(tried, x.shape[1]), replace=False).tolist():
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        gain = s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(y) - n) - s[-1] ** 2 / len(y)
        gain[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = 0.0
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], f, 0.5 * (v[i] + v[i + 1]))
    if best[1] < 0:
        return float(y.mean())
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], rng, tried, depth - 1, least), grow(x[~left], y[~left], rng, tried, depth - 1, least)


def predict(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    left, out = x[:, tree[0]] <= tree[1], np.empty(len(x))
    out[left], out[~left] = predict(tree[2], x[left]), predict(tree[3], x[~left])
    return out


def rf_epd(lc: DataFrame, names: list[str], trees: int = 100, depth: int = 8, least: int = 5, sigma: float = 3.0, window: int = 21, seed: int = 5) -> DataFrame:
    """Adds ``m_rfepd``: median + m - prediction of a random forest of the external columns, one for each object.

    As in epd() the forest learns smoothed, clipped points. Trees are grown on points drawn with replacement, from a third
    of the columns at each split; draws follow from the seed, so reruns agree.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        m, x = p["m"].to_numpy(float), p[names].to_numpy(float)
        med = np.median(m)
        keep = (np.abs(m - med) < sigma * MAD_STD * np.median(np.abs(m - med))) & np.isfinite(x).all(1)
        if keep.sum() < 2 * least:
            return p.assign(m_rfepd=m)
        y = pd.Series(m[keep]).rolling(window | 1, center=True, min_periods=1).median().to_numpy()
        rng, fit = np.random.default_rng(seed), np.zeros(len(m))
        for _ in range(trees):
            i = rng.integers(0, len(y), len(y))
            fit += predict(grow(x[keep][i], y[i], rng, max(1, len(names) // 3), depth, least), np.nan_to_num(x)) / trees
        return p.assign(m_rfepd=med + m - fit)

    return per_object(finite_filter(lc, nonzero_errors=False), run, "m_rfepd double")


#: Legendre degrees of a centroid fit by numbers of points; between them the degree is interpolated.
CENTROID_DEGREES = ([1e2, 3e2, 5e2, 1e3, 3e3], [4, 5, 6, 10, 15])


def centroid_degree(points: int) -> int:
    return int(math.floor(np.interp(points, *CENTROID_DEGREES)))


def detrend_centroids(lc: DataFrame, gap: float = 0.5, sigma: float = 30.0, degree: int | None = None) -> DataFrame:
    """(objectid, t, seq, x, y, dx, dy) of ``lc`` (objectid, t, seq, x, y, quality): centroids less a Legendre fit over time.

    Points of quality zero that are finite and within sigma deviations in both coordinates are cut into groups by ``gap``
    days; those within ``gap`` of a group's ends, and again of the series' ends, go. The degree follows from their number,
    unless given.
    """
    ok = lc.where("quality = 0" if "quality" in lc.columns else "true").where(finite("t") & finite("x") & finite("y")).select(KEY, "t", "seq", "x", "y")
    for c in ("x", "y"):
        ok = ok.withColumn(f"_m{c}", F.median(c).over(whole()))
    for c in ("x", "y"):
        ok = ok.withColumn(f"_s{c}", MAD_STD * F.median(F.abs(F.col(c) - F.col(f"_m{c}"))).over(whole()))
    ok = ok.where(" AND ".join(f"abs({c} - _m{c}) < {sigma} * _s{c}" for c in ("x", "y")))
    groups = Window.partitionBy(KEY, "tgroup")
    inner = timegroups(ok, gap).withColumns({"_lo": F.min("t").over(groups), "_hi": F.max("t").over(groups)}).where((F.col("t") > F.col("_lo") + gap) & (F.col("t") < F.col("_hi") - gap))
    inner = inner.withColumns({"_lo": F.min("t").over(whole()), "_hi": F.max("t").over(whole())}).where((F.col("t") > F.col("_lo") + gap) & (F.col("t") < F.col("_hi") - gap))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        t, n = p["t"].to_numpy(float), len(p)
        k = centroid_degree(n) if degree is None else degree
        out = {}
        for c in ("x", "y"):
            v = p[c].to_numpy(float)
            out[f"d{c}"] = v - (np.polynomial.Legendre.fit(t, v, k)(t) if n > k and np.ptp(t) > 0 else v.mean())
        return p.assign(**out)

    return per_object(inner.select(KEY, "t", "seq", "x", "y"), run, "dx double, dy double")


def centroid_offsets(lc: DataFrame, transits: DataFrame, duration: float, buffer: float = 0.1, factor: float = 3.0, arcsec: float = 3.98) -> DataFrame:
    """(objectid, transit, dx_in, dy_in, dx_out, dy_out): mean centroid residuals inside and beside each transit.

    ``transits``: (objectid, transit, start, end). A range join on the few transits of an object.
    """
    t = F.col("t")
    near = (t > F.col("start") - buffer - factor * duration) & (t < F.col("end") + buffer + factor * duration)
    j = lc.join(transits, KEY).where(near)
    inside, outside = (t > F.col("start")) & (t < F.col("end")), (t < F.col("start") - buffer) | (t > F.col("end") + buffer)
    mean = lambda c, w: (F.avg(F.when(w, F.col(c))) * arcsec)
    return j.groupBy(KEY, "transit").agg(mean("dx", inside).alias("dx_in"), mean("dy", inside).alias("dy_in"), mean("dx", outside).alias("dx_out"), mean("dy", outside).alias("dy_out"))


def tfa_templates(features: DataFrame, most: int = 200, low: float = 8.0, high: float = 12.0, max_rms: float = 0.15, sigma: float = 5.0, seed: int = 11) -> DataFrame:
    """(objectid) of template candidates from ``features`` (objectid, mag, mad, eta_normal, ndet).

    Magnitude limits, 1.4826 MAD under ``max_rms``, MAD and 1 / eta under sigma times quadratic fits over magnitude,
    and at least the median number of points; then ``most`` of them by a hash. The fits are sums of powers.
    """
    c = features.where(F.col("mag").between(low, high) & (1.4826 * F.col("mad") < max_rms) & (F.col("mad") > 0) & (F.col("eta_normal") > 0))
    x = F.col("mag") - (low + high) / 2
    sums = c.agg(*[F.sum(F.pow(x, F.lit(float(i)))).alias(f"x{i}") for i in range(5)], *[F.sum(F.pow(x, F.lit(float(i))) * F.log10(y)).alias(f"{y}{i}") for y in ("mad", "eta_normal") for i in range(3)], F.median("ndet").alias("nd")).first()
    if not sums["x0"]:
        return c.select(KEY)
    a = np.array([[sums[f"x{i + j}"] for j in range(3)] for i in range(3)])
    fit = {y: np.linalg.pinv(a) @ np.array([sums[f"{y}{i}"] for i in range(3)]) for y in ("mad", "eta_normal")}
    poly = lambda k: F.pow(F.lit(10.0), sum(float(b) * F.pow(x, F.lit(float(i))) for i, b in enumerate(fit[k])))
    good = c.where((F.col("mad") / poly("mad") < sigma) & (poly("eta_normal") / F.col("eta_normal") < sigma) & (F.col("ndet") >= sums["nd"]))
    return good.orderBy(F.xxhash64(KEY, F.lit(seed)), KEY).limit(most).select(KEY)


def tfa(lc: DataFrame, templates: DataFrame, catalog: DataFrame, exclude_arcmin: float = 10.0) -> DataFrame:
    """Adds ``m_tfa``: the series less its projection on template series, sampled at its times.

    ``templates``: points of template objects; ``catalog``: (objectid, ra, decl). A template is not used for itself or
    for objects within ``exclude_arcmin``. Templates are a chosen number of series, so they go to every task; Spark counts
    their points first.
    """
    if 16 * templates.count() > TEMPLATE_BYTES:
        raise ValueError("too many template points; choose fewer templates")
    rows = templates.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("t", "m"))).alias("a")).join(catalog, KEY).select(KEY, "ra", "decl", "a").orderBy(KEY).collect()
    series = [(r[KEY], r["ra"], r["decl"], np.array([x["t"] for x in r["a"]]), np.array([x["m"] for x in r["a"]])) for r in rows]
    shared = lc.sparkSession.sparkContext.broadcast([(k, r, d, t, m - np.median(m)) for k, r, d, t, m in series if len(t)])
    limit = math.radians(exclude_arcmin / 60)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        t, m = p["t"].to_numpy(float), p["m"].to_numpy(float)
        me, ra, de = p[KEY].iloc[0], math.radians(p["ra"].iloc[0]), math.radians(p["decl"].iloc[0])
        use = []
        for k, r, d, tt, tm in shared.value:
            r, d = math.radians(r), math.radians(d)
            a = math.sin((d - de) / 2) ** 2 + math.cos(d) * math.cos(de) * math.sin((r - ra) / 2) ** 2
            if k != me and 2 * math.asin(min(1.0, math.sqrt(a))) > limit:
                use.append(np.interp(t, tt, tm))
        if not use or len(t) < 10:
            return p.assign(m_tfa=m)
        x = np.stack(use)
        c = np.linalg.pinv(x @ x.T) @ (x @ (m - np.median(m)))
        return p.assign(m_tfa=m - x.T @ c)

    return per_object(lc.join(catalog.select(KEY, "ra", "decl"), KEY), run, "m_tfa double").drop("ra", "decl")


def find_flares(lc: DataFrame, sigma: float = 4.0, window: int = 5) -> DataFrame:
    """(objectid, flare, n, start, end, peak): runs of points brighter than a running median by sigma deviations.

    An extension: the grouping is by gaps and islands over the flagged points.
    """
    s = running_median(lc, window, edges="shrink").withColumn("r", F.col("m") - F.col("smooth")).withColumn("i", F.row_number().over(by_time()))
    s = s.withColumn("d", MAD_STD * F.median(F.abs(F.col("r"))).over(whole())).where((F.col("d") > 0) & (F.abs(F.col("r")) > sigma * F.col("d")))
    s = s.withColumn("g", F.col("i") - F.row_number().over(by_time()))
    runs = s.groupBy(KEY, "g").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start"), F.max("t").alias("end"), F.max(F.abs("r")).alias("peak"))
    return runs.select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("start")).alias("flare"), "n", "start", "end", "peak")
