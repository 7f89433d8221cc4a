"""Features of each object's series, by grouped aggregates. Objects need more than nine points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY, MAD_STD, by_time, finite_filter, whole

#: Percentiles that are reported.
PERCENTILES = [5.0, 10.0, 17.5, 25.0, 32.5, 40.0, 60.0, 67.5, 75.0, 82.5, 90.0, 95.0]
LEAST = 10


Aggregates = dict[str, Column]


def divided(a: Column, b: Column) -> Column:
    """a / b, infinite or NaN where b is zero."""
    return F.when(b != 0, F.try_divide(a, b)).when(F.isnan(a) | (a == 0), float("nan")).otherwise(F.signum(a) * float("inf"))


def frame(lc: DataFrame, is_flux: bool = False, weight_by_time: bool = True, nonzero_errors: bool = True) -> DataFrame:
    """The finite points, with ``nonzero_errors`` those whose error is not zero, with what the features sum: window columns over the object, all from one shuffle by object.

    Point-to-point measures leave out the last point of a series and those with no time to the next (``on`` is false);
    their neighbours are those that stay. Columns that a feature does not use are pruned from its plan.
    """
    stay = Window.partitionBy(KEY, "on")
    lc = finite_filter(lc, nonzero_errors).withColumns({
        "n": F.count(F.lit(1)).over(whole()), "med": F.median("m").over(whole()), "x": F.col("t") - F.min("t").over(whole()),
        "dt": F.col("t") - F.lag("t").over(by_time()), "on": F.coalesce(F.lead("t").over(by_time()) - F.col("t") != 0, F.lit(False)),
        "f": F.col("m") if is_flux else F.pow(F.lit(10.0), -0.4 * F.col("m")),
    })
    lc = lc.withColumns({"ad": F.abs(F.col("m") - F.col("med")), "s": F.try_divide(F.col("n"), F.col("n") - 1) * divided(F.col("m") - F.col("med"), F.col("e")), "step": F.median("dt").over(whole())})
    lc = lc.withColumns({"mad": F.median("ad").over(whole()), "before": F.lag("s").over(by_time())})
    near = stay.orderBy("t", "seq")
    lc = lc.withColumns({"pt": F.col("t") - F.lag("t").over(near), "pm": F.col("m") - F.lag("m").over(near), "pmed": F.median("m").over(stay)})
    w = F.exp(F.try_divide(-F.col("dt"), F.col("step"))) if weight_by_time else F.lit(1.0)
    return lc.withColumn("p", w * F.col("s") * F.col("before"))


def _stetson() -> Aggregates:
    return {"j": F.sum(F.signum("p") * F.sqrt(F.abs("p"))), "a": F.sum(F.abs("s")), "q": F.sum(F.col("s") * F.col("s"))}


def _stetson_out() -> dict[str, Column]:
    n = F.col("ndet")
    return {"stetson_j": F.col("j") / n, "stetson_k": F.try_divide(F.col("a") / F.sqrt(n.cast("double")), F.sqrt("q"))}


def _moments() -> Aggregates:
    e2 = F.col("e") * F.col("e")
    return {
        "median": F.min("med"), "wmean": F.sum(divided(F.col("m"), e2)) / F.sum(divided(F.lit(1.0), e2)), "mad_": F.min("mad"), "skew": F.skewness("m"), "kurtosis": F.kurtosis("m"),
        "beyond1std": F.count_if(F.col("ad") > MAD_STD * F.col("mad")) / F.count(F.lit(1)), "mag_percentiles": F.percentile("m", F.array(*[F.lit(p / 100) for p in PERCENTILES])),
    }


def _moments_out() -> dict[str, Column]:
    own = {c: F.col(c) for c in ("median", "wmean")} | {"mad": F.col("mad_")} | {c: F.col(c) for c in ("skew", "kurtosis", "beyond1std", "mag_percentiles")}
    return own | {"stdev": MAD_STD * F.col("mad_"), "mag_iqr": F.col("mag_percentiles")[8] - F.col("mag_percentiles")[3]}


def _flux() -> Aggregates:
    return {"fmed": F.median("f"), "top": F.max(F.abs("f")), "fp": F.percentile("f", F.array(*[F.lit(p / 100) for p in PERCENTILES]))}


def _flux_out() -> dict[str, Column]:
    span = lambda a, b: F.col("fp")[b] - F.col("fp")[a]
    wide = span(0, 11)
    ratios = {"mid20": span(5, 6), "mid35": span(4, 7), "mid50": span(3, 8), "mid65": span(2, 9), "mid80": span(1, 10)}
    return {"flux_median": F.col("fmed"), "flux_percent_amplitude": F.try_divide("top", "fmed"), "flux_percentiles": F.col("fp")} | {f"flux_percentile_ratio_{k}": F.try_divide(v, wide) for k, v in ratios.items()} | {"percent_difference_flux_percentile": F.try_divide(wide, F.col("fmed"))}


def _ptp() -> Aggregates:
    kept = lambda c: F.when(F.col("on"), c)
    w = kept(1.0 / (F.col("pt") * F.col("pt")))
    pm = kept(F.col("pm"))
    return {
        "pn": F.count_if("on"), "pad": F.median(F.abs(pm)), "psq": F.sum(pm * pm), "pvar": F.var_pop(kept(F.col("m"))), "pmad": F.median(kept(F.abs(F.col("m") - F.col("pmed")))),
        "w": F.sum(w), "wavg": F.avg(w), "wmed": F.median(w), "wsq": F.sum(w * pm * pm), "wad": F.sum(w * F.abs(pm)), "pspan": F.max(kept(F.col("t"))) - F.min(kept(F.col("t"))),
    }


def _ptp_out() -> dict[str, Column]:
    rv, span2 = F.pow(MAD_STD * F.col("pmad"), 2), F.col("pspan") * F.col("pspan")
    return {
        "eta_normal": F.try_divide(F.try_divide("psq", "pvar"), F.col("pn") - 1.0), "eta_robust": F.try_divide(F.try_divide(F.col("pad"), rv), F.col("pn") - 1.0),
        "eta_uneven_normal": F.try_divide(F.col("wsq"), F.col("pvar") * F.col("w")) * F.col("wavg") * span2, "eta_uneven_robust": F.try_divide(F.col("wad"), rv * F.col("w")) * F.col("wmed") * span2,
    }


def _series() -> Aggregates:
    w, x, m = F.pow("e", F.lit(-4.0)), F.col("x"), F.col("m")
    return {"mintime": F.min("t"), "maxtime": F.max("t"), "hi": F.max("m"), "lo": F.min("m"), "smed": F.min("med"), "sw": F.sum(w), "wx": F.sum(w * x), "wy": F.sum(w * m), "wxx": F.sum(w * x * x), "wxy": F.sum(w * x * m)}


def _series_out() -> dict[str, Column]:
    w = F.col("sw")
    slope = F.try_divide(w * F.col("wxy") - F.col("wx") * F.col("wy"), w * F.col("wxx") - F.col("wx") * F.col("wx"))
    at_first = (F.col("wy") - slope * F.col("wx")) / w
    span = F.col("maxtime") - F.col("mintime")
    return {
        "mintime": F.col("mintime"), "maxtime": F.col("maxtime"), "timelength": span, "amplitude": 0.5 * (F.col("hi") - F.col("lo")), "ndetobslength_ratio": F.try_divide(F.col("ndet"), span),
        "linear_fit_slope": at_first - slope * F.col("mintime"), "linear_fit_true_slope": slope, "magnitude_ratio": F.try_divide(F.col("hi") - F.col("smed"), F.col("hi") - F.col("lo")),
    }


def _measured(frame: DataFrame, parts: list[tuple[Aggregates, dict[str, Column]]]) -> DataFrame:
    sums = {k: v for a, _ in parts for k, v in a.items()}
    g = frame.groupBy(KEY).agg(F.count(F.lit(1)).alias("ndet"), *[v.alias(k) for k, v in sums.items()]).where(F.col("ndet") >= LEAST)
    return g.select(KEY, "ndet", *[v.alias(k) for _, o in parts for k, v in o.items()])


def stetson(lc: DataFrame, weight_by_time: bool = True) -> DataFrame:
    """(objectid, ndet, stetson_j, stetson_k). J sums over n - 1 pairs of neighbours but divides by n."""
    return _measured(frame(lc, weight_by_time=weight_by_time), [(_stetson(), _stetson_out())])


def moments(lc: DataFrame, nonzero_errors: bool = True) -> DataFrame:
    """Median, weighted mean, MAD, 1.483 MAD, population skew, excess kurtosis, share beyond one sigma, percentiles.

    Where points with an error of zero are kept, the weighted mean of their object is NaN.
    """
    return _measured(frame(lc, nonzero_errors=nonzero_errors), [(_moments(), _moments_out())])


def flux_measures(lc: DataFrame, is_flux: bool = False, nonzero_errors: bool = True) -> DataFrame:
    """Flux percentile ratios and amplitudes; magnitudes become 10^(-0.4 m)."""
    return _measured(frame(lc, is_flux, nonzero_errors=nonzero_errors), [(_flux(), _flux_out())])


def ptp_measures(lc: DataFrame) -> DataFrame:
    """Point-to-point measures (eta)."""
    return _measured(frame(lc), [(_ptp(), _ptp_out())]).drop("ndet")


def series_measures(lc: DataFrame, nonzero_errors: bool = True) -> DataFrame:
    """Counts, times, amplitude, the linear fit's constant term (weights 1 / e^4) and slope, and the magnitude ratio.

    Where points with an error of zero are kept, the fit of their object is NaN.
    """
    return _measured(frame(lc, nonzero_errors=nonzero_errors), [(_series(), _series_out())])


def nonperiodic(lc: DataFrame, is_flux: bool = False) -> DataFrame:
    """All features of this module, a row for each object: one scan, one shuffle and one aggregation."""
    return _measured(frame(lc, is_flux), [(_series(), _series_out()), (_moments(), _moments_out()), (_flux(), _flux_out()), (_ptp(), _ptp_out()), (_stetson(), _stetson_out())])


def best_magcol(features: DataFrame, least: int = 10) -> DataFrame:
    """(objectid, magcol): of several magnitude columns of an object the one with the least MAD and enough points."""
    return features.where(F.col("ndet") >= least).groupBy(KEY).agg(F.min_by("magcol", F.struct("mad", "magcol")).alias("magcol"))


def phased_features(folded: DataFrame) -> DataFrame:
    """(objectid, eta_phased, eta_time, ratio): point-to-point over variance in order of phase and of time."""
    by_phase = Window.partitionBy(KEY).orderBy("phase", "t", "seq")
    d = folded.withColumns({"dp": F.col("m") - F.lag("m").over(by_phase), "dt": F.col("m") - F.lag("m").over(by_time())})
    g = d.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.var_pop("m").alias("v"), F.sum(F.col("dp") * F.col("dp")).alias("p"), F.sum(F.col("dt") * F.col("dt")).alias("q")).where(F.col("n") >= LEAST)
    eta = lambda c: F.try_divide(F.try_divide(F.col(c), F.col("v")), F.col("n") - 1.0)
    return g.select(KEY, eta("p").alias("eta_phased"), eta("q").alias("eta_time"), F.try_divide("p", "q").alias("ratio"))
