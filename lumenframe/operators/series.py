"""Operators on long tables of observations: one row is one point of one object.

Columns: objectid, t (days), m (magnitude or flux), e (its error), seq (a tie-break for equal times). Each operator
works on all objects at once by windows and grouped aggregates, partitioned by object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import phase

KEY = "objectid"

#: Fixed value: turns a median absolute deviation into a standard deviation.
MAD_STD = 1.483


def by_time(key: str = KEY) -> Window:
    return Window.partitionBy(key).orderBy("t", "seq")


def whole(key: str = KEY) -> Window:
    return Window.partitionBy(key)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to as many partitions as shuffles have: where a kernel works long on few bytes, adaptive execution
    would join the partitions of many objects in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def finite_filter(lc: DataFrame, nonzero_errors: bool = True) -> DataFrame:
    """Rows with finite t, m and e, and e other than zero."""
    keep = finite("t") & finite("m") & finite("e")
    return lc.where(keep & (F.col("e") != 0) if nonzero_errors else keep)


def with_center(lc: DataFrame, stat: str = "median") -> DataFrame:
    """Adds ``center`` and ``sigma``: median and 1.483 MAD, or mean and population standard deviation."""
    if stat == "mean":
        return lc.withColumns({"center": F.avg("m").over(whole()), "sigma": F.stddev_pop("m").over(whole())})
    c = lc.withColumn("center", F.median("m").over(whole()))
    return c.withColumn("sigma", MAD_STD * F.median(F.abs(F.col("m") - F.col("center"))).over(whole()))


def sigclip(lc: DataFrame, sigma: float | tuple[float, float] | None = 4.0, is_flux: bool = False, rounds: int = 1, stat: str = "median", nonzero_errors: bool = True) -> DataFrame:
    """Keeps points strictly within sigma of the centre; a pair clips (fainter, brighter) points on their own.

    Strictly: an object whose MAD is zero loses every point. ``rounds``: passes at most, each over what the last one
    left; rounds that remove nothing change nothing, so this is clipping until no point goes, or that many times.
    Points that are not finite go, and with ``nonzero_errors`` those with an error of zero.
    """
    cols = lc.columns
    lc = finite_filter(lc, nonzero_errors)
    if sigma is None:
        return lc
    for _ in range(rounds):
        off = F.col("m") - F.col("center")
        if isinstance(sigma, (int, float)):
            keep = F.abs(off) < sigma * F.col("sigma")
        else:
            faint, bright = (sigma[1], sigma[0]) if is_flux else (sigma[0], sigma[1])
            keep = (off < faint * F.col("sigma")) & (off > -bright * F.col("sigma"))
        lc = with_center(lc, stat).where(keep).select(*cols)
    return lc


def timegroups(lc: DataFrame, gap: float = 4.0) -> DataFrame:
    """Adds ``tgroup``, from 0: a new group begins where the time since the last point is over ``gap``."""
    step = F.when(F.col("t") - F.lag("t").over(by_time()) > gap, 1).otherwise(0)
    return lc.withColumn("_step", step).withColumn("tgroup", F.sum("_step").over(by_time()).cast("int")).drop("_step")


def normalize(lc: DataFrame, gap: float = 4.0, to: str | float = "globalmedian", is_flux: bool = False) -> DataFrame:
    """Each time group's median taken out, then the object's median (or a number, or nothing for "zero") put in."""
    g = timegroups(lc, gap).withColumns({"_group": F.median("m").over(Window.partitionBy(KEY, "tgroup")), "_all": F.median("m").over(whole())})
    level = F.col("_all") if to == "globalmedian" else F.lit(1.0 if is_flux else 0.0) if to == "zero" else F.lit(float(to))
    m = F.try_divide("m", "_group") * level if is_flux else F.col("m") - F.col("_group") + level
    return g.withColumn("m", m).drop("_group", "_all")


def normalize_by_instrument(lc: DataFrame, keys: list[str], level: Column | None = None) -> DataFrame:
    """The median of each instrument key taken out and ``level`` added (the object's median by default).

    Keys with two rows or fewer, or with two finite values or fewer, become null.
    """
    w = Window.partitionBy(KEY, *keys)
    ok = (F.count(F.lit(1)).over(w) > 2) & (F.count_if(finite("m")).over(w) > 2)
    med = F.median(F.when(finite("m"), F.col("m"))).over(w)
    add = F.median(F.when(finite("m"), F.col("m"))).over(whole()) if level is None else level
    return lc.withColumn("m", F.when(ok, F.col("m") - med + add))


def quality_filter(lc: DataFrame, flag: str = "quality", columns: tuple[str, ...] = ("t", "m", "e"), ignore: list[tuple[float, float]] = ()) -> DataFrame:
    """Rows with flag 0, finite columns, and a time outside the closed intervals of ``ignore``."""
    keep = F.col(flag) == 0
    for c in columns:
        keep = keep & finite(c)
    for a, b in ignore:
        keep = keep & ~F.col("t").between(a, b)
    return lc.where(keep)


def mask_signal(lc: DataFrame, period: float, epoch: float, at: float, length: float) -> DataFrame:
    """Points further than ``length`` in phase from ``at``; for phase 0 or 1 from both ends."""
    ph = phase(F.col("t"), period, epoch)
    far = (ph > length) & (1.0 - ph > length) if at in (0.0, 1.0) else F.abs(ph - at) > length
    return lc.where(far)


def phase_fold(lc: DataFrame, period: Column | float, epoch: Column | float | None = None, wrap: bool = False) -> DataFrame:
    """Adds ``phase``; the epoch is the first time if none is given. ``wrap`` repeats every row one phase earlier."""
    epoch = F.min("t").over(whole()) if epoch is None else epoch
    out = lc.withColumn("phase", phase(F.col("t"), period, epoch))
    return out.withColumn("phase", F.explode(F.array(F.col("phase") - 1.0, F.col("phase")))) if wrap else out


def _bins(lc: DataFrame, at: str, width: float, least: int, low: Column, aggregates: list[Column]) -> DataFrame:
    """Bins centred on low + k width with closed edges: a point on an edge counts in both bins."""
    x = (F.col(at) - F.col("_low")) / width
    k = F.round(x).cast("long")
    ks = F.array_distinct(F.array(k, F.ceil(x - 0.5), F.floor(x + 0.5)))
    rows = lc.withColumn("_low", low).withColumn("bin", F.explode(ks)).where((F.abs(F.col(at) - (F.col("_low") + F.col("bin") * width)) <= width / 2))
    return rows.groupBy(KEY, "bin").agg(F.min("_low").alias("_low"), F.count(F.lit(1)).alias("n"), *aggregates).where(F.col("n") >= least)


def time_bin(lc: DataFrame, seconds: float, least: int = 7) -> DataFrame:
    """(objectid, bin, n, t, m, e): medians of the points of each time bin that holds ``least`` points or more."""
    lc = finite_filter(lc, nonzero_errors=False)
    return _bins(lc, "t", seconds / 86400.0, least, F.min("t").over(whole()), [F.median(c).alias(c) for c in ("t", "m", "e")]).drop("_low")


def phase_bin(folded: DataFrame, width: float = 0.005, least: int = 7, weighted: bool = False) -> DataFrame:
    """(objectid, bin, n, phase, m): medians, or means weighted by 1 / e^2, of each phase bin."""
    folded = finite_filter(folded) if weighted else folded
    m = F.sum(F.col("m") / (F.col("e") * F.col("e"))) / F.sum(1.0 / (F.col("e") * F.col("e"))) if weighted else F.median("m")
    return _bins(folded, "phase", width, least, F.min("phase").over(whole()), [F.median("phase").alias("phase"), m.alias("m")]).drop("_low")


def fill_gaps(lc: DataFrame, cadence: float | None = None, fill: float = 0.0, sigma: float = 3.0, is_flux: bool = False, nonzero_errors: bool = True) -> DataFrame:
    """(objectid, k, t, m): a regular grid from first to last time; null-free, gaps hold ``fill``.

    Points are clipped and their median removed (fluxes: divided by it, minus one). The cadence is the most frequent
    time step, rounded to 1e-9 days, unless given. A cell's value is the median of the points strictly inside it.
    ``nonzero_errors`` is that of sigclip().
    """
    c = sigclip(lc, sigma, nonzero_errors=nonzero_errors)
    med = F.median("m").over(whole())
    c = c.withColumn("m", F.try_divide(F.col("m"), med) - 1.0 if is_flux else F.col("m") - med).withColumn("_dt", F.round(F.col("t") - F.lag("t").over(by_time()), 9))
    step = F.mode(F.when(F.col("_dt") > 0, F.col("_dt"))) if cadence is None else F.lit(float(cadence))
    span = c.groupBy(KEY).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"), step.alias("_step")).where("_step > 0")
    grid = span.select(KEY, "_t0", "_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_t1") - F.col("_t0")) / F.col("_step")))).alias("k"))
    x = (F.col("t") - F.col("_t0")) / F.col("_step")
    cells = c.join(span, KEY).where(F.floor(x) < x).groupBy(KEY, F.floor(x).alias("k")).agg(F.median("m").alias("m"))
    return grid.join(cells, [KEY, "k"], "left").select(KEY, "k", (F.col("_t0") + F.col("k") * F.col("_step")).alias("t"), F.coalesce("m", F.lit(float(fill))).alias("m"))


def autocorrelation(filled: DataFrame, max_lag: int) -> DataFrame:
    """(objectid, lag, acf) of filled series for lags 0 to max_lag: sums of products over the sum of squares.

    A join on neighbouring cells, so the rows are points times lags, never points squared.
    """
    c = filled.withColumn("m", F.col("m") - F.avg("m").over(whole()))
    shifted = c.select(KEY, "k", F.col("m").alias("m0"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    pairs = shifted.join(c.select(KEY, F.col("k").alias("k2"), F.col("m").alias("m1")), (shifted[KEY] == c[KEY]) & (F.col("k") + F.col("lag") == F.col("k2"))).drop(c[KEY])
    sums = pairs.groupBy(KEY, "lag").agg(F.sum(F.col("m0") * F.col("m1")).alias("s"))
    total = c.groupBy(KEY).agg(F.sum(F.col("m") * F.col("m")).alias("s0"))
    return sums.join(total, KEY).select(KEY, "lag", F.try_divide("s", "s0").alias("acf"))


def concatenate(parts: list[DataFrame], is_flux: bool = False, normalize_parts: bool = True) -> DataFrame:
    """Rows of all parts with ``lcn``, the number of their part; optionally each part's median taken out per object."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("lcn", F.lit(i))
        if normalize_parts:
            med = F.median("m").over(whole())
            p = p.withColumn("m", F.try_divide(F.col("m"), med) if is_flux else F.col("m") - med)
        out = p if out is None else out.unionByName(p)
    return out
