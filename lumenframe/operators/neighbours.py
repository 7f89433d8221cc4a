"""Series of an object's neighbours on the sky: how they differ in magnitude and colour, and whether they share its signal.

Pairs come from the cell join of spatial.neighbors(); each neighbour's series is cleaned once, however many objects it is
near, and a pair is joined with it by the neighbour's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import phase
from .series import KEY, finite, normalize, sigclip

#: Colours as differences of two magnitudes, by name.
COLORS = {"bvcolor": ("bmag", "vmag"), "vkcolor": ("vmag", "kmag"), "jkcolor": ("jmag", "kmag"), "ijcolor": ("sdssi", "jmag"), "gkcolor": ("sdssg", "kmag"), "grcolor": ("sdssg", "sdssr")}


def differences(pairs: DataFrame, catalog: DataFrame, bands: list[str], colors: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``pairs`` (objectid, neighbor, more) with d_<band> and d_<colour>: the object's value less the neighbour's.

    Null where either has none or one that is not finite. Colours are those of which both bands are in ``bands``.
    """
    named = {k: v for k, v in (COLORS if colors is None else colors).items() if set(v) <= set(bands)}
    mags = [F.when(finite(b), F.col(b)).alias(b) for b in bands]
    side = lambda key, tag: catalog.select(F.col(KEY).alias(key), *mags).select(key, *[F.col(b).alias(f"_{tag}_{b}") for b in bands])
    j = pairs.join(side(KEY, "o"), KEY, "left").join(side("neighbor", "n"), "neighbor", "left")
    mine: dict[str, Column] = {b: F.col(f"_o_{b}") - F.col(f"_n_{b}") for b in bands}
    mine |= {c: (F.col(f"_o_{a}") - F.col(f"_o_{b}")) - (F.col(f"_n_{a}") - F.col(f"_n_{b}")) for c, (a, b) in named.items()}
    return j.select(*pairs.columns, *[v.alias(f"d_{k}") for k, v in mine.items()])


def curves(lc: DataFrame, pairs: DataFrame, periods: DataFrame | None = None, sigma: float | tuple[float, float] | None = 4.0, least: int = 49, gap: float = 4.0, is_flux: bool = False, nonzero_errors: bool = True) -> DataFrame:
    """(objectid, neighbor, t, m, e, seq): the clipped and normalised series of the neighbours that keep ``least`` points.

    With ``periods`` (objectid, method, period, epoch) of the objects, also method and phase: the neighbour's points folded
    with the object's period, once for each method; a null epoch is the neighbour's first time. ``nonzero_errors`` is
    that of sigclip().
    """
    asked = pairs.select(F.col("neighbor").alias(KEY)).distinct()
    clean = normalize(sigclip(lc.join(asked, KEY, "left_semi"), sigma, is_flux, nonzero_errors=nonzero_errors), gap, is_flux=is_flux).select(KEY, "t", "m", "e", "seq")
    enough = clean.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), F.min("t").alias("_first")).where(F.col("_n") >= least)
    series = clean.join(enough, KEY).withColumnRenamed(KEY, "neighbor")
    out = pairs.select(KEY, "neighbor").join(series, "neighbor").select(KEY, "neighbor", "t", "m", "e", "seq", "_first")
    if periods is None:
        return out.drop("_first")
    folded = out.join(periods.select(KEY, "method", "period", "epoch"), KEY)
    return folded.withColumn("phase", phase(F.col("t"), F.col("period"), F.coalesce("epoch", "_first"))).select(KEY, "neighbor", "method", "t", "m", "e", "seq", "phase")


def blends(folded: DataFrame, own: DataFrame, bins: int = 20, least: int = 2) -> DataFrame:
    """(objectid, neighbor, method, n, amplitude, correlation) of folded neighbours (curves()) and the objects' own folded points.

    ``own`` is (objectid, method, m, phase). Amplitude is the range of the medians of phase bins that hold ``least`` points;
    correlation is that of the object's and the neighbour's bins: near one, the object's signal may be the neighbour's.
    """
    at = F.least(F.floor(F.col("phase") * bins), F.lit(bins - 1)).cast("int")
    binned = lambda x, keys: x.withColumn("bin", at).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("k"), F.median("m").alias("b")).where(F.col("k") >= least)
    theirs = binned(folded, [KEY, "neighbor", "method"])
    mine = binned(own, [KEY, "method"]).select(KEY, "method", "bin", F.col("b").alias("mine"))
    j = theirs.join(mine, [KEY, "method", "bin"], "left")
    return j.groupBy(KEY, "neighbor", "method").agg(F.sum("k").alias("n"), (F.max("b") - F.min("b")).alias("amplitude"), F.corr("b", "mine").alias("correlation"))
