"""Searches and joins on the sky by declination bands and right-ascension cells: no pair is made that cells rule out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import chord, chord_to_arcsec, great_circle_dist, unit_vector


def _cells(df: DataFrame, size: float, ra: str, dec: str, spread: bool) -> DataFrame:
    """Adds ``band`` and ``cell``; with ``spread`` a row for every cell within ``size`` degrees.

    A band has whole cells of at least ``size`` degrees of arc at its end nearest a pole; near a pole it is one cell.
    """
    def cell_count(band: Column) -> Column:
        edge = F.greatest(F.abs(band * size), F.abs((band + 1) * size))
        return F.greatest(F.floor(F.cos(F.radians(F.least(edge, F.lit(90.0)))) * (360.0 / (size * 1.01))), F.lit(1))

    own = F.floor(F.col(dec) / size)
    out = df.withColumn("band", F.explode(F.sequence(own - 1, own + 1)) if spread else own)
    out = out.withColumn("_n", cell_count(F.col("band")))
    at = F.least(F.floor(F.pmod(F.col(ra), F.lit(360.0)) / 360.0 * F.col("_n")), F.col("_n") - 1)
    if not spread:
        return out.withColumn("cell", at).drop("_n")
    out = out.withColumn("_at", at)
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(F.col("_at") + i, F.col("_n"))))
    return out.withColumn("cell", F.explode(near)).drop("_n", "_at")


def cone_search(catalog: DataFrame, ra: float, dec: float, radius_deg: float) -> DataFrame:
    """Rows within ``radius_deg``, with ``dist_arcsec``, nearest first. The declination range can be pushed down."""
    x0, y0, z0 = math.cos(math.radians(ra)) * math.cos(math.radians(dec)), math.sin(math.radians(ra)) * math.cos(math.radians(dec)), math.sin(math.radians(dec))
    x, y, z = unit_vector(F.col("ra"), F.col("decl"))
    d = F.sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0) + (z - z0) * (z - z0))
    near = catalog.where(F.col("decl").between(dec - radius_deg - 1e-9, dec + radius_deg + 1e-9)).withColumn("_d", d).where(F.col("_d") <= chord(radius_deg))
    return near.withColumn("dist_arcsec", chord_to_arcsec(F.col("_d"))).drop("_d").orderBy("dist_arcsec", "objectid")


def box_search(catalog: DataFrame, ra1: float, ra2: float, dec1: float, dec2: float) -> DataFrame:
    """Rows in a box of coordinates; ra1 above ra2 means a box over 0."""
    ra = F.pmod(F.col("ra"), F.lit(360.0))
    inside = ra.between(ra1, ra2) if ra1 <= ra2 else (ra >= ra1) | (ra <= ra2)
    return catalog.where(inside & F.col("decl").between(dec1, dec2))


def xmatch(left: DataFrame, right: DataFrame, radius_arcsec: float, right_prefix: str = "x_") -> DataFrame:
    """All pairs within the radius: columns of ``left``, those of ``right`` with a prefix, ``dist_arcsec``.

    The right side is dealt to one cell, the left to the cells within reach; pairs meet in one cell only.
    """
    size = max(radius_arcsec / 3600.0 * 1.05, 0.01)
    r = _cells(right, size, "ra", "decl", spread=False)
    r = r.select(*[F.col(c).alias(right_prefix + c) if c not in ("band", "cell") else F.col(c) for c in r.columns])
    j = _cells(left, size, "ra", "decl", spread=True).join(r, ["band", "cell"]).drop("band", "cell")
    d = great_circle_dist(F.col("ra"), F.col("decl"), F.col(right_prefix + "ra"), F.col(right_prefix + "decl"))
    return j.withColumn("dist_arcsec", d).where(F.col("dist_arcsec") < radius_arcsec)


def xmatch_nearest(left: DataFrame, right: DataFrame, radius_arcsec: float, key: str = "objectid") -> DataFrame:
    """Every row of ``left`` with its nearest match: matched, x_objectid, dist_arcsec (null if there is none)."""
    m = xmatch(left.select(key, "ra", "decl"), right, radius_arcsec)
    best = m.groupBy(key).agg(F.min(F.struct("dist_arcsec", "x_objectid")).alias("b"))
    return left.join(best, key, "left").select(*left.columns, F.col("b").isNotNull().alias("matched"), F.col("b.x_objectid").alias("x_objectid"), F.col("b.dist_arcsec").alias("dist_arcsec"))


def close_pairs(catalog: DataFrame, radius_arcsec: float) -> DataFrame:
    """(objectid, neighbor, dist_arcsec): all pairs within the radius with a distance over zero, each from either side."""
    places = catalog.select("objectid", "ra", "decl")
    return xmatch(places, places, radius_arcsec).where("dist_arcsec > 0").select("objectid", F.col("x_objectid").alias("neighbor"), "dist_arcsec")


def neighbors(catalog: DataFrame, radius_arcsec: float, k: int = 100) -> DataFrame:
    """(objectid, rank, neighbor, dist_arcsec): up to ``k`` nearest others with a distance over zero."""
    w = Window.partitionBy("objectid").orderBy("dist_arcsec", "neighbor")
    return close_pairs(catalog, radius_arcsec).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("objectid", "rank", "neighbor", "dist_arcsec")


def neighbor_features(catalog: DataFrame, radius_arcsec: float) -> DataFrame:
    """(objectid, n_neighbors, closest_arcsec) for every object, of all neighbours with a distance over zero.

    Distinct places are compared, and count as many neighbours as they have objects: objects at one place make no pairs.
    """
    places = catalog.groupBy("ra", "decl").agg(F.count(F.lit(1)).alias("n"))
    near = xmatch(places.select("ra", "decl"), places, radius_arcsec).where("dist_arcsec > 0")
    found = near.groupBy("ra", "decl").agg(F.sum("x_n").alias("n"), F.min("dist_arcsec").alias("closest_arcsec"))
    return catalog.select("objectid", "ra", "decl").join(found, ["ra", "decl"], "left").select("objectid", F.coalesce("n", F.lit(0)).alias("n_neighbors"), "closest_arcsec")
