"""Sky coordinates as columns: sexagesimal forms, distances, proper motions, rotations and projections. Degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rotation from equatorial (J2000) to galactic axes.
GALACTIC = [
    [-0.0548755604162154, -0.8734370902348850, -0.4838350155487132],
    [0.4941094278755837, -0.4448296299600112, 0.7469822444972189],
    [-0.8676661490190047, -0.1980763734312015, 0.4559837761750669],
]


def angle_wrap(angle: Column, radians: bool = False) -> Column:
    """Into [0, 360) or [0, 2 pi)."""
    return F.pmod(angle, F.lit(2 * math.pi if radians else 360.0))


def decimal_to_dms(decl: Column) -> Column:
    """struct(sign, d, m, s); the seconds keep their fraction."""
    a = F.abs(decl)
    d = F.floor(a)
    m = F.floor((a - d) * 60.0)
    s = (a - d) * 3600.0 - m * 60.0
    return F.struct(F.when(decl < 0, "-").otherwise("+").alias("sign"), d.cast("int").alias("d"), m.cast("int").alias("m"), s.alias("s"))


def decimal_to_hms(ra: Column) -> Column:
    """struct(h, m, s) of an angle in degrees; null beyond 24 hours."""
    hours = F.pmod(ra, F.lit(360.0)) / 15.0
    h = F.floor(hours)
    m = F.floor((hours - h) * 60.0)
    s = (hours - h) * 3600.0 - m * 60.0
    return F.struct(h.cast("int").alias("h"), m.cast("int").alias("m"), s.alias("s"))


def hms_to_decimal(h: Column, m: Column, s: Column) -> Column:
    """Degrees; null for over 24 hours."""
    hours = h.cast("double") + m.cast("double") / 60.0 + s.cast("double") / 3600.0
    return F.when(hours <= 24.0, hours * 15.0)


def dms_to_decimal(sign: Column, d: Column, m: Column, s: Column) -> Column:
    value = d.cast("double") + m.cast("double") / 60.0 + s.cast("double") / 3600.0
    return F.when(sign == "-", -value).otherwise(value)


def _parts(text: Column) -> Column:
    return F.split(F.trim(text), r"[:\s]+")


def hms_str_to_decimal(text: Column) -> Column:
    """``HH:MM:SS`` or ``HH MM SS``; null if it is not of this form."""
    p = _parts(text)
    at = lambda i: F.expr("1") * F.try_element_at(p, F.lit(i)).try_cast("double")
    return hms_to_decimal(at(1), at(2), at(3))


def dms_str_to_decimal(text: Column) -> Column:
    """``[+-]DD:MM:SS`` or with spaces; null if it is not of this form."""
    p = _parts(F.regexp_replace(F.trim(text), r"^[+-]", ""))
    at = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return dms_to_decimal(F.substring(F.trim(text), 1, 1), at(1), at(2), at(3))


def great_circle_dist(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Arcseconds, by the haversine formula."""
    r = F.radians
    a = F.pow(F.sin((r(dec2) - r(dec1)) / 2), 2) + F.cos(r(dec1)) * F.cos(r(dec2)) * F.pow(F.sin((r(ra2) - r(ra1)) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.sqrt(a), F.lit(1.0)))) * 3600.0


def unit_vector(ra: Column, dec: Column) -> list[Column]:
    r = F.radians
    return [F.cos(r(ra)) * F.cos(r(dec)), F.sin(r(ra)) * F.cos(r(dec)), F.sin(r(dec))]


def chord(degrees: float) -> float:
    """Length of the chord of an angle."""
    return 2.0 * math.sin(math.radians(degrees) / 2.0)


def chord_to_arcsec(d: Column) -> Column:
    return F.degrees(2 * F.asin(F.least(d / 2, F.lit(1.0)))) * 3600.0


def total_proper_motion(pmra: Column, pmdecl: Column, decl: Column) -> Column:
    """mas/yr from pmra without the cosine of the declination."""
    c = F.cos(F.radians(decl))
    return F.sqrt(pmdecl * pmdecl + pmra * pmra * c * c)


def reduced_proper_motion(mag: Column, pm: Column) -> Column:
    """mag + 5 log10(pm / 1000); null for no motion."""
    return F.when(pm > 0, mag + 5 * F.log10(pm / 1000.0))


def _rotate(xyz: list[Column], by: list[list[float]]) -> list[Column]:
    return [sum((row[i] * xyz[i] for i in range(1, 3)), row[0] * xyz[0]) for row in by]


def _angles(xyz: list[Column]) -> tuple[Column, Column]:
    return angle_wrap(F.degrees(F.atan2(xyz[1], xyz[0]))), F.degrees(F.asin(F.greatest(F.least(xyz[2], F.lit(1.0)), F.lit(-1.0))))


def equatorial_to_galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    """(l, b)."""
    return _angles(_rotate(unit_vector(ra, dec), GALACTIC))


def galactic_to_equatorial(gl: Column, gb: Column) -> tuple[Column, Column]:
    """(ra, dec): the true inverse, of both coordinates."""
    return _angles(_rotate(unit_vector(gl, gb), [list(c) for c in zip(*GALACTIC, strict=True)]))


def precess(ra: Column, dec: Column, epoch1: float, epoch2: float, pmra: Column | None = None, pmdecl: Column | None = None) -> tuple[Column, Column]:
    """(ra, dec) moved from one epoch (Julian year) to another by IAU 1976 precession, after proper motion (mas/yr)."""
    years = epoch2 - epoch1
    if pmra is not None and pmdecl is not None:
        ra, dec = ra + pmra * (years / 3.6e6), dec + pmdecl * (years / 3.6e6)
    t0, t = (epoch1 - 2000.0) / 100.0, years / 100.0
    w = 2306.2181 + 1.39656 * t0 - 0.000139 * t0 * t0
    sec = math.pi / 648000.0
    zeta = (w * t + (0.30188 - 0.000344 * t0) * t**2 + 0.017998 * t**3) * sec
    z = (w * t + (1.09468 + 0.000066 * t0) * t**2 + 0.018203 * t**3) * sec
    theta = ((2004.3109 - 0.85330 * t0 - 0.000217 * t0 * t0) * t - (0.42665 + 0.000217 * t0) * t**2 - 0.041833 * t**3) * sec
    ca, sa, cz, sz, ct, st = math.cos(zeta), math.sin(zeta), math.cos(z), math.sin(z), math.cos(theta), math.sin(theta)
    by = [[ca * ct * cz - sa * sz, -sa * ct * cz - ca * sz, -st * cz], [ca * ct * sz + sa * cz, -sa * ct * sz + ca * cz, -st * sz], [ca * st, -sa * st, ct]]
    return _angles(_rotate(unit_vector(ra, dec), by))


def xi_eta(ra: Column, dec: Column, center_ra: float, center_dec: float) -> tuple[Column, Column]:
    """Arc projection around a centre, degrees."""
    ca, cd = math.radians(center_ra), math.radians(center_dec)
    u, v, w = unit_vector(ra, dec)
    un = u * (math.cos(cd) * math.cos(ca)) + v * (math.cos(cd) * math.sin(ca)) + w * math.sin(cd)
    vn = v * math.cos(ca) - u * math.sin(ca)
    wn = w * math.cos(cd) - u * (math.sin(cd) * math.cos(ca)) - v * (math.sin(cd) * math.sin(ca))
    side = F.sqrt(vn * vn + wn * wn)
    scale = F.when(side > 0, F.degrees(F.acos(F.greatest(F.least(un, F.lit(1.0)), F.lit(-1.0)))) / side).otherwise(0.0)
    return vn * scale, wn * scale
