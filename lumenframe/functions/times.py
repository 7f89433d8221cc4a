"""Julian dates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Julian date of 1970-01-01 00:00 UTC, and the offset of modified Julian dates.
UNIX_EPOCH_JD, MJD = 2440587.5, 2400000.5


def unixtime_to_jd(seconds: Column) -> Column:
    return seconds.cast("double") / 86400.0 + UNIX_EPOCH_JD


def timestamp_to_jd(ts: Column) -> Column:
    """JD (UTC) of a timestamp; a timestamp without time zone is taken as UTC if the session is in UTC."""
    return F.unix_micros(ts.cast("timestamp")).cast("double") / 86400e6 + UNIX_EPOCH_JD


def jd_to_timestamp(jd: Column) -> Column:
    return F.timestamp_micros(F.round((jd - UNIX_EPOCH_JD) * 86400e6).cast("long"))


def jd_to_mjd(jd: Column) -> Column:
    return jd - MJD


def mjd_to_jd(mjd: Column) -> Column:
    return mjd + MJD


def jd_now() -> Column:
    return timestamp_to_jd(F.current_timestamp())


#: Fixed value: seconds that light takes for an astronomical unit.
AU_SECONDS = 499.004784


def earth_position(jd: Column) -> tuple[Column, Column, Column]:
    """The Earth around the Sun in astronomical units, equatorial, by the low-precision solar formulae (about 0.01 degrees)."""
    n = jd - 2451545.0
    g = F.radians(357.528 + 0.9856003 * n)
    lon = F.radians(280.460 + 0.9856474 * n + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    r = 1.00014 - 0.01671 * F.cos(g) - 0.00014 * F.cos(2 * g)
    tilt = F.radians(23.439 - 0.0000004 * n)
    return -r * F.cos(lon), -r * F.cos(tilt) * F.sin(lon), -r * F.sin(tilt) * F.sin(lon)


def light_delay(jd: Column, ra: Column, decl: Column) -> Column:
    """Days by which light from a direction passes the Sun later than the Earth (less, where it is negative)."""
    x, y, z = earth_position(jd)
    a, d = F.radians(ra), F.radians(decl)
    return (x * F.cos(d) * F.cos(a) + y * F.cos(d) * F.sin(a) + z * F.sin(d)) * AU_SECONDS / 86400.0


def jd_corr(jd: Column, ra: Column, decl: Column) -> Column:
    """The Julian date at which the light would have passed the Sun: heliocentric, within some seconds of barycentric time.

    No ephemeris file is needed; the Sun's own motion around the barycentre (up to four seconds) and the difference of time
    scales are left out.
    """
    return jd + light_delay(jd, ra, decl)
