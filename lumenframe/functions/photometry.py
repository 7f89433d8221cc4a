"""Magnitudes and colours as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constant and factors that turn 2MASS magnitudes into others, with J, H and K; J and H; J and K; H and
#: K; J; H; K known.
FROM_JHK: dict[str, list[list[float]]] = {
    "bmag": [[0.1922, 5.2634, 0.0203, -4.2810], [0.7013, 6.2321, -5.2769], [0.1935, 5.2676, -4.2650], [0.7108, 18.5256, -17.5197], [5.5599, 0.6320], [6.7509, 0.5269], [7.0739, 0.4971]],
    "vmag": [[-0.0053, 3.5326, 1.3141, -3.8331], [0.2948, 4.2168, -3.2251], [0.0631, 3.7103, -2.7004], [1.4044, 12.1719, -11.2331], [3.8512, 0.7671], [4.8834, 0.6895], [5.1466, 0.6682]],
    "rmag": [[0.0606, 2.7823, 0.8922, -2.6713], [0.3678, 3.4181, -2.4434], [0.1063, 2.9828, -1.9846], [0.4826, 10.3926, -9.4021], [2.8217, 0.8101], [3.9934, 0.7154], [4.3327, 0.6862]],
    "imag": [[0.0560, 2.0812, 0.4074, -1.4889], [0.2453, 2.4061, -1.4236], [0.0994, 2.1576, -1.1622], [0.1403, 8.0510, -7.0394], [1.5585, 0.8979], [2.6453, 0.8138], [2.9959, 0.7839]],
    "sdssu": [[3.5675, 5.4894, -2.8007, -1.8600], [4.2568, 5.3802, -4.5899], [3.8707, 4.6353, -3.8165], [10.4029, 0.6696, -0.1827], [7.4786, 0.6779], [10.2512, 0.4984], [10.7584, 0.4662]],
    "sdssg": [[0.9922, 4.3197, -1.6916, -1.6751], [0.6890, 4.4356, -3.4537], [1.5487, 4.1286, -3.2193], [4.3634, 2.7802, -1.9456], [2.4949, 0.9537], [4.7010, 0.8227], [5.2323, 0.7899]],
    "sdssr": [[0.6975, 2.9782, -0.8809, -1.1230], [1.0935, 2.9289, -1.9766], [0.7277, 2.7746, -1.8005], [5.7039, 1.4010, -0.7037], [3.0033, 0.8713], [5.6142, 0.7069], [5.8755, 0.6913]],
    "sdssi": [[0.8875, 2.3210, -0.6825, -0.6724], [0.9052, 2.3750, -1.4074], [0.8117, 2.1503, -1.1763], [6.2356, 2.7331, -2.1008], [2.1593, 0.9168], [6.4280, 0.6295], [5.8109, 0.6773]],
    "sdssz": [[0.8346, 1.7668, -0.1778, -0.6084], [0.9037, 1.8245, -0.8472], [0.9220, 1.7158, -0.7411], [4.3827, 2.4788, -1.7118], [1.5408, 0.9557], [6.1351, 0.6509], [6.6213, 0.6183]],
}


def from_jhk(band: str, j: Column, h: Column, k: Column) -> Column:
    """A band of FROM_JHK from whichever of J, H and K are there; null if none is."""
    cases = ((j, h, k), (j, h), (j, k), (h, k), (j,), (h,), (k,))
    return F.coalesce(*[sum((c * x for c, x in zip(cs[1:], mags, strict=True)), F.lit(cs[0])) for cs, mags in zip(FROM_JHK[band], cases, strict=True)])


def absolute_gaia_magnitude(mag: Column, parallax_mas: Column, mag_err: Column | None = None, parallax_err: Column | None = None) -> tuple[Column, Column]:
    """(absolute magnitude, its error): distance is 1000 / |parallax|, no extinction."""
    d = F.try_divide(F.lit(1000.0), F.abs(parallax_mas))
    m = 5 - 5.0 * F.log10(d) + mag
    if mag_err is None or parallax_err is None:
        return m, F.lit(None).cast("double")
    d_err = F.try_divide(F.lit(1000.0), parallax_mas * parallax_mas) * parallax_err
    return m, F.sqrt(F.pow(F.try_divide(F.lit(5.0), d * math.log(10.0)), 2) * d_err * d_err + mag_err * mag_err)


#: Fixed value: flux of a Kepler magnitude of 12.
F12 = 1.74e5


def keplerflux_to_keplermag(flux: Column, f12: float = F12) -> Column:
    """Infinite for a flux of zero, null for a negative one."""
    return F.when(flux == 0, float("inf")).otherwise(12.0 - 2.5 * F.log10(flux / f12))


def keplermag_to_keplerflux(mag: Column, f12: float = F12) -> Column:
    return F.pow(F.lit(10.0), -0.4 * (mag - 12.0)) * f12


def keplermag_to_sdssr(kepmag: Column, kic_sdssg: Column, kic_sdssr: Column) -> Column:
    """r from the Kepler magnitude and the catalog's g and r, by the published colour relation at g - r = 0.8."""
    gr = kic_sdssg - kic_sdssr
    return F.when(gr < 0.8, (kepmag - 0.2 * kic_sdssg) / 0.8).otherwise((kepmag - 0.1 * kic_sdssg) / 0.9)


def flux_ppm_to_magnitudes(ppm: Column) -> Column:
    return -2.5 * F.log10(1.0 - ppm / 1.0e6)


def normalized_flux_to_mag(flux: Column, flux_err: Column, tessmag: Column) -> tuple[Column, Column]:
    """(magnitude, error) of a flux around one."""
    return tessmag - 2.5 * F.log10(flux), -2.5 * F.log10(1 - flux_err)


#: Bounds of the rotated colour for M0 to M9; they are open, so a value on one has no class.
M_BOUNDS = [0.6660, 0.8592, 1.0822, 1.2998, 1.6378, 2.0363, 2.2411, 2.4126, 2.9213, 3.2418, 3.4559]


def mdwarf_subtype(ri: Column, iz: Column) -> tuple[Column, Column, Column]:
    """(class, sti, sts) of the colours r - i and i - z."""
    sti = 0.875274 * ri + 0.483628 * (iz + 0.00438)
    sts = -0.483628 * ri + 0.875274 * (iz + 0.00438)
    name = F.coalesce(*[F.when((sti > a) & (sti < b), F.lit(f"M{i}")) for i, (a, b) in enumerate(zip(M_BOUNDS, M_BOUNDS[1:], strict=False))])
    return name, sti, sts


def color_indices(u: Column, g: Column, r: Column, i: Column, z: Column) -> dict[str, Column]:
    """Colour-gravity v, metallicity p1, l and s, and the RR Lyrae indices."""
    return {
        "v_color": 0.283 * (u - g) - 0.354 * (g - r) + 0.455 * (r - i) + 0.766 * (i - z),
        "p1_color": 0.91 * (u - g) + 0.415 * (g - r) - 1.28,
        "l_color": -0.436 * u + 1.129 * g - 0.119 * r - 0.574 * i + 0.1984,
        "s_color": -0.249 * u + 0.794 * g - 0.555 * r + 0.124,
        "d_ug": (u - g) + 0.67 * (g - r) - 1.07,
        "d_gr": 0.45 * (u - g) - (g - r) - 0.12,
    }


#: Star classes and their cuts as predicates. u to k are dereddened magnitudes, um to zm measured ones,
#: v_color to d_gr the indices above, m_class and rpmj the M subtype and reduced proper motion.
CLASSES: list[tuple[str, str]] = [
    ("WD/sdO/sdB", "g-r < -0.2 AND g-r > -1.0 AND u-g < 0.7 AND u-g > -1 AND u-g+2*(g-r) < -0.1"),
    ("A/BHB/blustrg", "u-g < 1.5 AND u-g > 0.8 AND g-r < 0.2 AND g-r > -0.5"),
    ("Fturnoff/sdF", "p1_color < -0.25 AND p1_color > -0.7 AND u-g < 1.4 AND u-g > 0.4 AND g-r < 0.7 AND g-r > 0.2"),
    ("lowmetal", "g-r < 0.75 AND g-r > -0.5 AND u-g < 3.0 AND u-g > 0.6 AND l_color > 0.135"),
    ("lowmetalgiant", "p1_color > -0.1 AND p1_color < 0.6 AND s_color > 0.05"),
    ("F/G", "g-r < 0.48 AND g-r > 0.2"),
    ("dG", "g-r < 0.55 AND g-r > 0.48"),
    ("gK", "g-r > 0.35 AND g-r < 0.7 AND l_color > 0.07 AND u-g > 0.7 AND u-g < 4.0 AND r-i > 0.15 AND r-i < 0.6"),
    ("AGB", "u-g < 3.5 AND u-g > 2.5 AND g-r < 1.3 AND g-r > 0.9 AND s_color < -0.06"),
    ("dK", "g-r < 0.75 AND g-r > 0.55"),
    ("sdM", "g-r > 1.6 AND r-i < 1.3 AND r-i > 0.95"),
    ("gM", "j-k > 1.02 AND j-h < 0.561*(j-k)+0.46 AND j-h > 0.561*(j-k)+0.14 AND g-i > 0.932*(i-k)-0.872"),
    ("MSWD", "um-gm < 2.25 AND gm-rm > -0.2 AND gm-rm < 1.2 AND rm-im > 0.5 AND rm-im < 2.0 AND gm-rm > -19.78*(rm-im)+11.13 AND gm-rm < 0.95*(rm-im)+0.5"),
    ("BD", "zm < 19.5 AND um > 21.0 AND gm > 22.0 AND rm > 21.0 AND im-zm > 1.7"),
    ("RRL", "u-g > 0.98 AND u-g < 1.3 AND d_ug > -0.05 AND d_ug < 0.35 AND d_gr > 0.06 AND d_gr < 0.55 AND r-i > -0.15 AND r-i < 0.22 AND i-z > -0.21 AND i-z < 0.25"),
    ("QSO", "(u-g > -0.1 AND u-g < 0.7 AND g-r > -0.3 AND g-r < 0.5) OR u-g > 1.6*(g-r)+1.34"),
]


def color_classes() -> Column:
    """Array of the classes of CLASSES that a row with those columns is in; first the M dwarf subtype, if it is one."""
    dwarf = F.when(F.expr("m_class IS NOT NULL AND rpmj > 1.0"), F.concat(F.lit("d"), F.col("m_class")))
    return F.array_compact(F.array(dwarf, *[F.when(F.expr(cut), F.lit(name)) for name, cut in CLASSES]))
