"""Injection of simulated variability: parameters and noise follow from hashes of object and observation number, so every
run is the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import KEY, MAD_STD, whole


def uniform(name: str, low: float, high: float, seed: int = 1, *more: str) -> Column:
    """Uniform in [low, high) from the MD5 of the object, a name, a seed and more columns: the same in any engine."""
    key = F.concat_ws("/", F.col(KEY).cast("string"), F.lit(name), F.lit(str(seed)), *[F.col(c).cast("string") for c in more])
    u = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return low + (high - low) * u


def normal(name: str, mean: float, std: float, seed: int = 1, *more: str) -> Column:
    """Normal by Box and Muller from two hashes."""
    return mean + std * F.sqrt(-2.0 * F.log(1.0 - uniform(f"{name}-a", 0.0, 1.0, seed, *more))) * F.cos(2 * math.pi * uniform(f"{name}-b", 0.0, 1.0, seed, *more))


#: Period range, order range, amplitude range and phase offset of the kinds made of sine series.
SINE_KINDS: dict[str, tuple[tuple[float, float], tuple[int, int], tuple[float, float], float]] = {
    "sinusoidal": ((0.04, 500.04), (2, 10), (0.1, 1.1), 0.0),
    "rrab": ((0.45, 0.80), (8, 10), (0.4, 0.9), math.pi),
    "rrc": ((0.1, 0.4), (2, 2), (0.1, 0.4), 1.5 * math.pi),
    "hads": ((0.04, 0.10), (5, 9), (0.1, 0.7), math.pi),
    "rotator": ((0.8, 120.0), (2, 2), (0.01, 0.71), 1.5 * math.pi),
    "lpv": ((250.0, 500.0), (2, 2), (0.1, 0.9), 1.5 * math.pi),
    "cepheid": ((1.5, 110.0), (8, 10), (0.1, 1.0), math.pi),
}


def parameters(kinds: DataFrame, seed: int = 1) -> DataFrame:
    """``kinds`` (objectid, kind) with the parameters of each object's kind; those that a kind lacks are null."""
    u = lambda n, a, b: uniform(n, a, b, seed)
    kind = F.col("kind")
    sines = lambda n, at: F.coalesce(*[F.when(kind == k, u(n, *v[at])) for k, v in SINE_KINDS.items()])
    p = kinds.withColumns({
        "period": F.when(kind == "planet", u("period", 0.1, 50.0)).when(kind == "eb", u("period", 0.2, 100.0)).otherwise(sines("period", 0)),
        "depth": F.when(kind == "planet", u("depth", 1e-4, 0.0201)).when(kind == "eb", u("depth", 1e-4, 0.7001)),
        "duration": F.when(kind == "planet", u("duration", 0.01, 0.30)).when(kind == "eb", u("duration", 0.01, 0.45)),
        "ratio": F.when(kind == "eb", u("ratio", 0.01, 1.0)),
        "secondary": F.when(kind == "eb", normal("secondary", 0.5, 0.1, seed)),
        "amplitude": F.when(kind == "flare", u("amplitude", 0.01, 1.0)).otherwise(sines("amplitude", 2)),
        "rise": F.when(kind == "flare", u("rise", 0.007, 0.047)),
        "decay": F.when(kind == "flare", u("decay", 0.04, 0.203)),
        "peaks": F.when(kind == "flare", F.slice(F.array(*[u(f"peak{i}", 0.0, 1.0) for i in range(4)]), F.lit(1), F.floor(u("n", 1.0, 5.0)).cast("int"))),
        "order": F.coalesce(*[F.when(kind == k, F.floor(u("order", v[1][0], v[1][1] + 1))) for k, v in SINE_KINDS.items()]),
        "shift": F.coalesce(*[F.when(kind == k, F.lit(float(v[3]))) for k, v in SINE_KINDS.items()]),
        "at": u("epoch", 0.0, 1.0),
    })
    return p.withColumn("ingress", F.when(kind == "planet", F.col("duration") * u("ingress", 0.05, 0.5)))


def variation(is_flux: bool = False) -> Column:
    """The variation around zero of a row with parameters(), its time t and the time range _t0 to _t1 of its object."""
    sign = "-1D" if is_flux else "1D"
    half = "duration / 2"
    near = "least(_x, 1 - _x)"
    bell = lambda d: f"exp(-({d}) * ({d}) / (2 * (duration / 5) * (duration / 5)))"
    return F.expr(f"""CASE
        WHEN kind IS NULL THEN 0D
        WHEN kind = 'planet' THEN {sign} * depth * greatest(0D, least(1D, ({half} - {near}) / ingress))
        WHEN kind = 'eb' THEN {sign} * depth * CASE WHEN abs(_x - secondary) <= {half} THEN ratio * {bell('_x - secondary')} WHEN {near} <= {half} THEN {bell(near)} ELSE 0D END
        WHEN kind = 'flare' THEN -({sign}) * amplitude * aggregate(peaks, 0D, (a, p) -> a + CASE WHEN t < _t0 + p * (_t1 - _t0) THEN exp(-pow(t - _t0 - p * (_t1 - _t0), 2) / (2 * rise * rise)) ELSE exp(-(t - _t0 - p * (_t1 - _t0)) / decay) END)
        ELSE amplitude * aggregate(sequence(1, cast(order AS int)), 0D, (a, i) -> a + sin({2 * math.pi}D * i * _x + (i + 1) * shift) / pow(2D, i - 1)) END""")


KINDS = ["planet", "eb", "flare", *SINE_KINDS]


def inject(lc: DataFrame, kinds: DataFrame, is_flux: bool = False, seed: int = 1) -> DataFrame:
    """Simulated series at the times of ``lc``: median + model + normal noise of 1.483 MAD, of magnitudes and errors.

    ``kinds``: (objectid, kind); objects without one get noise alone.
    """
    c = lc.withColumns({"_t0": F.min("t").over(whole()), "_t1": F.max("t").over(whole()), "_m": F.median("m").over(whole()), "_e": F.median("e").over(whole())})
    c = c.withColumns({"_dm": F.median(F.abs(F.col("m") - F.col("_m"))).over(whole()), "_de": F.median(F.abs(F.col("e") - F.col("_e"))).over(whole())}).join(parameters(kinds, seed), KEY, "left")
    c = c.withColumn("_x", (F.col("t") - F.col("_t0") - F.col("at") * F.col("period")) / F.col("period")).withColumn("_x", F.col("_x") - F.floor("_x"))
    m = F.col("_m") + variation(is_flux) + normal("m", 0.0, 1.0, seed, "seq") * MAD_STD * F.col("_dm")
    e = F.col("_e") + normal("e", 0.0, 1.0, seed, "seq") * MAD_STD * F.col("_de")
    return c.select(KEY, "t", m.alias("m"), e.alias("e"), "seq", "kind")


def choose(catalog: DataFrame, n: int, kinds: list[str] | None = None, seed: int = 1) -> DataFrame:
    """(objectid, kind): ``n`` objects by a hash, each with a kind by a hash."""
    names = F.array(*[F.lit(k) for k in kinds or KINDS])
    some = catalog.select(KEY).orderBy(uniform("chosen", 0.0, 1.0, seed), KEY).limit(n)
    return some.withColumn("kind", F.element_at(names, F.floor(uniform("kind", 1.0, len(kinds or KINDS) + 1.0, seed)).cast("int")))
