"""Channel state: complex values as ``array<struct<re, im>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signals import EPSILON
from .vectors import mean, once, rescaled, spread


def from_parts(re: Column, im: Column) -> Column:
    return F.zip_with(re, im, lambda r, i: F.struct(r.alias("re"), i.alias("im")))


def from_polar(size: Column, angle: Column) -> Column:
    return F.zip_with(size, angle, lambda m, p: F.struct((m * F.cos(p)).alias("re"), (m * F.sin(p)).alias("im")))


def magnitudes(z: Column) -> Column:
    return F.transform(z, lambda c: F.sqrt(c["re"] * c["re"] + c["im"] * c["im"]))


def phases(z: Column) -> Column:
    return F.transform(z, lambda c: F.atan2(c["im"], c["re"]))


def real_imaginary(z: Column) -> Column:
    return F.concat(F.transform(z, lambda c: c["re"]), F.transform(z, lambda c: c["im"]))


def magnitude_phase(z: Column) -> Column:
    return F.concat(magnitudes(z), phases(z))


def normalised(z: Column, method: str = "standard") -> Column:
    """``standard``: both parts as z-scores; ``minmax``: magnitudes to 0..1, phases kept; ``unit``: magnitudes to 1."""
    if method == "standard":
        parts = {k: _part(z, k) for k in ("re", "im")}
        moments = F.struct(*(f(parts[k]).alias(f"{n}_{k}") for k in parts for n, f in (("m", mean), ("s", spread))))
        return once(moments, lambda p: F.transform(z, lambda c: F.struct(*(((c[k] - p[f"m_{k}"]) / (p[f"s_{k}"] + EPSILON)).alias(k) for k in ("re", "im")))))
    if method == "minmax":
        return from_polar(rescaled(magnitudes(z), EPSILON), phases(z))
    if method == "unit":
        return F.transform(z, lambda c: once(F.sqrt(c["re"] * c["re"] + c["im"] * c["im"]) + EPSILON, lambda m: F.struct((c["re"] / m).alias("re"), (c["im"] / m).alias("im"))))
    raise ValueError(f"unknown method {method!r}")


def _part(z: Column, name: str) -> Column:
    return F.transform(z, lambda c: c[name])


def antennas(shape: Column) -> Column:
    """1 for a vector, the first extent of a matrix, receivers times transmitters of a cube."""
    n = F.size(shape)
    return F.when(n == 1, 1).when(n == 2, F.get(shape, F.lit(0))).otherwise(F.get(shape, F.lit(0)) * F.get(shape, F.lit(1)))


def subcarriers(shape: Column) -> Column:
    return F.element_at(shape, -1)
