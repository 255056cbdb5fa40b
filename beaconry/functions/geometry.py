"""Coordinates, locations and headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_2d(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def distance_3d(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))


def coordinate(x: Column, y: Column, z: Column | None = None) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.coalesce(z, F.lit(0.0)).cast("double").alias("z") if z is not None else F.lit(0.0).alias("z"))


def added(a: Column, b: Column) -> Column:
    return F.struct(*((a[k] + b[k]).alias(k) for k in "xyz"))


def subtracted(a: Column, b: Column) -> Column:
    return F.struct(*((a[k] - b[k]).alias(k) for k in "xyz"))


def scaled(a: Column, by: Column | float) -> Column:
    return F.struct(*((a[k] * by).alias(k) for k in "xyz"))


def latlon(latitude: Column, longitude: Column) -> Column:
    """Null unless both are known."""
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.array(latitude, longitude))


def matches(a: Column, b: Column) -> Column:
    """Whether floors or buildings agree; an unknown side agrees with anything."""
    return a.isNull() | b.isNull() | (a == b)


def polar(distance: Column, degrees: Column) -> tuple[Column, Column]:
    return distance * F.cos(F.radians(degrees)), distance * F.sin(F.radians(degrees))


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def heading(mx: Column, my: Column) -> Column:
    return F.atan2(my, mx)


def calibrated(value: Column, bias: Column | float, scale: Column | float) -> Column:
    return (value - bias) * scale


def confidence(uncertainty: Column, reach: float = 20.0) -> Column:
    return 1 - F.least(uncertainty / F.lit(reach), F.lit(1.0))
