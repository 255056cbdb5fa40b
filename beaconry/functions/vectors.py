"""Small vector algebra on ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated a single time per row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def spread(a: Column) -> Column:
    """Population standard deviation; null for an empty array."""
    return once(mean(a), lambda m: F.sqrt(mean(F.transform(a, lambda v: (v - m) * (v - m)))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def standardised(a: Column, epsilon: float = 0.0) -> Column:
    """Z-scores with the population deviation plus ``epsilon``; without epsilon a constant array stays as it is."""
    moments = F.struct(mean(a).alias("m"), spread(a).alias("s"))

    def scaled(p: Column) -> Column:
        z = F.transform(a, lambda v: (v - p["m"]) / (p["s"] + F.lit(epsilon)))
        return z if epsilon else F.when(p["s"] > 0, z).otherwise(a)

    return once(moments, scaled)


def rescaled(a: Column, epsilon: float = 0.0) -> Column:
    """Values moved to 0..1 by the array's own range; without epsilon a constant array stays as it is."""
    ends = F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))

    def scaled(p: Column) -> Column:
        z = F.transform(a, lambda v: (v - p["lo"]) / (p["hi"] - p["lo"] + F.lit(epsilon)))
        return z if epsilon else F.when(p["hi"] > p["lo"], z).otherwise(a)

    return once(ends, scaled)


def softmax(a: Column) -> Column:
    return once(F.array_max(a), lambda top: once(F.transform(a, lambda v: F.exp(v - top)), lambda e: once(total(e), lambda s: F.transform(e, lambda v: v / s))))


def argmax(a: Column) -> Column:
    """Index from 0 of the first greatest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def padded(a: Column, width: int, fill: float) -> Column:
    """``a`` cut or filled to ``width`` elements; ragged sources get one width this way."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(float(fill)), F.greatest(F.lit(width) - F.size(a), F.lit(0)))), 1, width)
