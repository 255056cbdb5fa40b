"""From vectors to the inputs of models for images: convolution, tiling, folding, resizing. All are Columns over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import once


def _steps(n: Column) -> Column:
    """0 up to ``n``, exclusive."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def convolved(a: Column, kernel: list[float], *, stride: int = 1, padding: int = 0, dilation: int = 1, bias: float = 0.0) -> Column:
    """The sliding products of a vector with a kernel, as learners define them: the kernel isn't turned.

    ``padding`` zeros stand at both ends. A vector shorter than the kernel gives none; a null element gives nulls where the
    kernel meets it.
    """
    if not kernel or stride < 1 or dilation < 1 or padding < 0:
        raise ValueError("a kernel, a stride and a dilation are needed, and no padding below 0")
    zeros = F.array_repeat(F.lit(0.0), padding)
    reach = (len(kernel) - 1) * dilation

    def slid(v: Column) -> Column:
        def product(i: Column) -> Column:
            return sum((F.lit(float(w)) * F.get(v, i * stride + k * dilation) for k, w in enumerate(kernel)), F.lit(float(bias)))

        return F.transform(_steps(F.floor((F.size(v) - reach - 1) / F.lit(stride)) + 1), product)

    return once(F.concat(zeros, a, zeros), slid)


def channels(a: Column, kernels: list[list[float]], *, biases: list[float] | None = None, **options) -> Column:
    """``convolved`` with several kernels: a vector for each."""
    told = biases or [0.0] * len(kernels)
    return F.array(*(convolved(a, k, bias=b, **options) for k, b in zip(kernels, told, strict=True)))


def rectified(a: Column) -> Column:
    """Elements below 0 as 0."""
    return F.transform(a, lambda v: F.greatest(v, F.lit(0.0)))


def _between(n: Column, k: Column, size: int) -> Column:
    """``struct<low, high, part>``: where element ``k`` of ``size`` lies among ``n`` elements whose middles are evenly spaced."""
    at = F.greatest(F.lit(0.0), (k + 0.5) * n / F.lit(float(size)) - 0.5)
    low = F.least(F.floor(at), n - 1).cast("int")
    return F.struct(low.alias("low"), F.least(low + 1, n - 1).cast("int").alias("high"), (at - low).alias("part"))


def stretched(a: Column, size: int) -> Column:
    """A vector with ``size`` elements, between two neighbours in proportion; an empty one stays empty."""
    n = F.size(a)
    places = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: _between(n, k, size))
    return F.when(n > 0, F.transform(places, lambda p: F.get(a, p["low"]) * (1 - p["part"]) + F.get(a, p["high"]) * p["part"])).otherwise(a)


def resized(rows: Column, height: int, width: int) -> Column:
    """A matrix with ``height`` rows of ``width`` elements, in proportion both ways."""
    n = F.size(rows)
    places = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda k: _between(n, k, height))
    mixed = F.transform(places, lambda p: F.zip_with(F.get(rows, p["low"]), F.get(rows, p["high"]), lambda a, b: a * (1 - p["part"]) + b * p["part"]))
    return F.when(n > 0, F.transform(mixed, lambda r: stretched(r, width))).otherwise(rows)


def tiled(a: Column, height: int, width: int) -> Column:
    """A vector stretched to ``width`` and repeated in ``height`` rows."""
    return F.array_repeat(stretched(a, width), height)


def folded(a: Column, height: int, width: int) -> Column:
    """A vector laid in rows as near to a square as its length allows, zeros at the end, and resized; an empty one has no rows."""
    n = F.size(a)
    tall = F.floor(F.sqrt(n.cast("double"))).cast("int")
    wide = F.ceil(n / tall).cast("int")
    full = F.concat(a, F.array_repeat(F.lit(0.0), (tall * wide - n).cast("int")))
    rows = once(F.struct(full.alias("v"), wide.alias("w"), tall.alias("h")), lambda s: F.transform(_steps(s["h"]), lambda k: F.slice(s["v"], k * s["w"] + 1, s["w"])))
    return F.when(n > 0, resized(rows, height, width)).otherwise(F.expr("cast(array() as array<array<double>>)"))
