"""Scaling of loaded datasets by their kind of signal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import EPSILON, GRAVITY, ble, ranges, wifi
from ..functions.vectors import once, total


def one_reading(a: Column, method: str = "standard") -> Column:
    """The axes of a single reading. Each axis is a series of one value, so its z-score and its place in its range are 0.

    ``magnitude`` gives the unit vector, ``gravity`` multiples of it; other methods change nothing.
    """
    if method in ("standard", "minmax"):
        return F.transform(a, lambda _: F.lit(0.0))
    if method == "magnitude":
        return once(F.sqrt(total(F.transform(a, lambda v: v * v))), lambda m: F.transform(a, lambda v: v / (m + EPSILON)))
    return F.transform(a, lambda v: v / GRAVITY) if method == "gravity" else a


#: By kind of signal, the scaler of a vector; channel states that come as plain columns are scaled like received power.
SCALERS: dict[str, Callable[[Column, str], Column]] = {
    "wifi": wifi, "csi": wifi, "ble": ble, "uwb": ranges, "ultrasound": ranges, "vlc": ranges, "magnetic": one_reading, "imu": one_reading,
}


def scaled(a: Column, signal: str, method: str, *, strict: bool = True) -> Column:
    """A vector scaled as its signal is; where the signal lacks the method, ValueError, or the vector itself."""
    if signal not in SCALERS:
        if strict:
            raise ValueError(f"signal {signal!r} has no scaler")
        return a
    try:
        return SCALERS[signal](a, method)
    except ValueError:
        if strict:
            raise
        return a


def hybrid(modalities: Column, method: str = "standard", kinds: tuple[str, ...] = tuple(SCALERS)) -> Column:
    """A map of vectors by modality, each scaled by its own rules; modalities without the method stay as they are."""

    def one(kind: Column, v: Column) -> Column:
        out = v
        for k in kinds:
            out = F.when(kind == k, scaled(v, k, method, strict=False)).otherwise(out)
        return out

    return F.transform_values(modalities, one)


def scaled_dataset(df: DataFrame, signal: str, method: str = "minmax") -> DataFrame:
    """A loaded dataset with its signals scaled: vectors, maps of readings, lists of transmitters or maps of modalities."""
    kinds = dict(df.dtypes)
    if "modalities" in kinds:
        return df.withColumn("modalities", hybrid(F.col("modalities"), method))
    if kinds.get("features", "").startswith("array<double"):
        return df.withColumn("features", scaled(F.col("features"), signal, method))
    if kinds.get("readings", "").startswith("map<"):
        values = scaled(F.map_values("readings"), signal, method)
        return df.withColumn("readings", F.map_from_arrays(F.map_keys("readings"), values))
    if "transmitters" in kinds:
        values = once(scaled(F.col("transmitters.value"), signal, method), lambda v: F.transform("transmitters", lambda t, i: t.withField("value", F.get(v, i))))
        return df.withColumn("transmitters", values)
    return df
