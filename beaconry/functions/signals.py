"""Normalisers and accessors of the signal kinds. Each normaliser takes a method name and returns a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import mean, once, rescaled, spread, standardised, total

#: Markers of undetected transmitters and ranges of received power, in dBm; ranges of distances, in metres.
WIFI_ABSENT, WIFI_LOW, WIFI_HIGH = 100.0, -104.0, 0.0
BLE_ABSENT, BLE_HIGH = -100.0, 0.0
GRAVITY = 9.81
LIGHT_SPEED = 299_792_458.0
SOUND_SPEED, SOUND_AT_ZERO, SOUND_PER_DEGREE = 343.0, 331.3, 0.606
EPSILON = 1e-8


def wifi(a: Column, method: str = "minmax", absent: float = WIFI_ABSENT) -> Column:
    """RSSI vectors. ``standard`` uses detected values only and leaves a vector without any as it is."""
    gone = F.lit(absent)
    if method == "minmax":
        return F.transform(a, lambda v: (F.when(v == gone, WIFI_LOW).otherwise(v) - WIFI_LOW) / (WIFI_HIGH - WIFI_LOW))
    if method == "positive":
        return F.transform(a, lambda v: F.when(v == gone, 0.0).otherwise(F.abs(v)))
    if method == "standard":
        seen = F.filter(a, lambda v: v != gone)
        moments = F.struct(mean(seen).alias("m"), spread(seen).alias("s"))
        z = once(moments, lambda p: F.transform(a, lambda v: F.when(v == gone, 0.0).otherwise((v - p["m"]) / (p["s"] + EPSILON))))
        return F.when(F.size(seen) > 0, z).otherwise(a)
    raise ValueError(f"unknown method {method!r}")


def ble(a: Column, method: str = "minmax", absent: float = BLE_ABSENT) -> Column:
    """Beacon RSSI vectors; undetected become 0, an unknown method changes nothing."""
    gone = F.lit(absent)
    if method == "minmax":
        return F.transform(a, lambda v: F.when(v == gone, 0.0).otherwise((v - absent) / (BLE_HIGH - absent)))
    if method == "positive":
        return F.transform(a, lambda v: F.when(v == gone, 0.0).otherwise(v - absent))
    if method == "standard":
        seen = F.filter(a, lambda v: v != gone)
        moments = F.struct(mean(seen).alias("m"), spread(seen).alias("s"))
        return once(moments, lambda p: F.transform(a, lambda v: F.when((v == gone) | (p["s"] == 0), 0.0).otherwise((v - p["m"]) / p["s"])))
    return a


def ranges(a: Column, method: str = "minmax") -> Column:
    """Distances, flight times and light powers; a constant vector stays as it is."""
    methods: dict[str, Callable[[Column], Column]] = {"minmax": rescaled, "standard": standardised}
    if method not in methods:
        raise ValueError(f"unknown method {method!r}")
    return methods[method](a)


def detected(a: Column, absent: float = WIFI_ABSENT) -> Column:
    """Number of detected transmitters."""
    return F.size(F.filter(a, lambda v: v != F.lit(absent)))


def to_dense(sparse: Column, vocabulary: Column, fill: float = WIFI_ABSENT) -> Column:
    """A map's values in the vocabulary's order."""
    return F.transform(vocabulary, lambda k: F.coalesce(F.try_element_at(sparse, k), F.lit(float(fill))))


def to_sparse(dense: Column, vocabulary: Column, absent: float = WIFI_ABSENT) -> Column:
    """A map of detected values only."""
    return F.map_filter(F.map_from_arrays(vocabulary, dense), lambda _, v: v != F.lit(absent))


def reading(sparse: Column, key: Column, absent: float = WIFI_ABSENT) -> Column:
    """One transmitter's value; null if absent or marked undetected."""
    return F.nullif(F.try_element_at(sparse, key), F.lit(absent))


def sorted_values(m: Column) -> Column:
    """A map's values by key in code-point order, so ``A10`` comes before ``A2``."""
    return once(F.array_sort(F.map_keys(m)), lambda keys: F.transform(keys, lambda k: F.element_at(m, k)))


def beacon_id(uuid: Column, major: Column, minor: Column, mac: Column) -> Column:
    full = uuid.isNotNull() & major.isNotNull() & minor.isNotNull()
    return F.when(full, F.concat_ws(":", uuid, major.cast("string"), minor.cast("string"))).otherwise(F.coalesce(mac, F.lit("unknown")))


def path_loss_distance(rssi: Column, tx_power: Column, exponent: float = 2.0) -> Column:
    """Metres by the log-distance model; null without a transmit power."""
    return F.pow(F.lit(10.0), (tx_power - rssi) / F.lit(10.0 * exponent))


def light_distance(power: Column) -> Column:
    return F.when(power > 0, F.sqrt(1.0 / power))


def sound_speed(celsius: Column) -> Column:
    return F.coalesce(SOUND_AT_ZERO + SOUND_PER_DEGREE * celsius, F.lit(SOUND_SPEED))


def flight_distances(times: Column, speed: Column) -> Column:
    """Metres from a map of one-way flight times in seconds."""
    return F.transform_values(times, lambda _, t: t * speed)


def flight_times(distances: Column, speed: Column) -> Column:
    return F.transform_values(distances, lambda _, d: d / speed)


def weight_shares(weights: Column) -> Column:
    """A map's values as shares of their sum."""
    return once(total(F.map_values(weights)), lambda s: F.transform_values(weights, lambda _, w: w / s))


def fused(modalities: Column, weights: Column | None = None) -> Column:
    """Feature vectors by modality, joined in order of their names, each times its weight (1 if it has none)."""

    def part(k: Column) -> Column:
        values = F.element_at(modalities, k)
        if weights is None:
            return values
        return once(F.coalesce(F.try_element_at(weights, k), F.lit(1.0)), lambda w: F.transform(values, lambda v: v * w))

    return F.flatten(F.transform(F.array_sort(F.map_keys(modalities)), part))
