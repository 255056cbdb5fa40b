"""Made-up samples in the shape of a dataset, to try a pipeline without its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CATALOG, resolve

#: Transmitters of the made-up site, its sides in metres, its floors, and what a ceiling takes, in dB.
TRANSMITTERS, SIDE, FLOORS, CEILING = 24, 40.0, 3, 12.0


def _uniform(seed: int, *key: Column | str) -> Column:
    """From 0 to 1, the same for the same key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30)


def _metres(k: Column) -> Column:
    """From a sample to transmitter ``k``, whose place its number gives."""
    ax, ay = F.pmod(k * 7, F.lit(11)) * (SIDE / 10), F.pmod(k * 5, F.lit(13)) * (SIDE / 12)
    gap = (F.col("x") - ax) * (F.col("x") - ax) + (F.col("y") - ay) * (F.col("y") - ay)
    return F.sqrt(gap + 9 * _ceilings(k) * _ceilings(k) + 1)


def _ceilings(k: Column) -> Column:
    return F.abs(F.col("floor") - F.pmod(k, F.lit(FLOORS)))


def demo(spark: SparkSession, name: str, rows: int = 1000, *, seed: int = 42) -> DataFrame:
    """``rows`` samples with the columns of dataset ``name``: places are uniform, signals follow the distance with noise.

    The same arguments give the same rows, in any number of tasks.
    """
    spec = CATALOG[resolve(name)]
    base = spark.range(rows).withColumnRenamed("id", "sample_id")
    base = base.withColumns({"x": _uniform(seed, "sample_id", F.lit("x")) * SIDE, "y": _uniform(seed, "sample_id", F.lit("y")) * SIDE, "floor": F.floor(_uniform(seed, "sample_id", F.lit("f")) * FLOORS).cast("int"), "building": F.lit("0")})
    numbers = F.sequence(F.lit(0), F.lit(TRANSMITTERS - 1))
    noise = lambda k: (_uniform(seed, "sample_id", k) - 0.5) * 4
    power = lambda absent: F.transform(numbers, lambda k: F.when(_metres(k) < SIDE * 0.7, -35 - 20 * F.log10(_metres(k)) - CEILING * _ceilings(k) + noise(k)).otherwise(F.lit(absent).cast("double")))
    named = F.transform(numbers, lambda k: F.concat(F.lit("T"), k.cast("string")))
    field = F.array(30 + F.sin("x") * 5, F.cos("y") * 5, -40 + F.col("floor").cast("double"))
    absent = 100.0 if spec.absent is None else spec.absent
    if spec.signal in ("wifi", "csi"):
        return base.withColumn("features", power(absent))
    if spec.signal == "magnetic":
        return base.withColumn("features", field)
    if spec.signal == "hybrid":
        return base.withColumn("modalities", F.create_map(F.lit("wifi"), power(absent), F.lit("magnetic"), field))
    if spec.signal == "ble":
        heard = F.map_filter(F.map_from_arrays(named, power(-1000.0)), lambda _, v: v > -1000)
        return base.withColumn("readings", heard)
    if spec.signal == "rfid":
        return base
    metres = F.transform(F.slice(numbers, 1, 6), lambda k: _metres(k) + noise(k) / 40)
    return base.withColumn("readings", F.map_from_arrays(F.slice(named, 1, 6), metres))
