import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.functions import csi, geometry, signals, vectors


def one(spark, column, **values):
    """The value of a column over one row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*(F.lit(x).cast("double") for x in v)).alias(k) for k, v in values.items()))
    return row.select(column.alias("out")).first()["out"]


def test_wifi_normalisers(spark):
    v = [-100.0, -50.0, 100.0, -30.0]
    assert one(spark, signals.wifi(F.col("v")), v=v) == pytest.approx([4 / 104, 54 / 104, 0, 74 / 104])
    assert one(spark, signals.wifi(F.col("v"), "positive"), v=v) == [100, 50, 0, 30]
    seen = np.array([-100.0, -50, -30])
    want = (seen - seen.mean()) / (seen.std() + 1e-8)
    assert one(spark, signals.wifi(F.col("v"), "standard"), v=v) == pytest.approx([want[0], want[1], 0, want[2]])
    assert one(spark, signals.wifi(F.col("v"), "standard"), v=[100.0, 100.0]) == [100, 100]
    with pytest.raises(ValueError):
        signals.wifi(F.col("v"), "other")


def test_ble(spark):
    assert one(spark, signals.detected(F.col("v"), -100.0), v=[-65.0, -72.0, -100.0, -100.0]) == 2
    assert one(spark, signals.ble(F.col("v"), "standard"), v=[-65.0, -65.0, -100.0]) == [0, 0, 0]
    assert one(spark, signals.ble(F.col("v"), "unknown"), v=[-65.0]) == [-65]
    assert one(spark, signals.path_loss_distance(F.col("r"), F.col("t")), r=-65.0, t=-59.0) == pytest.approx(10**0.3)
    assert one(spark, signals.path_loss_distance(F.col("r"), F.lit(None).cast("double")), r=-65.0) is None


def test_ranges_light_and_sound(spark):
    assert one(spark, signals.ranges(F.col("v")), v=[5.0, 10.0, 15.0]) == [0, 0.5, 1]
    assert one(spark, signals.ranges(F.col("v"), "standard"), v=[3.0, 3.0]) == [3, 3]
    assert one(spark, signals.light_distance(F.col("p")), p=0.5) == pytest.approx(math.sqrt(2))
    assert one(spark, signals.light_distance(F.col("p")), p=0.0) is None
    assert one(spark, signals.sound_speed(F.col("t")), t=20.0) == pytest.approx(343.42)
    assert one(spark, signals.sound_speed(F.lit(None).cast("double")), t=0.0) == 343
    assert one(spark, signals.flight_distances(F.create_map(F.lit("U"), F.lit(0.01)), F.lit(343.0)), t=0.0) == {"U": pytest.approx(3.43)}


def test_sparse_and_dense(spark):
    m = F.create_map(F.lit("b"), F.lit(-50.0), F.lit("a"), F.lit(-60.0))
    vocabulary = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert one(spark, signals.to_dense(m, vocabulary), x=0) == [-60, -50, 100]
    assert one(spark, signals.to_sparse(signals.to_dense(m, vocabulary), vocabulary), x=0) == {"a": -60, "b": -50}
    assert one(spark, signals.reading(m, F.lit("zz")), x=0) is None
    assert one(spark, signals.beacon_id(F.lit("u"), F.lit(1), F.lit(2), F.lit("m")), x=0) == "u:1:2"
    assert one(spark, signals.beacon_id(F.lit(None), F.lit(1), F.lit(2), F.lit(None).cast("string")), x=0) == "unknown"


def test_geometry(spark):
    assert one(spark, geometry.magnitude(F.col("a"), F.col("b"), F.col("c")), a=3.0, b=4.0, c=0.0) == 5
    assert one(spark, geometry.heading(F.col("a"), F.col("b")), a=0.0, b=1.0) == pytest.approx(math.pi / 2)
    assert one(spark, geometry.matches(F.lit(None).cast("int"), F.col("a")), a=1) is True
    assert one(spark, geometry.latlon(F.col("a"), F.lit(None).cast("double")), a=1.0) is None
    assert one(spark, geometry.confidence(F.col("u")), u=30.0) == 0


def test_channels_and_fusion(spark):
    z = csi.from_parts(F.col("r"), F.col("i"))
    assert one(spark, csi.magnitudes(z), r=[3.0, 0.0], i=[4.0, 0.0]) == [5, 0]
    assert one(spark, csi.magnitudes(csi.normalised(z, "unit")), r=[3.0, 0.0], i=[4.0, 0.0]) == pytest.approx([1, 0])
    assert one(spark, csi.antennas(F.array(F.lit(2), F.lit(3), F.lit(8))), r=0) == 6
    parts = F.create_map(F.lit("wifi"), F.array(F.lit(1.0)), F.lit("ble"), F.array(F.lit(2.0), F.lit(3.0)))
    assert one(spark, signals.fused(parts), r=0) == [2, 3, 1]
    assert one(spark, signals.fused(parts, F.create_map(F.lit("ble"), F.lit(0.5))), r=0) == [1, 1.5, 1]
    assert sum(one(spark, signals.weight_shares(F.create_map(F.lit("a"), F.lit(7.0), F.lit("b"), F.lit(3.0))), r=0).values()) == pytest.approx(1)


def test_vectors(spark):
    assert one(spark, vectors.spread(F.col("v")), v=[1.0, 2.0, 4.0]) == pytest.approx(np.std([1, 2, 4]))
    assert one(spark, vectors.argmax(F.col("v")), v=[1.0, 5.0, 5.0]) == 1
    assert sum(one(spark, vectors.softmax(F.col("v")), v=[1.0, 700.0])) == pytest.approx(1)
    assert one(spark, vectors.padded(F.col("v"), 3, 9.0), v=[1.0]) == [1, 9, 9]
    assert one(spark, vectors.padded(F.col("v"), 1, 9.0), v=[1.0, 2.0]) == [1]
