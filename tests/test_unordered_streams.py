"""Streams whose rows come late and in any order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from beaconry.operators.sequences import nearest_in_time, steps
from beaconry.streaming import windows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.unset(key)


def files(spark, folder, parts, schema):
    """A stream that reads one part a micro-batch, in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k:03}")
    import glob
    import os
    import shutil

    os.makedirs(f"{folder}/in")
    for k in range(len(parts)):
        shutil.move(glob.glob(f"{folder}/{k:03}/*.parquet")[0], f"{folder}/in/{k:03}.parquet")
        os.utime(f"{folder}/in/{k:03}.parquet", (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drained(df, name, spark, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/state-{name}").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def moment(seconds):
    import datetime as dt

    return dt.datetime.fromtimestamp(seconds, dt.timezone.utc)


def test_steps_of_shuffled_samples(spark, tmp_path, rocks):
    rnd = random.Random(1)
    samples = [(u, k, moment(1_000_000 + k), float(rnd.randrange(9))) for u in (1, 2) for k in range(60)]
    shuffled = sorted(samples, key=lambda r: (r[1] // 10 * 10 + rnd.randrange(14), r[0]))
    late = (1, 900, moment(1_000_002.5), 99.0)  # comes after the watermark has passed it
    parts = [shuffled[at : at + 20] for at in range(0, 120, 20)] + [[(3, 0, moment(1_002_000), 0.0)], [late, (3, 1, moment(1_003_000), 0.0)]]
    schema = "user_id long, event_id long, ts timestamp, value double"
    live = drained(windows.unordered_steps(files(spark, tmp_path, parts, schema), late="30 seconds"), "unordered_out", spark, tmp_path)
    want = steps(spark.createDataFrame(samples, schema), "value", key="user_id", order="ts").select("user_id", "event_id", "value")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10


def test_idle_keys_are_forgotten(spark, tmp_path, rocks):
    def at(u, k, t, v):
        return (u, k, moment(1_000_000 + t), v)

    # the two halves of a step lie further apart than a key is remembered
    parts = [[at(1, 0, 0, 0.0), at(1, 1, 1, 9.0)], [at(2, 0, 500, 0.0)], [at(2, 1, 900, 0.0)], [at(1, 2, 901, 0.0), at(1, 3, 902, 5.0), at(1, 4, 903, 0.0)], [at(2, 2, 2000, 0.0)], [at(2, 3, 3000, 0.0)]]
    stream = files(spark, tmp_path, parts, "user_id long, event_id long, ts timestamp, value double")
    live = drained(windows.unordered_steps(stream, late="10 seconds", idle_ms=60_000), "idle_out", spark, tmp_path)
    assert sorted(map(tuple, live.collect())) == [(1, 3, 5.0)]


def test_nearest_pairs_of_streams(spark, tmp_path):
    rnd = random.Random(2)
    left = [(k % 3, k, moment(1_000_000 + 7 * k)) for k in range(40)]
    right = [(rnd.randrange(2), moment(1_000_000 + rnd.randrange(280)), float(k)) for k in range(30)]
    order_a, order_b = (sorted(rows, key=lambda r: r[at].timestamp() + rnd.randrange(20)) for rows, at in ((left, 2), (right, 1)))
    end = [(9, 99, moment(1_010_000))]
    late_left, late_right = [(1, 77, moment(1_000_010))], [(1, moment(1_000_010), 5.0)]
    a = files(spark, tmp_path / "a", [order_a[:20], order_a[20:], end, [*late_left, (9, 98, moment(1_020_000))], [(9, 97, moment(1_030_000))]], "key int, row int, ts timestamp")
    b = files(spark, tmp_path / "b", [order_b[:15], order_b[15:], [(9, moment(1_010_100), 0.0)], [*late_right, (9, moment(1_020_100), 0.0)], [(9, moment(1_030_100), 0.0)]], "key int, ts timestamp, told double")
    live = drained(windows.nearest_pairs(a, b, ("told",), key="key", row="row", time="ts", tolerance="6 seconds", late="30 seconds"), "nearest_out", spark, tmp_path)
    got = sorted((r["row"], r["told"], r["gap"]) for r in live.where("key < 9").collect())
    seconds = F.unix_micros("ts") / 1e6
    table = nearest_in_time(spark.createDataFrame(left, "key int, row int, ts timestamp").withColumn("t", seconds), spark.createDataFrame(right, "key int, ts timestamp, told double").withColumn("t", seconds), ("told",), key="key", time="t", tolerance=6.0)
    assert got == sorted((r["row"], r["told"], r["gap"]) for r in table.collect())
    assert any(t is None for _, t, _ in got) and any(t is not None for _, t, _ in got) and 77 not in {g[0] for g in got}
