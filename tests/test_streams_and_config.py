import json

import pytest
from pyspark.sql import functions as F

from beaconry.config import Config, merged
from beaconry.operators.knn import KNNLocalizer
from beaconry.operators.sequences import steps
from beaconry.registry import Registry
from beaconry.streaming import windows


@pytest.fixture
def events(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("user_id"), ((F.col("id") * 7) % 11).cast("double").alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), rows


def drained(query_of, name, spark):
    q = query_of.format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_windows_agree_with_the_table(spark, events):
    stream, rows = events
    live = drained(windows.tumbling(windows.stamped(stream, late="5 minutes"), "10 minutes", ["user_id"]).writeStream.outputMode("complete"), "tumbling_out", spark)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, windows.tumbling(windows.stamped(rows), "10 minutes", ["user_id"]).collect()))


def test_duplicates(spark, events):
    stream, _ = events
    live = drained(windows.deduplicated(windows.stamped(stream, late="2 hours"), ["user_id"]).writeStream.outputMode("append"), "dedup_out", spark)
    assert live.count() == 2


def test_steps_of_a_stream(spark, events):
    stream, rows = events
    live = drained(windows.stream_steps(stream).writeStream.outputMode("append"), "steps_out", spark)
    want = steps(rows, "value", key="user_id", order="event_id").select("user_id", "event_id")
    assert sorted(map(tuple, live.select("user_id", "event_id").collect())) == sorted(map(tuple, want.collect()))


def test_scoring_of_batches(spark, events, tmp_path):
    stream, _ = events
    train = spark.createDataFrame([(i, [float(i)], float(i), 0.0) for i in range(11)], "sample_id long, features array<double>, x double, y double")
    model = KNNLocalizer(k=1, predict_floor=False, predict_building=False).fit(train)
    out = str(tmp_path / "scored")
    q = stream.select(F.col("event_id").alias("sample_id"), F.array("value").alias("features")).writeStream.foreachBatch(windows.scored(model.predict, lambda df, _: df.write.mode("append").parquet(out))).start()
    q.processAllAvailable()
    q.stop()
    assert {r["query_id"]: r["pred_x"] for r in spark.read.parquet(out).collect()} == {i: float(i * 7 % 11) for i in range(60)}


def test_config(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"model": {"type": "knn", "k": 3, "weights": "uniform"}}))
    (tmp_path / "child.json").write_text(json.dumps({"_base_": "base.json", "model": {"k": 7}, "dataset": {"type": "uji"}}))
    c = Config.from_file(str(tmp_path / "child.json"))
    assert c.get("model.k") == 7 and c.model.weights == "uniform" and c["model.type"] == "knn" and not c.problems()
    assert c.overridden({"model.k": "[1, 2]", "model.note": "__import__('os')"}).get("model.note") == "__import__('os')"
    assert Config().problems() and merged({"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}
    with pytest.raises(KeyError):
        c["nothing"]


def test_registry():
    parent = Registry("all")
    child = Registry("own", parent)
    parent.register("dict")(dict)
    assert child.build({"type": "dict", "a": 1}, b=2) == {"a": 1, "b": 2} and "dict" in child
    with pytest.raises(KeyError):
        parent.register("dict")(dict)
    with pytest.raises(KeyError):
        child.build({"type": "none"})
