"""The network locator: gradients, better than a linear head, reruns that agree, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.models import create_model, evaluate, labels, load_model
from beaconry.operators.heads import learned
from beaconry.operators.network import Network, NetworkLocalizer


def test_gradient():
    r = np.random.default_rng(1)
    net, x, at, floor = Network.started(4, (5, 3), 3, 2), r.normal(0, 1, (6, 4)), r.normal(0, 1, (6, 2)), np.array([0, 2, -1, 1, 1, -1])
    _, grads = net.loss(x, at, floor, 0.7)
    for a, g in zip(net.arrays, grads, strict=True):
        for k in np.ndindex(a.shape):
            a[k] += 1e-6
            up, _ = net.loss(x, at, floor, 0.7, slopes=False)
            a[k] -= 2e-6
            down, _ = net.loss(x, at, floor, 0.7, slopes=False)
            a[k] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(g[k], rel=1e-4, abs=1e-5)


@pytest.fixture(scope="module")
def data(spark):
    """Powers that fall with the distance from transmitters: positions aren't linear in them."""
    r = np.random.default_rng(7)
    masts, places = r.uniform(0, 20, (6, 2)), r.uniform(0, 20, (900, 2))
    power = -20 * np.log10(1 + np.sqrt(((places[:, None] - masts) ** 2).sum(axis=2)))
    rows = [(k, p.tolist(), float(x), float(y), None if k % 9 == 0 else int(x > 10) + 2 * int(y > 10)) for k, (p, (x, y)) in enumerate(zip(power, places, strict=True))]
    df = spark.createDataFrame(rows, "sample_id long, features array<double>, x double, y double, floor int")
    return df.where("sample_id < 700"), df.where("sample_id >= 700")


def error(df, truth):
    both = df.join(truth.select(F.col("sample_id").alias("query_id"), "x", "y", "floor"), "query_id")
    return both.agg(F.avg(F.hypot(F.col("pred_x") - F.col("x"), F.col("pred_y") - F.col("y"))), F.avg((F.col("pred_floor") == F.col("floor")).cast("int"))).first()


def test_beats_the_linear_head_and_reruns_agree(spark, data, tmp_path):
    train, test = data
    options = {"epochs": 12, "batch": 160, "patience": 12, "rate": 2e-2}
    model = NetworkLocalizer((24,), **options).fit(train)
    metres, floors = error(model.predict(test), test)
    linear = learned(train.na.fill({"floor": 0}), test).withColumnRenamed("sample_id", "query_id").select("query_id", "pred_x", "pred_y", "pred_floor")
    assert metres < 0.8 * error(linear, test)[0] and floors > 0.85, (metres, floors, error(linear, test))
    again = NetworkLocalizer((24,), **options).fit(train.repartition(3))
    assert all((a == b).all() for a, b in zip(model.network.arrays, again.network.arrays, strict=True))
    model.save(str(tmp_path / "m"))
    loaded = load_model(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, loaded.predict(test).collect())) == sorted(map(tuple, model.predict(test).collect()))
    assert evaluate(loaded, test).first()["mean_error"] == pytest.approx(metres)
    odd = spark.createDataFrame([(1, [0.0, None, 0.0, 0.0, 0.0, 0.0]), (2, None), (3, [0.0] * 6), (4, [float("nan")] * 6)], "sample_id long, features array<double>")
    assert {r["query_id"]: r["pred_x"] is None for r in loaded.predict(odd).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_odd_training_rows(spark):
    rows = [(k, [float(k % 5), 1.0], float(k % 5), 0.0) for k in range(30)] + [(90, [None, 1.0], 1.0, 1.0), (91, None, 1.0, 1.0), (92, [1.0, 1.0], None, 1.0), (None, [1.0, 1.0], 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sample_id long, features array<double>, x double, y double")
    model = NetworkLocalizer((), epochs=2).fit(df)
    assert model.floors == [] and model.predict(df).columns == ["query_id", "pred_x", "pred_y"] and model.predict(df).count() == len(rows)
    with pytest.raises(ValueError, match="no fingerprint"):
        NetworkLocalizer().fit(df.limit(0))


def test_auto_and_labels(spark, monkeypatch):
    from beaconry import models

    monkeypatch.setattr(models, "FEW", 5)
    assert type(create_model("auto", dataset=spark.range(6))) is NetworkLocalizer and type(create_model("auto", dataset=spark.range(5))) is not NetworkLocalizer
    assert create_model({"type": "auto", "epochs": 3}, dataset=spark.range(6)).epochs == 3 and create_model().k == 5
    schema = "sample_id long, x double, y double, floor int, building string"
    assert [tuple(r) for r in labels(spark.createDataFrame([(1, 1.0, 2.0, None, "3"), (2, 1.0, 2.0, 4, None)], schema)).collect()] == [(1, 1.0, 2.0, -1, 3), (2, 1.0, 2.0, 4, -1)]
    with pytest.raises(Exception, match="whole number"):
        labels(spark.createDataFrame([(1, 1.0, 2.0, None, "west")], schema)).collect()
