"""Adapters, functions in SQL, rows by number."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.functions import adapters as A
from beaconry.functions.sql import registered
from beaconry.operators.ranging import trilaterated
from beaconry.sources.store import RowStore


def vectors(spark):
    r = np.random.default_rng(1)
    told = [r.normal(0, 1, n).tolist() for n in (0, 1, 2, 5, 7, 12, 16, 30)]
    return told, spark.createDataFrame([(k, v) for k, v in enumerate(told)], "k int, v array<double>")


def stretched(a, size):
    a = np.asarray(a)
    at = np.maximum(0, (np.arange(size) + 0.5) * len(a) / size - 0.5)
    low = np.minimum(at.astype(int), len(a) - 1)
    return a[low] * (1 - (at - low)) + a[np.minimum(low + 1, len(a) - 1)] * (at - low)


@pytest.mark.parametrize(("stride", "padding", "dilation"), [(1, 0, 1), (2, 1, 1), (3, 4, 2)])
def test_convolution(spark, stride, padding, dilation):
    told, df = vectors(spark)
    kernel = [0.5, -1.0, 2.0]
    got = {r["k"]: r["c"] for r in df.select("k", A.convolved(F.col("v"), kernel, stride=stride, padding=padding, dilation=dilation, bias=0.25).alias("c")).collect()}
    for k, v in enumerate(told):
        p = np.concatenate([np.zeros(padding), v, np.zeros(padding)])
        want = [0.25 + sum(w * p[i + j * dilation] for j, w in enumerate(kernel)) for i in range(0, len(p) - 2 * dilation, stride)]
        assert got[k] == pytest.approx(want), k
    with pytest.raises(ValueError):
        A.convolved(F.col("v"), [])


def test_tiles_and_folds(spark):
    told, df = vectors(spark)
    rows = df.select("k", A.tiled(F.col("v"), 2, 9).alias("t"), A.folded(F.col("v"), 4, 6).alias("f"), A.channels(A.rectified(F.col("v")), [[1.0], [2.0]]).alias("c")).collect()
    for r in rows:
        v = told[r["k"]]
        if not v:
            assert r["t"] == [[], []] and r["f"] == []
            continue
        assert np.allclose(r["t"], [stretched(v, 9)] * 2)
        h = int(len(v) ** 0.5)
        w = -(-len(v) // h)
        m = np.concatenate([v, np.zeros(h * w - len(v))]).reshape(h, w)
        down = np.stack([stretched(m[:, c], 4) for c in range(w)], axis=1)
        assert np.allclose(r["f"], [stretched(row, 6) for row in down])
        assert np.allclose(r["c"], [np.maximum(0, v), 2 * np.maximum(0, v)])


def test_functions_in_sql(spark):
    names = registered(spark)
    assert {"wifi_unit", "trilaterate", "locate_by"} <= set(names)
    assert spark.sql("SELECT round(path_loss_distance(-60D, -40D, 2D), 6) AS d, detected(array(100D, -50D)) AS n").first() == (10.0, 1)
    masts = [(1, 0.0, 0.0, 3.0), (2, 10.0, 0.0, 0.0), (3, 0.0, 10.0, 1.0), (4, 10.0, 10.0, 4.0), (5, 5.0, 2.0, 9.0)]
    rows = [(k, a, x, y, z, float(np.sqrt((x - k) ** 2 + (y - 2) ** 2 + (z - 1) ** 2))) for k in range(5) for a, x, y, z in masts]
    rows += [(7, 1, 0.0, 0.0, 0.0, 1.0), (8, 1, None, 0.0, 0.0, 1.0), *((9, a, x, y, 0.0, 5.0) for a, x, y, _ in masts), *((10, a, x, y, z, -1.0) for a, x, y, z in masts)]
    df = spark.createDataFrame(rows, "sample_id long, anchor_id int, x double, y double, z double, distance double")
    df.createOrReplaceTempView("ranges_here")
    key = lambda out: sorted((r["sample_id"], *(round(r[c], 6) + 0.0 for c in ("px", "py", "pz"))) for r in out.collect())
    assert key(spark.sql("SELECT * FROM trilaterate(TABLE(ranges_here) PARTITION BY sample_id)")) == key(trilaterated(df))


def test_lookups_read_one_file(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.concat(F.lit("n"), F.col("id") * 7 % 1000).alias("name"))
    store = RowStore.write(df.repartition(6), str(tmp_path / "s"), order=["k"], size=90)
    assert len(store) == 1000 and store[5]["name"] == "n5" and store[-1]["k"] == 999
    again = RowStore(spark, str(tmp_path / "s"))
    assert len(again.rows([417]).inputFiles()) == 1 and again.rows([417]).first()["k"] == 417
    assert len(again.rows([3, 5, -1, 3]).inputFiles()) == 2 and sorted(r["k"] for r in again.rows([3, 5, -1, 3]).collect()) == [3, 5, 999]
    assert len(again[100:170].inputFiles()) == 1 and [r["k"] for r in again[10:300:50].orderBy("row").collect()] == [10, 60, 110, 160, 210, 260]
    assert [r["k"] for _, r in zip(range(200), again, strict=False)] == list(range(200)) and again[5:5].count() == 0
    for bad in (1000, -1001):
        with pytest.raises(IndexError):
            again[bad]
    assert len(RowStore.write(df.limit(0), str(tmp_path / "e"), order=["k"])) == 0
