"""The ball index against meeting all blocks; odd vectors in the neighbour operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.operators import balls, knn
from beaconry.operators.knn import KNNLocalizer, neighbours, set_aside


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + k, [float(x) for x in v]) for k, v in enumerate(vectors)], "sample_id long, features array<double>")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["reference_id"], round(r["distance"], 9)) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(balls, "BALL", 20)
    monkeypatch.setattr(balls, "QUERIES", 30)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "minkowski"])
def test_index_equals_all_blocks(spark, small, metric):
    r = np.random.default_rng(3)
    centres = r.normal(0, 40, (12, 4))
    refs = np.concatenate([c + r.normal(0, 1, (60, 4)) for c in centres] + [np.zeros((70, 4)), r.integers(0, 3, (60, 4))])
    asked = np.concatenate([refs[::40] + r.normal(0, 0.5, refs[::40].shape), np.zeros((2, 4)), r.normal(0, 60, (8, 4))])
    q, t = frame(spark, asked), frame(spark, refs, 1000)
    index = balls.BallIndex.built(t, metric=metric, p=3.0, rows=1)
    assert len(index.shells.block) > 20 and index.shells.rows.sum() == len(refs)
    assert rows(index.neighbours(q, 4)) == rows(neighbours(q, t, 4, metric=metric, p=3.0))
    met, every = index.met(q, 4)
    assert met < every / 3, (met, every)


def test_more_neighbours_than_references(spark, small):
    r = np.random.default_rng(1)
    q, t = frame(spark, r.normal(0, 1, (5, 2))), frame(spark, r.normal(0, 1, (45, 2)), 50)
    assert rows(balls.BallIndex.built(t).neighbours(q, 60)) == rows(neighbours(q, t, 60))
    assert balls.BallIndex.built(t.limit(0)).neighbours(q, 3).count() == 0
    assert balls.BallIndex.built(t).neighbours(q.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="triangle"):
        balls.BallIndex.built(t, metric="cosine")
    with pytest.raises(ValueError, match="elements"):
        balls.BallIndex.built(t).neighbours(frame(spark, np.zeros((2, 3))), 3)


def test_localizer_with_an_index(spark, small, tmp_path):
    r = np.random.default_rng(5)
    told = frame(spark, r.normal(0, 5, (300, 3))).withColumns({"x": F.col("sample_id") * 1.0, "y": F.lit(2.0), "floor": F.col("sample_id") % 3})
    asked = frame(spark, r.normal(0, 5, (20, 3)), 500)
    plain = KNNLocalizer(k=3, algorithm="brute").fit(told)
    model = KNNLocalizer(k=3, algorithm="ball_tree").fit(told)
    model.save(str(tmp_path / "m"))
    again = KNNLocalizer.load(spark, str(tmp_path / "m"))
    assert plain.index is None and again.index is not None and again.algorithm == "ball_tree"
    key = lambda m: sorted((r["query_id"], round(r["pred_x"], 9), r["pred_floor"]) for r in m.predict(asked).collect())
    assert key(plain) == key(model) == key(again)
    with pytest.raises(ValueError):
        KNNLocalizer(algorithm="ball_tree", metric="cosine")


ODD = [(1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, None), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (None, [0.0, 0.0]), (6, [3.0, 4.0])]


def test_vectors_that_cannot_be_compared(spark):
    """They are set aside and cost no other row its neighbours."""
    schema = "sample_id long, features array<double>"
    df = spark.createDataFrame(ODD, schema)
    assert set_aside(df) == 5
    for metric in knn.METRICS:
        got = {(r["query_id"], r["reference_id"]) for r in neighbours(df, df, 2, metric=metric).collect()}
        assert got == {(1, 1), (1, 6), (6, 1), (6, 6)}, metric
    assert rows(balls.BallIndex.built(df).neighbours(df, 2)) == rows(neighbours(df, df, 2))
    told = df.withColumns({"x": F.col("sample_id") * 1.0, "y": F.lit(0.0), "floor": F.lit(1)})
    model = KNNLocalizer(k=1).fit(told)
    assert model.left_out == 5
    out = {r["query_id"]: r for r in model.predict(df).collect()}
    assert set(out) == {1, 2, 3, 4, 5, 6, None} and out[1]["pred_x"] == 1.0 and out[2]["pred_x"] is None and out[3]["floor_confidence"] == 0.0 and out[2]["confidence"] == 0.0
    with pytest.raises(ValueError, match="fewer"):
        KNNLocalizer(k=3).fit(told)


def test_widths_must_agree(spark):
    two, mixed = frame(spark, [[0, 0], [1, 1]]), spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], "sample_id long, features array<double>")
    with pytest.raises(ValueError, match="2 to 4"):
        neighbours(two, mixed, 1)
    with pytest.raises(ValueError, match="references of 3"):
        neighbours(two, frame(spark, [[0, 0, 0]]), 1)


def test_one_id_in_many_rows_fills_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "REFERENCES", 10)
    same = spark.createDataFrame([(7, [float(k), 0.0]) for k in range(200)], "sample_id long, features array<double>")
    packs, blocks = knn._packed(knn.usable(same, "sample_id", "features"), 200, 2, 10, "r")
    assert blocks == 20 and packs.selectExpr("max(size(r_ids)) m").first()["m"] < 30
    assert [r["distance"] for r in neighbours(frame(spark, [[50.2, 0]]), same, 2).orderBy("rank").collect()] == pytest.approx([0.2, 0.8])


@pytest.mark.parametrize(("metric", "p"), [("euclidean", 2.0), ("manhattan", 1.0), ("minkowski", 3.0), ("cosine", 2.0)])
def test_bounds_spare_exact_distances(metric, p):
    """Few references are left to exact distances for any metric, and none that belongs there is missing."""
    r = np.random.default_rng(2)
    refs, asked = np.maximum(0, r.normal(0, 0.12, (4000, 32))), np.maximum(0, r.normal(0, 0.12, (20, 32)))
    near = list(knn._near(asked, refs, metric, p, 5, 0.0))
    for q, may in zip(asked, near, strict=True):
        d = knn.distances(q, refs, metric, p)
        assert set(np.flatnonzero(d <= np.partition(d, 4)[4])) <= set(may)
    assert sum(map(len, near)) < len(asked) * len(refs) * 0.4


def test_vectors_travel_once_for_a_group(spark, small, monkeypatch):
    """Where no bound excludes a shell, a query meets each group once."""
    monkeypatch.setattr(balls, "GROUPS", 3)
    r = np.random.default_rng(7)
    q, t = frame(spark, r.normal(0, 1, (25, 16))), frame(spark, r.normal(0, 1, (600, 16)), 1000)
    index = balls.BallIndex.built(t, metric="manhattan", rows=1)
    assert len(index.shells.block) > 12 and len(index.shells.groups()) <= 4
    assert rows(index.neighbours(q, 3)) == rows(neighbours(q, t, 3, metric="manhattan"))
    assert index._pairs(q, 3, "sample_id", "features")[1][1].selectExpr("sum(size(q_ids)) n").first()["n"] <= 25 * 4


def test_groups_are_no_larger_than_the_joins_blocks():
    """However many references there are, a task holds few of them for each row."""
    n = 2000
    shells = balls.Shells(np.zeros((1, 2)), np.arange(n), np.zeros(n, int), np.zeros(n), np.ones(n), np.full(n, 500))
    sizes = np.add.reduceat(shells.rows, shells.groups())
    assert sizes.sum() == n * 500 and sizes.max() <= knn.JOINED + 500, sizes.max()
