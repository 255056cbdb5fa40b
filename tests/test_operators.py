import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.models import create_model, evaluate, with_truth
from beaconry.operators import knn, leaderboard, metrics, sequences, shaping
from beaconry.operators.knn import KNNLocalizer, WKNNLocalizer, neighbours
from beaconry.operators.ranging import trilaterated

PAIRS = "id int, pred_x double, pred_y double, gt_x double, gt_y double, pred_floor int, gt_floor int, pred_building string, gt_building string"


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(1, 10.0, 10.0, 12.0, 12.0, 0, 0, "0", "0"), (2, 25.0, 25.0, 20.0, 20.0, 1, 1, "0", "0"), (3, 55.0, 55.0, 50.0, 50.0, 2, 2, "1", "0"), (4, 80.0, 80.0, 75.0, 75.0, 3, 2, "1", "1")]
    return spark.createDataFrame(rows, PAIRS)


def test_metrics(pairs):
    r = metrics.results(pairs).first()
    assert r["mean_error"] == pytest.approx(4.25 * 2**0.5)
    assert r["median_error"] == r["p75_error"] == r["max_error"] == pytest.approx(5 * 2**0.5)
    assert r["rms_error"] == pytest.approx(39.5**0.5)
    assert (r["floor_accuracy"], r["building_accuracy"]) == (75, 75)
    assert metrics.evaluated(pairs, ("floor_building_accuracy",)).first()[0] == 50
    within = metrics.with_error(pairs).agg(*metrics.within()).first()
    assert list(within) == [0, 0, 25, 25, 100, 100, 100]


def test_curves(pairs):
    errors = metrics.with_error(pairs)
    curve = metrics.cdf_curve(errors, 10).orderBy("point").collect()
    e = np.array([r["error_2d"] for r in errors.collect()])
    assert [r["fraction"] for r in curve] == pytest.approx([(e <= v).mean() for v in np.linspace(0, e.max(), 10)])
    assert sum(r["n"] for r in metrics.histogram(errors, 5).collect()) == 4
    assert sorted(r["fraction"] for r in metrics.empirical_cdf(errors, "id").collect()) == [0.25, 0.5, 0.75, 1]


def test_unknown_values_agree_in_accuracy(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, None, None, None, "0")], PAIRS)
    r = metrics.evaluated(df, ("floor_accuracy", "building_accuracy")).first()
    assert list(r) == [100, 0]
    assert metrics.results(df.limit(0)).first()["mean_error"] is None


def test_register_metric(pairs):
    metrics.register_metric("least_error", "m", lambda **_: F.min(metrics.ERROR))
    assert metrics.evaluated(pairs, ("least_error",)).first()[0] == pytest.approx(8**0.5)
    with pytest.raises(KeyError):
        metrics.register_metric("least_error", "m", None)


@pytest.fixture(scope="module")
def prints(spark):
    rng = np.random.default_rng(42)
    rows = [(i, rng.uniform(-100, -30, 20).tolist(), float(rng.uniform(0, 100)), float(rng.uniform(0, 100)), int(rng.integers(0, 3)), str(int(rng.integers(0, 2)))) for i in range(120)]
    df = spark.createDataFrame(rows, "sample_id long, features array<double>, x double, y double, floor int, building string")
    return df.where("sample_id < 100"), df.where("sample_id >= 100"), rows


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine", "minkowski"])
def test_neighbours(prints, metric):
    train, test, rows = prints
    got = {}
    for r in neighbours(test, train, 3, metric=metric, p=3.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["reference_id"]))
    for i, v, *_ in rows[100:]:
        a, b = np.array(v), np.array([r[1] for r in rows[:100]])
        d = {"euclidean": np.sqrt(((a - b) ** 2).sum(1)), "manhattan": np.abs(a - b).sum(1), "minkowski": (np.abs(a - b) ** 3).sum(1) ** (1 / 3), "cosine": 1 - b @ a / np.sqrt((b * b).sum(1) * (a * a).sum())}[metric]
        assert [r for _, r in sorted(got[i])] == np.argsort(d, kind="stable")[:3].tolist()


def test_locators(spark, prints, tmp_path):
    train, test, rows = prints
    model = KNNLocalizer(k=3).fit(train)
    model.save(str(tmp_path / "m"))
    want = {r["query_id"]: r for r in model.predict(test).collect()}
    got = {r["query_id"]: r for r in KNNLocalizer.load(spark, str(tmp_path / "m")).predict(test).collect()}
    assert len(want) == 20
    assert all(got[k]["pred_x"] == pytest.approx(want[k]["pred_x"], rel=1e-5) and got[k]["pred_floor"] == want[k]["pred_floor"] for k in want)
    at_home = WKNNLocalizer(k=3, weights="uniform").fit(train).predict(train.limit(5)).collect()
    assert all(r["pred_x"] == pytest.approx(rows[r["query_id"]][2]) for r in at_home)
    assert evaluate(create_model("auto", k=3).fit(train), test).count() == 1
    with pytest.raises(ValueError):
        KNNLocalizer(k=3).fit(train.limit(2))
    with pytest.raises(RuntimeError):
        KNNLocalizer().predict(test)


def test_labels_that_are_unknown(prints):
    train, test, _ = prints
    out = KNNLocalizer(k=3, predict_building=False).fit(train.withColumn("floor", F.lit(None).cast("int"))).predict(test)
    assert out.where("pred_floor is null and floor_confidence = 0").count() == 20
    assert with_truth(out, test).where("pred_building is null").count() == 20


def test_trilateration(spark):
    anchors = {"A": (0.0, 0.0, 0.0), "B": (10.0, 0.0, 2.0), "C": (10.0, 10.0, 1.0), "D": (0.0, 10.0, 3.0), "E": (5.0, 5.0, 9.0)}
    p = np.array([3.0, 4.0, 1.5])
    rows = [(1, k, *a, float(np.linalg.norm(p - a))) for k, a in anchors.items()]
    flat = [(2, k, a[0], a[1], 2.5, float(np.linalg.norm([3, 4, 2.5] - np.array([a[0], a[1], 2.5])))) for k, a in anchors.items()]
    few = [(3, "A", 0.0, 0.0, 0.0, 1.0), (4, "A", None, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows + flat + few, "sample_id int, anchor_id string, x double, y double, z double, distance double")
    got = {r["sample_id"]: list(r)[1:] for r in trilaterated(df).collect()}
    assert set(got) == {1, 2}
    assert got[1] == pytest.approx(p.tolist())
    assert got[2] == pytest.approx([3, 4, 0], abs=1e-6)
    assert [r["px"] for r in trilaterated(df, flipped=True).where("sample_id = 1").collect()] == pytest.approx([-3])


def test_sequences(spark):
    rows = [(1, i, i / 100, v) for i, v in enumerate([9.8, 12.0, 9.0, 9.1, 9.0, 13.0])]
    df = spark.createDataFrame(rows, "sample_id int, idx int, ts double, magnitude double")
    assert [r["idx"] for r in sequences.steps(df).collect()] == [1]
    assert df.groupBy("sample_id").agg(sequences.sampling_rate()).first()[1] == pytest.approx(100)
    assert df.groupBy("sample_id").agg(sequences.duration()).first()[1] == pytest.approx(0.05)
    assert sequences.window_of(df, 2, 3).count() == 3
    assert sequences.axis_scaled(df.where("idx = 0"), ("magnitude",)).first()["magnitude"] == 0


def test_shaping(spark):
    wide = spark.createDataFrame([(1, "a", 1.0, " ", 2.0), (2, "nan", 1.0, "b", None), (3, " a ", 5.0, "b", 6.0)], "k int, i1 string, v1 double, i2 string, v2 double")
    long = shaping.unpivoted(wide, [("i1", "v1"), ("i2", "v2")])
    assert sorted(map(tuple, long.collect())) == [(1, "a", 1.0), (3, "a", 5.0), (3, "b", 6.0)]
    assert shaping.vocabulary(long).first()[0] == ["a", "b"]
    ids = spark.range(10)
    train, test = (shaping.row_split(ids, 0.7, "id", train=t) for t in (True, False))
    assert sorted(r[0] for r in train.collect()) == list(range(7))
    assert sorted(r[0] for r in test.collect()) == [7, 8, 9]
    a, b = (shaping.random_split(ids, 0.8, "id", train=t) for t in (True, False))
    assert a.count() == 8 and b.count() == 2 and a.intersect(b).count() == 0


def test_leaderboard(spark):
    board = leaderboard.published(spark, "UJI")
    assert board.count() == 14
    assert leaderboard.state_of_the_art(board).first()["sota_error"] == 2.45
    r = leaderboard.compared(spark.createDataFrame([("ujindoorloc", 7.9)], "dataset string, mean_error double"), board).first()
    assert (r["beats_count"], r["ranking"], r["num_entries"]) == (6, 8, 14)
    own = leaderboard.registered(spark, board, "Mine", [("a", 1.0, None, None, 2020, "s", False)])
    assert own.where("dataset = 'mine'").count() == 1


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
@pytest.mark.parametrize(("size", "scale"), [(7, 1.0), (1000, 1e6)])
def test_neighbours_by_brute_force(spark, monkeypatch, metric, size, scale):
    """Ties, equal vectors, far origins and blocks of few rows or bytes."""
    monkeypatch.setattr(knn, "REFERENCES", size)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 40 * size)
    r = np.random.default_rng(1)
    q, t = (scale + r.integers(0, 4, (n, 3)).astype(float) for n in (12, 60))
    q[0] = t[0] = 0
    frame = lambda a: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(a)], "sample_id long, features array<double>")
    got = {}
    for x in knn.neighbours(frame(q), frame(t), 4, metric=metric).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["reference_id"], x["distance"]))
    near = [(a["query_id"], a["reference_id"]) for a in knn.within(frame(q), frame(t), 1.5, metric=metric).collect()]
    for k, one in enumerate(q):
        d = knn.distances(one, t, metric, 2.0)
        order = sorted(range(len(t)), key=lambda j: (d[j], j))[:4]
        assert [(i, pytest.approx(x)) for _, i, x in sorted(got[k])] == [(j, d[j]) for j in order]
        assert sorted(j for i, j in near if i == k) == np.flatnonzero(d < 1.5).tolist()


def test_similarity_join_on_disk_and_in_memory(spark, monkeypatch):
    """Blocks are paired from files, not shuffled once for each that they meet, and a batch has a bounded number of pairs."""
    monkeypatch.setattr(knn, "QUERIES", 5)
    monkeypatch.setattr(knn, "REFERENCES", 8)
    r = np.random.default_rng(3)
    q, t = r.normal(0, 1, (40, 4)), r.normal(0, 1, (100, 4))
    frame = lambda a: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(a)], "sample_id long, features array<double>")
    pairs = knn.within(frame(q), frame(t), 2.0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(axis=2))
    assert sorted((x["query_id"], x["reference_id"]) for x in pairs.collect()) == [tuple(x) for x in np.argwhere(d < 2.0).tolist()]
    assert knn.within(frame(q), frame(t).limit(0), 2.0).count() == knn.within(frame(q).limit(0), frame(t), 2.0).count() == 0

    monkeypatch.setattr(knn, "PAIRS", 10)
    rows = [(np.full(n, k), np.arange(n), np.zeros(n)) for k, n in enumerate([4, 0, 7, 3, 12, 1])]
    batches = list(knn._told(iter(rows)))
    assert [b.num_rows for b in batches] == [11, 15, 1] and [x for b in batches for x in b.column(0).to_pylist()] == np.concatenate([x[0] for x in rows]).tolist()
    assert list(knn._told(iter(rows[1:2]))) == []
