import json

from beaconry.__main__ import parsed, run
from beaconry.sources import files


def test_settings_and_names():
    told = run(parsed(["config", "--set", "model.k=7", "--set", "dataset.type=tampere"]))
    assert told["model"]["k"] == 7 and told["dataset"]["type"] == "tampere" and not told["problems"]
    assert len(run(parsed(["datasets"]))) == 36


def test_train_and_test(spark, tmp_path):
    for name, n in (("train", 8), ("test", 2)):
        (tmp_path / f"{name}.csv").write_text("x,y,floor,building,WAP1,WAP2\n" + "".join(f"{k},{k + 1},{k % 2},b,{-40 - k},{-90 + k}\n" for k in range(n)))
    common = ["--root", str(tmp_path), "--model", str(tmp_path / "m"), "--set", "dataset.type=tampere", "--set", "model.k=1"]
    trained = run(parsed(["train", *common, "--out", str(tmp_path / "o")]))
    assert trained["mean_error"] == 0 and trained["floor_accuracy"] == trained["building_accuracy"] == 100
    assert run(parsed(["test", *common]))["mean_error"] == 0
    assert json.loads(next((tmp_path / "o/results").glob("part-*")).read_text())["max_error"] == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "o/predictions")).count() == 2


def test_files(spark, tmp_path, monkeypatch):
    (tmp_path / "O1.mat").write_bytes(b"abc")
    assert files.whole(str(tmp_path / "O1.mat"), "900150983cd24fb0d6963f7d28e17f72") and not files.whole(str(tmp_path / "O1.mat"), "0" * 32)
    assert not files.whole(str(tmp_path / "none"))
    assert files.scenarios(spark, str(tmp_path)) == ["O1"]
    monkeypatch.setenv("BEACONRY_DATA", "/there")
    assert files.data_home() == "/there" and files.data_home("/here") == "/here"
    assert files.distinct_values(spark.createDataFrame([(2,), (1,), (None,), (2,)], "f int"), "f") == [1, 2]
