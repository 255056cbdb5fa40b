import pytest
from pyspark.sql import functions as F

from beaconry import sources
from beaconry.__main__ import parsed, run
from beaconry.functions import vectors
from beaconry.models import create_model, evaluate
from beaconry.operators import heads, leaderboard, metrics, scaling
from beaconry.sources import CATALOG, demo, layouts, load_dataset
from beaconry.sources.names import NAMES
from beaconry.streaming.windows import stream_steps


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_anchor_places_and_lights(spark, tmp_path):
    put(tmp_path, "train_data.csv", "x,y,z,floor,anchor1_id,anchor1_distance,anchor2_id,anchor2_distance\n1,1,2,0,A,5,B,6\n")
    put(tmp_path, "anchor_positions.csv", "anchor_id,x,y,z\nA,7,8,9\nC,1,1,1\n")
    row = load_dataset(spark, "uwb", str(tmp_path), "train").first()
    assert row["readings"] == {"A": 5, "B": 6} and {k: tuple(v) for k, v in row["positions"].items()} == {"A": (7, 8, 9)}
    put(tmp_path, "vlc_measurements.csv", "measurement_id,x,y,z,led_id,rssi,snr,modulation\nm1,1,2,3,L,-5,9,QAM\nm2,1,2,3,L,-6,,\n")
    put(tmp_path, "led_positions.csv", "led_id,x,y,z\nL,0,0,2\n")
    got = {r["measurement_id"]: r["transmitters"][0] for r in load_dataset(spark, "vlc", str(tmp_path), "all").collect()}
    assert (got["m1"]["snr"], got["m1"]["modulation"], got["m1"]["value"]) == (9, "QAM", -5) and got["m2"]["snr"] is None


def test_each_column_once_and_own_places(spark, tmp_path):
    put(tmp_path, "data.csv", "x,y,uwb_coordinate_x,csi_amp_1,csi_amp_2,h_csi,per_csi\n1,2,9,3,4,5,6\n")
    widths = {n: len(load_dataset(spark, n, str(tmp_path), "all").first()["features"]) for n in ("csi_fingerprint", "csu", "mamimo_csi", "dichasus", "csi2taoa", "mamimo_uav")}
    assert widths == {"csi_fingerprint": 4, "csu": 4, "mamimo_csi": 4, "dichasus": 4, "csi2taoa": 4, "mamimo_uav": 4}
    assert len(load_dataset(spark, "csi2pos", str(tmp_path), "all", feature_type="both").first()["features"]) == 4
    assert load_dataset(spark, "hwild", str(tmp_path), "all").first()["x"] == 9 and load_dataset(spark, "csu_indoor", str(tmp_path), "all").first()["x"] == 1


def test_files_in_order(spark, tmp_path):
    put(tmp_path, "a.csv", "k\n1\n2\n")
    put(tmp_path, "b.csv", "k,more\n" + "".join(f"{k},x\n" for k in range(3, 400)))
    df = layouts.header_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert [r["k"] for r in df.orderBy("src_idx").limit(4).collect()] == ["1", "2", "3", "4"]
    assert [r["src_idx"] for r in layouts.counted(df).orderBy("src_idx").collect()] == list(range(1, 400))


def test_vocabulary_is_bounded(spark):
    from beaconry.operators.shaping import vocabulary

    long = spark.range(50).select(F.col("id").cast("string"))
    assert len(vocabulary(long).first()["vocabulary"]) == 50
    with pytest.raises(ValueError):
        vocabulary(long, most=49)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_demo(spark, name):
    df = demo(spark, name, 40)
    assert df.count() == 40 and sorted(map(str, df.collect())) == sorted(map(str, demo(spark, name, 40).repartition(3).collect()))
    kind = {"hybrid": "modalities", "rfid": "x", "wifi": "features", "csi": "features", "magnetic": "features"}.get(CATALOG[name].signal, "readings")
    assert kind in df.columns and df.where(F.col(kind).isNull()).isEmpty()
    scaling.scaled_dataset(df, CATALOG[name].signal, "standard").collect()


def test_demo_can_be_located(spark):
    a, b = demo(spark, "tampere", 400), demo(spark, "tampere", 60, seed=7)
    assert evaluate(create_model("wknn", k=3).fit(a), b).first()["mean_error"] < 6


def test_public_names(spark, tmp_path):
    assert len(NAMES) == len({sources.loader(n).args[0] for n in NAMES}) == 36
    put(tmp_path, "rfid_data.csv", "x,y,floor\n1,2,3\n4,5,6\n")
    assert sources.RFIDIndoor(spark, str(tmp_path), "all").count() == 2
    with pytest.raises(AttributeError):
        sources.Nothing  # noqa: B018


def test_arrays_are_kept(spark, tmp_path):
    a = spark.createDataFrame([("f", "g/h", [2], [1.0, 2.0], [0.0, 0.0])], layouts.ARRAYS)
    layouts.saved_arrays(a, str(tmp_path / "kept"))
    assert layouts.stored_arrays(spark, str(tmp_path / "kept")).collect() == a.collect() and list((tmp_path / "kept").glob("*.gz.parquet"))


def test_scaling_by_signal(spark):
    df = spark.createDataFrame([([-104.0, 100.0], {"a": 5.0, "b": 10.0, "c": 15.0}, {"wifi": [-104.0, 0.0], "magnetic": [3.0, 4.0, 0.0], "other": [7.0]})], "features array<double>, readings map<string,double>, modalities map<string,array<double>>")
    row = lambda c, signal, method: scaling.scaled_dataset(df.select(c), signal, method).first()[0]
    assert row("features", "wifi", "minmax") == [0, 0] and row("features", "magnetic", "standard") == [0, 0]
    assert row("readings", "uwb", "minmax") == {"a": 0, "b": 0.5, "c": 1}
    assert row("modalities", "hybrid", "minmax") == {"wifi": [0, 1], "magnetic": [0, 0, 0], "other": [7]}
    assert row("modalities", "hybrid", "magnitude")["magnetic"] == pytest.approx([0.6, 0.8, 0]) and row("modalities", "hybrid", "magnitude")["wifi"] == [-104, 0]
    with pytest.raises(ValueError):
        row("features", "wifi", "unknown")
    lights = spark.createDataFrame([([("L", 1.0), ("M", 3.0)],)], "transmitters array<struct<led_id: string, value: double>>")
    assert [t["value"] for t in scaling.scaled_dataset(lights, "vlc", "minmax").first()[0]] == [0, 1]


def test_percentiles(spark):
    for values in ([], [4.0], [4.0, 1.0, None, 3.0, 2.0], [1.0] * 9 + [2.0]):
        df = spark.createDataFrame([(v,) for v in values], "error_2d double")
        want = df.agg(*(F.percentile("error_2d", F.lit(p / 100)).alias(f"p{p}") for p in (0, 25, 50, 90, 100))).first()
        got = metrics.percentiles(df, {f"p{p}": p for p in (0, 25, 50, 90, 100)}).first()
        assert got.asDict() == pytest.approx(want.asDict()) if values else got.asDict() == want.asDict()
    plan = metrics.percentiles(df, {"p50": 50})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def test_comparison(spark):
    ours = spark.createDataFrame([(7.9, 90.0, None)], "mean_error double, floor_accuracy double, building_accuracy double")
    rows = leaderboard.result_comparison(spark, ours, "UJI").collect()
    assert len(rows) == 15 and [r["place"] for r in rows] == list(range(1, 16))
    at = next(r["place"] for r in rows if r["ours"])
    assert at == 1 + sum(e[1] <= 7.9 for e in leaderboard.PUBLISHED["ujindoorloc"]) and rows[0]["gap"] == pytest.approx(7.9 - 2.45)
    text = leaderboard.comparison_text(rows)
    assert len(text.splitlines()) == 16 and "> this run" in text and "Satellite Navigation" in text
    assert leaderboard.result_comparison(spark, ours, "nothing").count() == 0


def test_template_and_explain(tmp_path):
    told = run(parsed(["template", "--set", "dataset.type=tampere", "--out", str(tmp_path / "t.json")]))
    assert told["_notes"] and run(parsed(["config", "--config", str(tmp_path / "t.json")]))["dataset"]["type"] == "tampere"
    out = run(parsed(["explain"]))
    assert out["dataset"]["name"] == "ujindoorloc" and out["published"][0]["mean_error"] == 2.45 and "wknn" in out["known_models"]


def test_heads(spark):
    arrays = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    df = spark.range(1).select(heads.refined(arrays(1, 2), arrays(0.5, 0), arrays(0, -1)).alias("r"), heads.hierarchical(arrays(0, 3), F.array(arrays(9, 0), arrays(0, 1)), F.array(F.array(arrays(0, 0), arrays(0, 1)), F.array(arrays(1, 0), arrays(1, 1)))).alias("h"))
    row = df.first()
    assert row["r"] == [1.5, 1] and row["h"].asDict() == {"building": 1, "floor": 1, "place": [1, 1]}
    assert vectors.argmax is heads.argmax


def test_learned_heads(spark):
    both = demo(spark, "tampere", 500).withColumn("building", F.when(F.col("x") < 20, "west").otherwise("east"))
    train, test = both.where("sample_id < 400"), both.where("sample_id >= 400")
    error = lambda df: df.agg(F.avg(F.sqrt((F.col("x") - F.col("pred_x")) ** 2 + (F.col("y") - F.col("pred_y")) ** 2))).first()[0]
    one, three = (error(heads.learned_scales(train, test, scales=k)) for k in (1, 3))
    assert three < one < 25
    out = heads.learned_hierarchy(train, test)
    assert error(out) < 20 and out.where("pred_building = building").count() > 60 and out.where("pred_floor = floor").count() > 60


def test_stream_ids_stay_exact(spark, tmp_path):
    big = 2**53 + 1
    rows = [(1, big + 2 * k, v) for k, v in enumerate([0.0, 5.0, 0.0, 0.0, 7.0, 0.0])]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long, value double").parquet(str(tmp_path / "in"))
    run_ = stream_steps(stream).writeStream.format("memory").queryName("exact").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run_.awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.table("exact").collect()) == [big + 2, big + 8]


def test_transforms(spark, tmp_path):
    from beaconry.registry import TRANSFORMS

    put(tmp_path, "rfid_data.csv", "x,y,floor\n1,2,3\n4,5,6\n")
    TRANSFORMS.register("moved", force=True)(lambda df, by=1.0: df.withColumn("x", F.col("x") + by))
    read = lambda t: sorted(r["x"] for r in load_dataset(spark, "rfid", str(tmp_path), "all", transform=t).collect())
    assert read(None) == [1, 4] and read("moved") == [2, 5]
    assert read([{"type": "moved", "by": 10.0}, lambda df: df.where("x > 12")]) == [14]
    with pytest.raises(KeyError):
        read("nothing")


def test_rows_as_json(spark):
    from beaconry.operators.shaping import as_json, from_json

    df = spark.createDataFrame([(1, "a", [1.5, None], None), (2**60, None, None, True)], "id long, name string, v array<double>, b boolean")
    text = as_json(df)
    assert sorted(map(str, from_json(text, "id long, name string, v array<double>, b boolean").collect())) == sorted(map(str, df.collect()))
    assert from_json(text.limit(0).unionByName(spark.createDataFrame([("no json",)], "value string")), "id long").first()["id"] is None
