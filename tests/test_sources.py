import numpy as np
import pytest

from beaconry.sources import CATALOG, dataset_info, layouts, list_datasets, load_dataset, resolve


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_catalog():
    assert len(CATALOG) == 36
    assert resolve("UJI") == "ujindoorloc" and resolve("wifi-imu") == "wifi_imu" and resolve("espargos_v1") == "espargos"
    assert "opencsi" in list_datasets("csi")
    assert dataset_info("wlan")["absent"] == -110
    with pytest.raises(ValueError):
        resolve("zzz")


def test_positional(spark, tmp_path):
    head = ",".join([f"WAP{i:03}" for i in range(1, 521)] + ["LONGITUDE", "LATITUDE", "FLOOR", "BUILDINGID", "SPACEID", "RELATIVEPOSITION", "USERID", "PHONEID", "TIMESTAMP"])
    line = lambda b, *more: ",".join(["100"] * 519 + ["-50", "1.5", "2.5", "3", str(b), "4", "1", "2", "3", "9", *more])
    put(tmp_path, "trainingData.csv", f"{head}\n{line(0)}\n{line(1, 'extra')}\n1,2,3\n")
    put(tmp_path, "validationData.csv", f"{head}\n{line(2)}\n")
    train, test = load_dataset(spark, "uji", str(tmp_path))
    assert rows(train, "x", "y", "floor", "building") == [(1.5, 2.5, 3, "0"), (1.5, 2.5, 3, "1")]
    assert test.count() == 1 and len(train.first()["features"]) == 520
    assert load_dataset(spark, "uji", str(tmp_path), "train", building=[1]).count() == 1
    assert load_dataset(spark, "uji", str(tmp_path), "all").count() == 3
    with pytest.raises(ValueError):
        load_dataset(spark, "uji", str(tmp_path), "train", building="9", required=True)
    with pytest.raises(ValueError):
        load_dataset(spark, "uji", str(tmp_path), "dev")


def test_sites_of_unlike_width(spark, tmp_path):
    for site, macs in (("CETC331", 2), ("HCXY", 3), ("SYL", 1)):
        head, cells = ",".join([f"MAC{i}" for i in range(macs)] + ["ECoord", "NCoord", "FloorID", "BuildingID"]), ",".join([""] * macs + ["1", "2", "3", "1"])
        for part in ("Training", "Testing"):
            put(tmp_path, f"{site}/{part}_{site}{'_All_30' if part == 'Training' and site != 'CETC331' else ''}.csv", f"{head}\n{cells}\n")
    df = load_dataset(spark, "sod", str(tmp_path), "train")
    assert rows(df, "features") == [([100.0] * 3,)] * 3
    assert load_dataset(spark, "sod", str(tmp_path), "test", building="SYL").count() == 1


def test_text(spark, tmp_path):
    put(tmp_path, "TRNDB0.txt", "-50 -60 1 2 3\nbad line x y z\n")
    put(tmp_path, "TRNDB1.txt", " -51  -61 4 5 0\n")
    put(tmp_path, "TRNDB2.txt", "")
    assert rows(load_dataset(spark, "longterm", str(tmp_path), "train"), "x", "floor", "building") == [(1.0, 3, "0"), (4.0, 0, "1")]
    put(tmp_path, "dataset.txt", "".join(f"2020 10:00 {i} 2 {i % 2} u p -1 -2 -3 -4 -5 -6 -110\n" for i in range(10)) + "short line\n")
    train, test = load_dataset(spark, "wlanrssi", str(tmp_path))
    assert (train.count(), test.count()) == (7, 3)
    assert load_dataset(spark, "wlanrssi", str(tmp_path), "train", floor=1).count() == 3


def test_pairs(spark, tmp_path):
    put(tmp_path, "training_data.csv", "timestamp,x,y,floor,BSSID1,RSSI1,BSSID2,RSSI2\n1,1,2,0,b,-50,a,-60\n2,3,4,1,c,-70,nan,-1\n")
    df = load_dataset(spark, "tuji1", str(tmp_path), "train")
    assert rows(df, "x", "features") == [(1.0, [-60, -50, -110]), (3.0, [-110, -110, -70])]
    for f in range(5):
        put(tmp_path, f"floor{f}_train.csv", f"x,y,beacon_mac_1,rssi_1,beacon_mac_2,rssi_2\n{f},2,m1,-50,m2,\n")
    df = load_dataset(spark, "ble", str(tmp_path), "train", floor=[2, 3])
    assert rows(df, "x", "floor", "readings") == [(2.0, 2, {"m1": -50.0}), (3.0, 3, {"m1": -50.0})]


def test_groups_and_dimensions(spark, tmp_path):
    put(tmp_path, "train.csv", "x,y,floor,beacon_uuid,beacon_major,beacon_minor,rssi\n1,2,0,u,1,1,-50\n1,2,0,u,1,2,-60\n,2,0,u,1,1,-1\n")
    assert rows(load_dataset(spark, "ibeacon", str(tmp_path), "train"), "x", "readings") == [(1.0, {"u:1:1": -50.0, "u:1:2": -60.0})]
    put(tmp_path, "iBeacon_RSSI_Labeled.csv", "date,location,b3001,b3002\n" + "".join(f"d,{p},-200,-{k}\n" for k, p in enumerate("QQAQA")))
    train, test = load_dataset(spark, "ble_rssi_uci", str(tmp_path))
    assert sorted(r["x"] for r in train.collect()) == [0, 0, 5] and test.count() == 2
    put(tmp_path, "ranging_measurements.csv", "measurement_id,x,y,z,anchor_id,distance\nm1,1,2,3,A,5\nm1,1,2,3,B,6\nm2,4,5,6,A,7\n")
    put(tmp_path, "anchor_config.csv", "anchor_id,x,y,z,channel\nA,0,0,2,5\n")
    df = load_dataset(spark, "uwb_ranging", str(tmp_path), "train", train_ratio=0.5)
    assert rows(df, "measurement_id", "x") == [("m1", 1.0)]
    assert [t["anchor_x"] for t in df.first()["transmitters"]] == [0.0, None]
    put(tmp_path, "vlc_measurements.csv", "measurement_id,x,y,z,led_id,snr\nm1,1,2,3,L,5\nm2,1,2,3,L,5\n")
    put(tmp_path, "led_positions.csv", "led_id,x,y,z\nL,0,0,2\n")
    assert load_dataset(spark, "vlc", str(tmp_path), "train").first()["transmitters"][0]["value"] == -100
    put(tmp_path, "ultrasound_data.csv", "x,y,z,beacon1_id,beacon1_tof,beacon1_distance,beacon2_id,beacon2_tof,beacon2_distance\n1,2,3,U,0.01,3.4,V,,1\n1,2,3,,1,1,,,\n")
    assert load_dataset(spark, "ultrasound", str(tmp_path), "all").first()["readings"] == {"U": 0.01}


def test_anchors_axes_and_places(spark, tmp_path):
    put(tmp_path, "train_data.csv", "timestamp,x,y,z,floor,anchor1_id,anchor1_distance,anchor2_id,anchor2_distance\n1,1,2,3,0,A,5,B,\n2,1,2,3,1,,,,\n")
    assert rows(load_dataset(spark, "uwb", str(tmp_path), "train"), "readings") == [({"A": 5.0},)]
    put(tmp_path, "train_magnetic.csv", "timestamp,x,y,floor,building,mag_x,mag_y,mag_z,mag_total\n1,1,2,0,b,3,4,0,5\n")
    assert load_dataset(spark, "magnetic", str(tmp_path), "train").first()["features"] == [3, 4, 0]
    put(tmp_path, "rfid_data.csv", "x,y,floor\n1,2,3\n4,5,6\n")
    assert rows(load_dataset(spark, "rfid", str(tmp_path), "train"), "x", "floor") == [(1.0, 3)]


@pytest.mark.parametrize("name", sorted(d.name for d in CATALOG.values() if d.signal == "csi" and d.name != "deepmimo"))
def test_channel_files(spark, tmp_path, name):
    put(tmp_path, CATALOG[name].files["all"][0], "x,y,z,floor,distance,angle,csi_amp_1,csi_amp_2,env,trajectory\n" + "".join(f"{i},2,1.9,0,2,90,{i}.5,,1,1\n" for i in range(10)))
    train, test = load_dataset(spark, name, str(tmp_path))
    assert (train.count(), test.count()) == (7, 3)
    first = train.orderBy("sample_id").first()
    assert first["features"][0 if name != "wild_v2" else -2] is not None
    if name == "wifi_csi_d2d":
        assert (first["x"], first["y"]) == (pytest.approx(0, abs=1e-9), 2)
    if name == "haloc":
        assert first["floor"] == 1


def test_hybrids(spark, tmp_path):
    put(tmp_path, "train_wifi.csv", "timestamp,wap1,wap2\n1,-50,\n2,-51,-52\n")
    put(tmp_path, "train_imu.csv", "timestamp,acc_x,acc_y\n1,1,2\n")
    put(tmp_path, "train_labels.csv", "timestamp,x,y,floor,building\n1,1,2,0,b\n2,3,4,1,b\n")
    df = load_dataset(spark, "wifi_imu", str(tmp_path), "train")
    assert rows(df, "x", "modalities.wifi", "modalities.imu") == [(1.0, [-50, 100], [1, 2]), (3.0, [-51, -52], None)]
    put(tmp_path, "wifi_magnetic_data.csv", "x,y,floor,wap1,mag_x,mag_y,mag_z\n1,2,0,-50,1,2,3\n1,2,0,-50,1,2,3\n")
    assert load_dataset(spark, "wifi_magnetic", str(tmp_path), "train").first()["modalities"]["magnetic"] == [1, 2, 3]
    put(tmp_path, "train_data.csv", "x,y,floor,wap1,beacon1_mac,beacon1_rssi,acc_x\n1,2,0,-50,m,-60,1\n")
    assert set(load_dataset(spark, "multimodal", str(tmp_path), "train").first()["modalities"]) == {"wifi", "ble", "imu"}
    put(tmp_path, "train/wifi.csv", "sample_id,wap1\ns1,-50\ns1,-99\n")
    put(tmp_path, "train/ble.csv", "sample_id,beacon1_mac,beacon1_rssi\n")
    put(tmp_path, "train/magnetic.csv", "sample_id,mag_x,mag_y,mag_z\ns2,1,2,3\n")
    put(tmp_path, "train/labels.csv", "sample_id,x,y,floor,building\ns1,1,2,0,b\ns2,3,4,0,b\ns3,5,6,0,b\n")
    df = load_dataset(spark, "sensor_fusion", str(tmp_path), "train")
    assert rows(df, "x", "modalities.wifi", "modalities.magnetic") == [(1.0, [-50], None), (3.0, None, [1, 2, 3])]


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "a.npz", h=np.array([[1 + 2j, 3]]), p=np.arange(3))
    got = {r["name"]: r for r in layouts.arrays_from_files(spark, str(tmp_path / "*.npz"), layouts.npy_arrays()).collect()}
    assert got["h"]["shape"] == [1, 2] and got["h"]["im"] == [2, 0] and got["p"]["re"] == [0, 1, 2]
    put(tmp_path, "skip.csv", "a comment\nu;v\n1;x\n2;3\n")
    assert rows(layouts.csv_columns(spark, str(tmp_path / "skip.csv"), ";", 1), "u", "v") == [(1.0, None), (2.0, 3.0)]
