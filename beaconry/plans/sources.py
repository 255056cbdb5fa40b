"""Queries of the readers: the standard tables are written out as files of each layout and read back by dataset name.

The SQL says what the files hold, straight from the tables, so it shares nothing with the readers. Files are folders of
parts, as any Spark job leaves them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_path
from ..sources import lines, load_dataset
from .registry import query, table
from .relational import paired
from .views import FP, SCANS, fingerprints

Files = dict[str, DataFrame]
WIDTH = 64
ABSENT = 100.0


def _read(name: str, split: str, make: Callable[[SparkSession, str], Files], out: Callable[[DataFrame], DataFrame], **options):
    """A query that writes ``make``'s files and reads dataset ``name`` from them; one column called ``value`` is a text file."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = shared_path(spark, f"files-{name}")
        for file, df in make(spark, sf_dir).items():
            if df.columns == ["value"]:
                df.write.text(f"{root}/{file}")
            else:
                df.write.option("header", True).csv(f"{root}/{file}")
        return out(load_dataset(spark, name, root, split, **options))

    return build


def _cells(names: str, hidden: bool = False) -> list:
    """The fingerprint's vector as columns; undetected cells are empty if ``hidden``."""
    cell = lambda k: F.get("features", F.lit(k))
    return [(F.when(cell(k) != ABSENT, cell(k)) if hidden else cell(k)).alias(names.format(k + 1)) for k in range(WIDTH)]


def _texts() -> Column:
    return F.transform("features", lambda v: v.cast("string"))


SEEN = "len(list_filter(features, lambda e: e <> 100))::INT"


def seen() -> Column:
    return F.size(F.filter("features", lambda v: v != ABSENT))


def _positional(spark, sf_dir):
    f = fingerprints(spark, sf_dir)
    labels = F.array(*(F.col(c).cast("string") for c in ("x", "y", "floor", "building", "sample_id")), *(F.lit(v) for v in ("1", "2", "3", "4")))
    cells = F.concat(_texts(), F.array_repeat(F.lit("100"), 520 - WIDTH), labels)
    whole = F.when(F.col("sample_id") % 17 == 0, F.slice(cells, 1, 500)).otherwise(cells)
    return {"trainingData.csv": f.select(F.array_join(whole, ",").alias("value"))}


query("source_positional", f"WITH {FP} SELECT sample_id::INT AS id, x, y, floor::INT AS floor, building, 520 AS width, {SEEN} AS seen FROM fp WHERE sample_id % 17 <> 0")(
    _read("uji", "train", _positional, lambda d: d.select(F.col("space_id").alias("id"), "x", "y", "floor", "building", F.size("features").alias("width"), seen().alias("seen"))))

SITES = {"CETC331/Training_CETC331.csv": 64, "HCXY/Training_HCXY_All_30.csv": 40, "SYL/Training_SYL_All_30.csv": 16}


def _sites(spark, sf_dir):
    f, out = fingerprints(spark, sf_dir), {}
    for k, (file, width) in enumerate(SITES.items()):
        own = f.where(F.col("sample_id") % 3 == k)
        out[file] = own.select(*_cells("MAC{}", hidden=True)[:width], F.col("sample_id").alias("ECoord"), F.col("y").alias("NCoord"), (F.col("floor") + 0.5).alias("FloorID"), F.lit(k + 1).alias("BuildingID"))
    return out


query("source_sites", f"""WITH {FP}, s AS (SELECT *, list_transform(features, lambda e, i: CASE WHEN i > [64, 40, 16][sample_id % 3 + 1] THEN 100 ELSE e END) AS own FROM fp)
SELECT sample_id::DOUBLE AS id, y, floor::INT AS floor, (sample_id % 3 + 1)::VARCHAR AS building, 64 AS width, len(list_filter(own, lambda e: e <> 100))::INT AS seen FROM s""")(
    _read("sod", "train", _sites, lambda d: d.select(F.col("x").alias("id"), "y", "floor", "building", F.size("features").alias("width"), seen().alias("seen"))))


def _matrix(spark, sf_dir):
    f = fingerprints(spark, sf_dir)
    last = F.when(F.col("sample_id") % 19 == 0, F.lit("?")).otherwise(F.col("floor").cast("string"))
    line = F.concat(F.lit(" "), F.array_join(F.concat(_texts(), F.array(F.col("sample_id").cast("string"), F.col("y").cast("string"), last)), "  "))
    return {f"TRNDB{k}.txt": f.where(F.col("sample_id") % 3 == k).select(line.alias("value")) for k in range(3)}


query("source_text_matrix", f"WITH {FP} SELECT sample_id::DOUBLE AS id, y, floor::INT AS floor, (sample_id % 3)::VARCHAR AS building, features[3] AS third, len(features)::INT AS width FROM fp WHERE sample_id % 19 <> 0")(
    _read("longterm", "train", _matrix, lambda d: d.select(F.col("x").alias("id"), "y", "floor", "building", F.get("features", F.lit(2)).alias("third"), F.size("features").alias("width"))))


def _records(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    fields = [F.lit("2020-01-01"), F.lit("10:00"), k, k % 31, k % 4, F.concat(F.lit("u"), k % 7), F.lit("p"), *(-(k % (11 + j)) for j in range(7))]
    line = F.concat_ws("  ", *(c.cast("string") for c in fields))
    return {"dataset.txt": o.select(F.when(k % 13 == 0, F.substring_index(line, "  ", 9)).otherwise(line).alias("value"))}


query("source_text_records", "SELECT o_orderkey::DOUBLE AS id, (o_orderkey % 31)::DOUBLE AS y, (o_orderkey % 4)::INT AS floor, 'u' || (o_orderkey % 7) AS user_id, (-(o_orderkey % 11) - (o_orderkey % 17))::DOUBLE AS ends FROM orders WHERE o_orderkey % 13 <> 0")(
    _read("wlan", "all", _records, lambda d: d.select(F.col("x").alias("id"), "y", "floor", "user_id", (F.get("features", F.lit(0)) + F.get("features", F.lit(6))).alias("ends"))))


def _wide(spark, sf_dir):
    f = fingerprints(spark, sf_dir)
    return {"train.csv": f.select(F.col("sample_id").alias("x"), "y", "floor", "building", *_cells("WAP{:03}", hidden=True))}


query("source_wide", f"WITH {FP} SELECT sample_id::DOUBLE AS id, y, floor::INT AS floor, building, {SEEN} AS seen FROM fp WHERE building IN ('0', '1')")(
    _read("tampere", "train", _wide, lambda d: d.select(F.col("x").alias("id"), "y", "floor", "building", F.size(F.filter("features", lambda v: v.isNotNull())).alias("seen")), building=["0", "1"]))


def _pairs(spark, sf_dir):
    wide = paired(spark, sf_dir)
    names = {f"{old}_{k}": f"{new}{k}" for k in range(1, 8) for old, new in (("ap", "BSSID"), ("rssi", "RSSI"))}
    return {"training_data.csv": wide.withColumns({"x": F.col("scan"), "y": F.col("line"), "floor": F.col("scan") % 3}).drop("scan", "line").withColumnsRenamed(names)}


query("source_pairs", f"""WITH {SCANS}, slots AS (SELECT *, (row_number() OVER (PARTITION BY scan ORDER BY ap) - 1) // 7 AS line FROM long)
SELECT scan::DOUBLE AS id, line::DOUBLE AS line, (scan % 3)::INT AS floor, (SELECT count(DISTINCT ap) FROM long)::INT AS width, count(*)::INT AS seen, sum(rssi)::DOUBLE AS total FROM slots GROUP BY scan, line""")(
    _read("tuji1", "train", _pairs, lambda d: d.select(F.col("x").alias("id"), F.col("y").alias("line"), "floor", F.size("features").alias("width"), F.size(F.filter("features", lambda v: v != -110)).alias("seen"),
                                                       F.aggregate(F.filter("features", lambda v: v != -110), F.lit(0.0), lambda a, v: a + v).alias("total"))))


def _floors(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.select(k.alias("x"), F.lit(1).alias("y"), F.concat(F.lit("m"), k % 7).alias("beacon_mac_1"), (-(k % 40)).alias("rssi_1"), F.when(k % 3 > 0, F.concat(F.lit("n"), k % 5)).alias("beacon_mac_2"), (-(k % 50)).alias("rssi_2"))
    return {f"floor{f}_train.csv": rows.where(F.col("x") % 5 == f) for f in range(5)}


def _keys() -> Column:
    return F.array_join(F.array_sort(F.map_keys("readings")), ",")


def _total() -> Column:
    return F.aggregate(F.map_values("readings"), F.lit(0.0), lambda a, v: a + v)


query("source_floor_files", """SELECT c_custkey::DOUBLE AS id, (c_custkey % 5)::INT AS floor, 'm' || (c_custkey % 7) || CASE WHEN c_custkey % 3 > 0 THEN ',n' || (c_custkey % 5) ELSE '' END AS ids,
  (-(c_custkey % 40) - CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 50 ELSE 0 END)::DOUBLE AS total FROM customer WHERE c_custkey % 5 IN (1, 4)""")(
    _read("ble", "train", _floors, lambda d: d.select(F.col("x").alias("id"), "floor", _keys().alias("ids"), _total().alias("total")), floor=[1, 4]))


def _beacons(spark, sf_dir):
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select((s % 20).alias("x"), F.when(F.col("l_partkey") % 10 > 0, F.col("l_partkey") % 10).alias("y"), (n % 3).alias("floor"), F.lit("u").alias("beacon_uuid"), (s % 5).alias("beacon_major"), n.alias("beacon_minor"), (-(30 + s % 5 * 10 + n)).alias("rssi"))
    return {"train.csv": rows}


query("source_locations", """SELECT x, y, floor, count(*)::INT AS n, sum(rssi)::DOUBLE AS total, min(id) AS first FROM (SELECT DISTINCT (l_suppkey % 20)::DOUBLE AS x, (l_partkey % 10)::DOUBLE AS y, (l_linenumber % 3)::INT AS floor,
  'u:' || (l_suppkey % 5) || ':' || l_linenumber AS id, -(30 + l_suppkey % 5 * 10 + l_linenumber) AS rssi FROM lineitem WHERE l_partkey % 10 > 0) GROUP BY 1, 2, 3""")(
    _read("ibeacon", "train", _beacons, lambda d: d.select("x", "y", "floor", F.size("readings").alias("n"), _total().alias("total"), F.array_min(F.map_keys("readings")).alias("first"))))


def _labelled(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("date"), F.concat(F.lit("L"), F.col("n_regionkey")).alias("location"), (-F.col("n_nationkey")).alias("b3001"), F.lit(-200).alias("b3002"))
    return {"iBeacon_RSSI_Labeled.csv": n.coalesce(1).sortWithinPartitions("date")}  # the 25 nations: places follow the order of one file


query("source_first_seen", """WITH p AS (SELECT n_regionkey, row_number() OVER (ORDER BY min(n_nationkey)) - 1 AS place FROM nation GROUP BY 1)
SELECT 'L' || n_regionkey AS location, (5 * place)::DOUBLE AS x, (-n_nationkey)::DOUBLE AS first, 2 AS width FROM nation JOIN p USING (n_regionkey)""")(
    _read("ble_rssi_uci", "all", _labelled, lambda d: d.select("location", "x", F.get("features", F.lit(0)).alias("first"), F.size("features").alias("width"))))


def _anchored(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    cells = [x for j in range(1, 4) for x in (F.when(c % (j + 2) > 0, F.concat(F.lit(f"A{j}"), c % 6)).alias(f"anchor{j}_id"), (k % 29 + j).alias(f"anchor{j}_distance"))]
    places = table(spark, sf_dir, "region").select(F.concat(F.lit("A1"), "r_regionkey").alias("anchor_id"), (F.col("r_regionkey") * 10).alias("x"), F.lit(2).alias("y"), F.lit(3).alias("z"))
    return {"train_data.csv": o.select(k.alias("x"), F.lit(1).alias("y"), F.lit(0).alias("z"), (k % 4).alias("floor"), *cells), "anchor_positions.csv": places}


query("source_anchors", """WITH a AS (SELECT o_orderkey AS k, o_custkey AS c, unnest([1, 2, 3]) AS j FROM orders), s AS (SELECT k, 'A' || j || (c % 6) AS id, c, j, k % 29 + j AS d FROM a WHERE c % (j + 2) > 0)
SELECT k::DOUBLE AS id, (k % 4)::INT AS floor, count(*)::INT AS n, sum(d)::DOUBLE AS total, count(*) FILTER (j = 1 AND c % 6 IN (SELECT r_regionkey FROM region))::INT AS placed,
  coalesce(sum(10 * (c % 6)) FILTER (j = 1 AND c % 6 IN (SELECT r_regionkey FROM region)), 0)::DOUBLE AS places FROM s GROUP BY k""")(
    _read("uwb", "train", _anchored, lambda d: d.select(F.col("x").alias("id"), "floor", F.size("readings").alias("n"), _total().alias("total"), F.size("positions").alias("placed"), F.aggregate(F.map_values("positions"), F.lit(0.0), lambda a, p: a + p["x"]).alias("places"))))


def _ranged(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(k.alias("measurement_id"), (k % 40).alias("x"), (k % 30).alias("y"), F.lit(1).alias("z"), F.concat(F.lit("A"), F.col("l_suppkey") % 9).alias("anchor_id"), F.col("l_quantity").alias("distance"))
    places = table(spark, sf_dir, "region").select(F.concat(F.lit("A"), "r_regionkey").alias("anchor_id"), F.col("r_regionkey").alias("x"), F.lit(0).alias("y"), F.lit(2).alias("z"))
    return {"ranging_measurements.csv": rows, "anchor_config.csv": places}


def _sum(cell: Callable) -> Column:
    return F.aggregate("transmitters", F.lit(0.0), lambda a, t: a + F.coalesce(cell(t), F.lit(0.0)))


query("source_measurements", """SELECT l_orderkey::VARCHAR AS id, (l_orderkey % 40)::DOUBLE AS x, (l_orderkey % 30)::DOUBLE AS y, count(*)::INT AS n, sum(l_quantity)::DOUBLE AS total,
  count(r_regionkey)::INT AS placed, coalesce(sum(r_regionkey), 0)::DOUBLE AS places FROM lineitem LEFT JOIN region ON r_regionkey = l_suppkey % 9 GROUP BY l_orderkey""")(
    _read("uwb_ranging", "all", _ranged, lambda d: d.select(F.col("measurement_id").alias("id"), "x", "y", F.size("transmitters").alias("n"), _sum(lambda t: t["value"]).alias("total"), F.size(F.filter("transmitters", lambda t: t["anchor_x"].isNotNull())).alias("placed"), _sum(lambda t: t["anchor_x"]).alias("places"))))


def _lights(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(k.alias("measurement_id"), (k % 40).alias("x"), (k % 30).alias("y"), F.lit(1).alias("z"), F.concat(F.lit("L"), F.col("l_suppkey") % 9).alias("led_id"), F.col("l_linenumber").alias("snr"))
    return {"vlc_measurements.csv": rows, "led_positions.csv": table(spark, sf_dir, "region").select(F.concat(F.lit("L"), "r_regionkey").alias("led_id"), F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(3).alias("z"))}


query("source_lights", "SELECT l_orderkey::VARCHAR AS id, count(*)::INT AS n, (-100 * count(*))::DOUBLE AS power, sum(l_linenumber)::DOUBLE AS snr, 'OOK' AS modulation, (3 * count(*) FILTER (l_suppkey % 9 IN (SELECT r_regionkey FROM region)))::DOUBLE AS heights FROM lineitem GROUP BY l_orderkey")(
    _read("vlc", "all", _lights, lambda d: d.select(F.col("measurement_id").alias("id"), F.size("transmitters").alias("n"), _sum(lambda t: t["value"]).alias("power"), _sum(lambda t: t["snr"]).alias("snr"), F.array_join(F.array_distinct("transmitters.modulation"), ",").alias("modulation"), _sum(lambda t: t["led_z"]).alias("heights"))))


def _axes(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return {"train_magnetic.csv": e.select(i.alias("x"), (i % 9).alias("y"), (i % 4).alias("floor"), F.concat(F.lit("b"), i % 3).alias("building"), F.col("value").alias("mag_x"), (i % 50).alias("mag_y"), (-(i % 60)).alias("mag_z"))}


query("source_axes", "SELECT event_id::DOUBLE AS id, (event_id % 4)::INT AS floor, 'b' || (event_id % 3) AS building, value AS mx, (event_id % 50)::DOUBLE AS my, (-(event_id % 60))::DOUBLE AS mz FROM events WHERE event_id % 3 = 1 AND event_id % 4 IN (0, 2)")(
    _read("magnetic", "train", _axes, lambda d: d.select(F.col("x").alias("id"), "floor", "building", *(F.get("features", F.lit(k)).alias(f"m{c}") for k, c in enumerate("xyz"))), building="b1", floor=[0, 2]))


def _flights(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    cells = [x for j in (1, 2) for x in (F.concat(F.lit(f"B{j}"), k % 4).alias(f"beacon{j}_id"), F.when(k % (j + 1) > 0, k % 100 / 64.0).alias(f"beacon{j}_tof"), (k % 20).alias(f"beacon{j}_distance"))]
    return {"ultrasound_data.csv": c.select(k.alias("x"), F.lit(1).alias("y"), F.lit(0).alias("z"), *cells)}


query("source_flights", """SELECT c_custkey::DOUBLE AS id, ((c_custkey % 2 > 0)::INT + (c_custkey % 3 > 0)::INT) AS n, ((c_custkey % 2 > 0)::INT + (c_custkey % 3 > 0)::INT) * (c_custkey % 100) / 64.0::DOUBLE AS total,
  (((c_custkey % 2 > 0)::INT + (c_custkey % 3 > 0)::INT) * (c_custkey % 20))::DOUBLE AS metres FROM customer WHERE c_custkey % 2 > 0 OR c_custkey % 3 > 0""")(
    _read("ultrasound", "all", _flights, lambda d: d.select(F.col("x").alias("id"), F.size("readings").alias("n"), _total().alias("total"), F.aggregate(F.map_values("distances"), F.lit(0.0), lambda a, v: a + v).alias("metres"))))

query("source_places", "SELECT s_suppkey::DOUBLE AS id, (s_suppkey % 8)::DOUBLE AS y, (s_suppkey % 3)::INT AS floor FROM supplier")(
    _read("rfid", "all", lambda s, d: {"rfid_data.csv": table(s, d, "supplier").select(F.col("s_suppkey").alias("x"), (F.col("s_suppkey") % 8).alias("y"), (F.col("s_suppkey") % 3).alias("floor"))}, lambda d: d.select(F.col("x").alias("id"), "y", "floor")))


def _channel(file: str, *columns: tuple[str, Callable]) -> Callable[[SparkSession, str], Files]:
    return lambda s, d: {file: table(s, d, "orders").select(*(c(F.col("o_orderkey")).alias(n) for n, c in columns))}


def _three() -> list[Column]:
    return [F.get("features", F.lit(k)).alias(f"f{k + 1}") for k in range(3)]


query("source_channels", "SELECT o_orderkey::DOUBLE AS id, 'area' || (o_orderkey % 2) AS area, (o_orderkey % 5)::DOUBLE AS f1, (o_orderkey % 7)::DOUBLE AS f2, (o_orderkey % 9)::DOUBLE AS f3, 3 AS width FROM orders WHERE o_orderkey % 2 = 1")(
    _read("csi_fingerprint", "all", _channel("data.csv", ("x", lambda k: k), ("y", lambda k: k % 3), ("area", lambda k: F.concat(F.lit("area"), k % 2)), ("csi_amp_1", lambda k: k % 5), ("noise", lambda k: k % 6), ("CSI_2", lambda k: k % 7), ("amp_3", lambda k: k % 9)),
          lambda d: d.select(F.col("x").alias("id"), "area", *_three(), F.size("features").alias("width")), area="area1"))
query("source_two_places", "SELECT o_orderkey::DOUBLE AS x, (o_orderkey % 6)::DOUBLE AS y, 90 AS width, 0.0::DOUBLE AS first FROM orders")(
    _read("hwild", "all", _channel("data.csv", ("x", lambda k: k * 0 - 1), ("y", lambda k: k * 0 - 1), ("uwb_coordinate_x", lambda k: k), ("uwb_coordinate_y", lambda k: k % 6), ("other", lambda k: k)),
          lambda d: d.select("x", "y", F.size("features").alias("width"), F.get("features", F.lit(0)).alias("first"))))
query("source_grid", "SELECT o_orderkey::DOUBLE AS x, (o_orderkey % 6)::DOUBLE AS y, (o_orderkey % 5)::DOUBLE AS f1, (o_orderkey % 7)::DOUBLE AS f2, (o_orderkey % 9)::DOUBLE AS f3 FROM orders")(
    _read("csi2pos", "all", _channel("data.csv", ("grid_x", lambda k: k), ("grid_y", lambda k: k % 6), ("csi_1", lambda k: k % 5), ("per_csi", lambda k: k % 7), ("per_2", lambda k: k % 9)),
          lambda d: d.select("x", "y", *_three()), feature_type="both"))
query("source_polar", "SELECT round((o_orderkey % 50) * cos(radians(o_orderkey % 360)), 6) + 0.0 AS x, round((o_orderkey % 50) * sin(radians(o_orderkey % 360)), 6) + 0.0 AS y, o_orderkey::DOUBLE AS f1 FROM orders")(
    _read("wifi_csi_d2d", "all", _channel("data.csv", ("distance", lambda k: k % 50), ("angle", lambda k: k % 360), ("csi_1", lambda k: k)),
          lambda d: d.select((F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"), F.get("features", F.lit(0)).alias("f1"))))


def _fused(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.concat(F.lit("s"), k).alias("sample_id")
    return {
        "train/wifi.csv": o.where(k % 3 > 0).select(name, (k % 50).alias("wap1"), F.when(k % 2 > 0, k % 60).alias("wap2")), "train/magnetic.csv": o.where(k % 4 > 0).select(name, k.alias("mag_x"), (k % 5).alias("mag_y"), (k % 6).alias("mag_z")),
        "train/ble.csv": o.where(k % 5 > 0).select(name, F.concat(F.lit("m"), k % 3).alias("beacon1_mac"), (-(k % 70)).alias("beacon1_rssi")), "train/labels.csv": o.select(name, k.alias("x"), F.lit(1).alias("y"), (k % 2).alias("floor"), F.lit("b").alias("building")),
    }


query("source_joined", """SELECT o_orderkey::DOUBLE AS id, (o_orderkey % 2)::INT AS floor, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 50 + CASE WHEN o_orderkey % 2 > 0 THEN o_orderkey % 60 ELSE 100 END)::DOUBLE END AS wifi,
  CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey + o_orderkey % 5 + o_orderkey % 6)::DOUBLE END AS magnetic, CASE WHEN o_orderkey % 5 > 0 THEN (-200 - o_orderkey % 70)::DOUBLE END AS ble
FROM orders WHERE o_orderkey % 3 > 0 OR o_orderkey % 4 > 0 OR o_orderkey % 5 > 0""")(
    _read("sensor_fusion", "train", _fused, lambda d: d.select(F.col("x").alias("id"), "floor", *(F.aggregate(F.try_element_at("modalities", F.lit(m)), F.lit(0.0), lambda a, v: a + v).alias(m) for m in ("wifi", "magnetic", "ble")))))


def _one_file(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return {"wifi_magnetic_data.csv": o.select(k.alias("x"), F.lit(1).alias("y"), (k % 2).alias("floor"), (k % 50).alias("wap1"), F.when(k % 3 > 0, -(k % 60)).alias("wap2"), *((k % (5 + j)).alias(f"mag_{c}") for j, c in enumerate("xyz")))}


query("source_modalities", """SELECT o_orderkey::DOUBLE AS id, (o_orderkey % 2)::INT AS floor, (o_orderkey % 50 + CASE WHEN o_orderkey % 3 > 0 THEN -(o_orderkey % 60) ELSE 100 END)::DOUBLE AS wifi, (o_orderkey % 5 + o_orderkey % 6 + o_orderkey % 7)::DOUBLE AS magnetic FROM orders""")(
    _read("wifi_magnetic", "all", _one_file, lambda d: d.select(F.col("x").alias("id"), "floor", *(F.aggregate(F.element_at("modalities", F.lit(m)), F.lit(0.0), lambda a, v: a + v).alias(m) for m in ("wifi", "magnetic")))))


#: The channel datasets whose files have one column for each amplitude: the marker of an empty cell, and further columns.
#: A dataset without a marker leaves the cell null.
AMPLITUDES = {
    "csi_indoor": (-80.0, "csi_measurements.csv"), "csu": (-100.0, "data.csv"), "opencsi": (None, "data.csv"), "csi_bench": (None, "data.csv"), "mamimo_csi": (None, "data.csv"),
    "dichasus": (None, "data.csv"), "espargos": (None, "data.csv"), "csi2taoa": (None, "data.csv"), "mamimo_uav": (None, "data.csv"), "haloc": (None, "data.csv"), "wild_v2": (None, "data.csv"),
}


def _amplitudes(name: str, absent: float | None, file: str) -> None:
    """A query of one dataset: places, the first two amplitudes, of which the second is empty in every third line, and the floor."""
    hole = "NULL::DOUBLE" if absent is None else f"{absent}::DOUBLE"
    floor = "(o_orderkey % 4)::INT" if name == "haloc" else "(o_orderkey % 6)::INT"
    sql = f"""SELECT o_orderkey::DOUBLE AS x, (o_orderkey % 13)::DOUBLE AS y, (o_orderkey % 4)::DOUBLE AS z, {floor} AS floor, (o_orderkey % 17)::DOUBLE + 0.5 AS f1,
  CASE WHEN o_orderkey % 3 = 0 THEN {hole} ELSE (-(o_orderkey % 19))::DOUBLE END AS f2 FROM orders WHERE {"o_orderkey % 6 = 2" if name == "csi_indoor" else "true"}"""
    columns = (("x", lambda k: k), ("y", lambda k: k % 13), ("z", lambda k: k % 4), ("floor", lambda k: k % 6), ("csi_amp_1", lambda k: (k % 17) + 0.5), ("csi_amp_2", lambda k: F.when(k % 3 != 0, -(k % 19))))
    # where all columns but the labels are features, z isn't one, and where the first ones are, they start with it
    first = {"wild_v2": 0, "opencsi": 2}.get(name, 0)
    options = {"floor": [2]} if name == "csi_indoor" else {}

    def out(d: DataFrame) -> DataFrame:
        cells = [F.get("features", F.lit(first + k)).alias(f"f{k + 1}") for k in range(2)]
        return d.select("x", "y", "z", "floor", *cells)

    query(f"source_{name}", sql)(_read(name, "all", _channel(file, *columns), out, **options))


for _name, (_absent, _file) in AMPLITUDES.items():
    _amplitudes(_name, _absent, _file)


def _rss(spark, sf_dir):
    f = fingerprints(spark, sf_dir)
    return {"train_rss.csv": f.select(F.col("sample_id").alias("x"), "y", "floor", "building", *_cells("WAP{:03}", hidden=True))}


query("source_rss", f"WITH {FP} SELECT sample_id::DOUBLE AS id, y, floor::INT AS floor, building, {SEEN} AS seen FROM fp WHERE floor IN (1, 3)")(
    _read("rss_based", "train", _rss, lambda d: d.select(F.col("x").alias("id"), "y", "floor", "building", seen().alias("seen")), floor=[1, 3]))


def _sum_of(modality: str) -> Column:
    return F.aggregate(F.try_element_at("modalities", F.lit(modality)), F.lit(0.0), lambda a, v: a + v).alias(modality)


def _three_files(spark, sf_dir):
    """Files whose lines belong together by their place."""
    o = table(spark, sf_dir, "orders").select("o_orderkey").coalesce(1).sort("o_orderkey")
    k = F.col("o_orderkey")
    return {
        "train_wifi.csv": o.select(k.alias("timestamp"), (k % 50).alias("wap1"), F.when(k % 2 > 0, k % 60).alias("wap2")),
        "train_imu.csv": o.select(k.alias("timestamp"), (k % 7).alias("acc_x"), (k % 8).alias("acc_y"), (k % 9).alias("gyro_z")),
        "train_labels.csv": o.select(k.alias("timestamp"), k.alias("x"), F.lit(1).alias("y"), (k % 2).alias("floor"), F.lit("b").alias("building")),
    }


query("source_by_place", "SELECT o_orderkey::DOUBLE AS id, (o_orderkey % 2)::INT AS floor, (o_orderkey % 50 + CASE WHEN o_orderkey % 2 > 0 THEN o_orderkey % 60 ELSE 100 END)::DOUBLE AS wifi, (o_orderkey % 7 + o_orderkey % 8 + o_orderkey % 9)::DOUBLE AS imu FROM orders")(
    _read("wifi_imu", "train", _three_files, lambda d: d.select(F.col("x").alias("id"), "floor", _sum_of("wifi"), _sum_of("imu"))))


def _many(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return {"train_data.csv": o.select(k.alias("x"), F.lit(1).alias("y"), (k % 2).alias("floor"), (k % 50).alias("wap1"), F.lit("m").alias("beacon1_mac"), F.when(k % 3 > 0, -(k % 60)).alias("beacon1_rssi"), (k % 5).alias("acc_x"), (k % 6).alias("acc_y"))}


query("source_three_kinds", "SELECT o_orderkey::DOUBLE AS id, (o_orderkey % 2)::INT AS floor, (o_orderkey % 50)::DOUBLE AS wifi, CASE WHEN o_orderkey % 3 > 0 THEN -(o_orderkey % 60) ELSE -100 END::DOUBLE AS ble, (o_orderkey % 5 + o_orderkey % 6)::DOUBLE AS imu FROM orders")(
    _read("multimodal", "train", _many, lambda d: d.select(F.col("x").alias("id"), "floor", _sum_of("wifi"), _sum_of("ble"), _sum_of("imu"))))


@query("source_lines", f"WITH {FP} SELECT sample_id::DOUBLE AS id, y, floor::INT AS floor, features[3] AS third, len(features)::INT AS width FROM fp WHERE floor = 2 AND y > 10")
def _(spark, sf_dir):
    """Text fingerprints through the data source, filters pushed down."""
    path = shared_path(spark, "lines")
    f = fingerprints(spark, sf_dir)
    f.select(F.concat_ws(" ", F.concat_ws(" ", _texts()), F.col("sample_id").cast("string"), F.col("y").cast("string"), F.col("floor").cast("string")).alias("value")).write.text(path)
    rows = spark.read.format(lines.register(spark)).load(path).where("floor = 2 and y > 10")
    return rows.select(F.col("x").alias("id"), "y", "floor", F.get("features", F.lit(2)).alias("third"), F.size("features").alias("width"))
