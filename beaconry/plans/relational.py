"""Queries of the relational operators that the loaders use."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.signals import detected
from ..operators import shaping as P
from ..operators import statistics as T
from ..sources import catalog
from .registry import query, table
from .views import FP, RANGES, SCANS, fingerprints, ranges, rounded, scans

PAIRED = f"""{SCANS}, slots AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY ap) AS slot FROM long),
wide AS (SELECT scan, (slot - 1) // 7 AS line, {', '.join(f"max(CASE WHEN (slot - 1) % 7 = {k - 1} THEN ap END) AS ap_{k}, max(CASE WHEN (slot - 1) % 7 = {k - 1} THEN rssi END) AS rssi_{k}" for k in range(1, 8))} FROM slots GROUP BY 1, 2)"""


def paired(spark, sf_dir):
    """Wide rows of up to seven (id, RSSI) pairs, as many lines a scan as its pairs need."""
    slots = scans(spark, sf_dir).withColumn("slot", F.row_number().over(W.partitionBy("scan").orderBy("ap")) - 1)
    at = lambda c, k: F.max(F.when(F.col("slot") % 7 == k - 1, F.col(c)))
    return slots.groupBy("scan", F.expr("slot div 7").alias("line")).agg(*(at(c, k).alias(f"{c}_{k}") for k in range(1, 8) for c in ("ap", "rssi")))


@query("pair_unpivot", f"WITH {PAIRED} SELECT scan, trim(i) AS id, v AS value FROM (SELECT scan, unnest([{', '.join(f'ap_{k}' for k in range(1, 8))}]) AS i, unnest([{', '.join(f'rssi_{k}' for k in range(1, 8))}]) AS v FROM wide) WHERE i IS NOT NULL AND v IS NOT NULL")
def _(spark, sf_dir):
    return P.unpivoted(paired(spark, sf_dir), [(f"ap_{k}", f"rssi_{k}") for k in range(1, 8)]).drop("line")


@query("pair_gather", f"WITH {SCANS} SELECT scan, count(*)::INT AS n, arg_max(ap, (rssi, ap)) AS loudest FROM long GROUP BY scan")
def _(spark, sf_dir):
    g = P.gathered(scans(spark, sf_dir), ["scan"], "ap", "rssi")
    best = F.array_max(F.transform(F.map_entries("readings"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    return g.select("scan", F.size("readings").alias("n"), best["k"].alias("loudest"))


@query("group_beacons", "SELECT l_orderkey AS scan, count(*)::INT AS n, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS items FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("o"), "l_linenumber")
    return P.grouped_scans(rows, ["scan"], ["l_linenumber"], "o").select("scan", F.size("items").alias("n"), F.col("items.l_linenumber").alias("items"))


@query("anchor_lookup_join", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    n = P.looked_up(s, table(spark, sf_dir, "nation"), "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return P.looked_up(n, table(spark, sf_dir, "region"), "r_regionkey").select("s_suppkey", "n_name", "r_name")


@query("first_match_left_join", "SELECT c_custkey, min(o_orderkey) AS first_order, arg_min(o_orderpriority, o_orderkey) AS priority FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("first_order"), F.col("o_orderpriority").alias("priority"))
    return P.first_matches(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "k")


@query("position_join", "SELECT a.s_suppkey AS src_idx, a.s_name, b.p_name FROM supplier a LEFT JOIN part b ON a.s_suppkey = b.p_partkey")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src_idx"), "s_name")
    return P.by_position([a, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src_idx"), "p_name")])


@query("semi_nonempty", f"WITH {RANGES} SELECT DISTINCT sample_id FROM ranges WHERE distance > 0 AND distance < 8")
def _(spark, sf_dir):
    near = ranges(spark, sf_dir).where("distance > 0 and distance < 8")
    return ranges(spark, sf_dir).select("sample_id").distinct().join(near.select("sample_id"), "sample_id", "left_semi")


@query("membership_filter", f"WITH {FP} SELECT sample_id, floor, building FROM fp WHERE floor IN (1, 3) AND building IN ('0')")
def _(spark, sf_dir):
    spec = catalog.CATALOG["rss_based"]
    return catalog.selected(fingerprints(spark, sf_dir), spec, {"floor": [1, 3], "building": "0"}).select("sample_id", "floor", "building")


@query("sentinel_fill", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END, 100.0) AS v FROM orders")
def _(spark, sf_dir):
    from ..sources.layouts import vector

    o = table(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    return o.select("o_orderkey", F.get(vector(["v"], 100.0), F.lit(0)).alias("v"))


def _split(part: str):
    return lambda s, d: P.row_split(fingerprints(s, d), 0.7, "sample_id", train=part == "train").select("sample_id", "floor")


for _name, _sign in (("row_split", "<="), ("row_split_rest", ">")):
    query(_name, f"WITH {FP}, r AS (SELECT *, row_number() OVER (ORDER BY sample_id) AS rn, count(*) OVER () AS n FROM fp) SELECT sample_id, floor FROM r WHERE rn {_sign} floor(n * 0.7)")(_split("train" if _sign == "<=" else "test"))


@query("group_split", "WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey FROM orders JOIN g USING (o_custkey) WHERE rn <= floor(n * 0.7)")
def _(spark, sf_dir):
    return P.group_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 0.7, "o_custkey", train=True).select("o_orderkey")


@query("random_split")
def _(spark, sf_dir):
    """A permutation by hash; another engine's hash would order otherwise."""
    return P.random_split(table(spark, sf_dir, "orders").select("o_orderkey"), 0.8, "o_orderkey", train=True)


@query("group_number", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderstatus, o_orderpriority) - 1)::BIGINT AS group_id FROM orders")
def _(spark, sf_dir):
    return P.group_number(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "group_id")


@query("union_all", "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS x FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return P.united(a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("x")))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, sf_dir):
    return P.united(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("distinct_sorted", "SELECT DISTINCT o_orderpriority FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority")


@query("dataset_stats", f"""WITH {FP}, f AS (SELECT sample_id, x, y, CASE WHEN sample_id % 9 <> 0 THEN floor END AS floor, building FROM fp)
SELECT count(*) AS num_samples, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(DISTINCT floor) + max((floor IS NULL)::INT) AS num_floors, list_sort(list(DISTINCT floor) FILTER (floor IS NOT NULL)) AS floors,
  count(DISTINCT building) + max((building IS NULL)::INT) AS num_buildings, list_sort(list(DISTINCT building)) AS buildings FROM f""")
def _(spark, sf_dir):
    return T.dataset(fingerprints(spark, sf_dir).withColumn("floor", F.when(F.col("sample_id") % 9 != 0, F.col("floor"))))


@query("detection_stats", f"WITH {FP}, n AS (SELECT len(list_filter(features, lambda e: e <> 100)) AS n FROM fp) SELECT round(avg(n), 6) AS avg_detected, min(n)::INT AS min_detected, max(n)::INT AS max_detected FROM n")
def _(spark, sf_dir):
    return rounded(T.detections(fingerprints(spark, sf_dir)))


@query("uwb_stats", f"WITH {RANGES} SELECT round(avg(distance), 6) AS mean_distance, round(min(distance), 6) AS min_distance, round(max(distance), 6) AS max_distance, round(stddev_pop(distance), 6) AS std_distance FROM ranges")
def _(spark, sf_dir):
    maps = ranges(spark, sf_dir).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("anchor_id", "distance"))).alias("distances"))
    return rounded(T.distance_spread(maps))


@query("csi_stats", f"WITH {FP}, m AS (SELECT list_avg(list_transform(features, lambda e: abs(e))) AS m FROM fp) SELECT round(avg(m), 6) AS mean_magnitude, round(stddev_pop(m), 6) AS std_magnitude FROM m")
def _(spark, sf_dir):
    return rounded(T.channel(fingerprints(spark, sf_dir).select(F.transform("features", lambda v: F.abs(v)).alias("magnitudes"))))


@query("hybrid_stats", f"WITH {FP} SELECT m AS modality, floor(avg(n))::INT AS dim FROM (SELECT unnest(['wifi', 'magnetic']) AS m, unnest([64, 3 + sample_id % 2]) AS n FROM fp) GROUP BY m")
def _(spark, sf_dir):
    mag = F.slice("features", F.lit(1), (F.lit(3) + F.col("sample_id") % 2).cast("int"))
    return T.modalities(fingerprints(spark, sf_dir).select(F.create_map(F.lit("wifi"), F.col("features"), F.lit("magnetic"), mag).alias("modalities")))


@query("building_floor_counts", f"WITH {FP} SELECT building, floor, count(*) AS n, count(DISTINCT user_id) AS users FROM fp GROUP BY 1, 2")
def _(spark, sf_dir):
    return T.per_floor(fingerprints(spark, sf_dir))


@query("detected_filter", f"WITH {FP} SELECT sample_id FROM fp WHERE len(list_filter(features, lambda e: e <> 100)) >= 30")
def _(spark, sf_dir):
    return fingerprints(spark, sf_dir).where(detected(F.col("features")) >= 30).select("sample_id")


@query("top_k_per_key", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def _(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("n", n).where("n <= 3").select("o_orderkey", "o_custkey")


#: The datasets and their kinds of signal again, as SQL that reads no Python.
DATASETS = """SELECT * FROM (VALUES
  ('ujindoorloc', 'wifi'), ('sodindoorloc', 'wifi'), ('longtermwifi', 'wifi'), ('tampere', 'wifi'), ('wlanrssi', 'wifi'), ('tuji1', 'wifi'),
  ('rss_based', 'wifi'), ('ble_indoor', 'ble'), ('ibeacon_rssi', 'ble'), ('ble_rssi_uci', 'ble'), ('uwb_indoor', 'uwb'), ('uwb_ranging', 'uwb'),
  ('magnetic_indoor', 'magnetic'), ('vlc_indoor', 'vlc'), ('ultrasound', 'ultrasound'), ('rfid_indoor', 'rfid'), ('wifi_imu', 'hybrid'),
  ('wifi_magnetic', 'hybrid'), ('multimodal', 'hybrid'), ('sensor_fusion', 'hybrid'), ('csi_indoor', 'csi'), ('csi_fingerprint', 'csi'),
  ('hwild', 'csi'), ('csu', 'csi'), ('wild_v2', 'csi'), ('opencsi', 'csi'), ('haloc', 'csi'), ('csi_bench', 'csi'), ('mamimo_csi', 'csi'),
  ('dichasus', 'csi'), ('espargos', 'csi'), ('csi2pos', 'csi'), ('csi2taoa', 'csi'), ('deepmimo', 'csi'), ('mamimo_uav', 'csi'),
  ('wifi_csi_d2d', 'csi')) AS t(name, signal)"""


@query("catalog_list", f"""WITH {SCANS}, counts AS (SELECT 'wifi' AS signal, count(*) AS n FROM embeddings UNION ALL SELECT 'ble', count(DISTINCT scan) FROM long
  UNION ALL SELECT 'magnetic', count(DISTINCT user_id) FROM events UNION ALL SELECT 'uwb', count(*) FROM orders)
SELECT name, d.signal, n FROM ({DATASETS}) d LEFT JOIN counts USING (signal)""")
def _(spark, sf_dir):
    """The datasets, and how many samples of their kind of signal the views of the tables hold."""
    kinds = {
        "wifi": table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n")), "ble": scans(spark, sf_dir).agg(F.count_distinct("scan").alias("n")),
        "magnetic": table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("n")), "uwb": table(spark, sf_dir, "orders").agg(F.count("*").alias("n")),
    }
    counts = P.united(*(df.withColumn("signal", F.lit(kind)) for kind, df in kinds.items()))
    return catalog.catalog_table(spark).select("name", "signal").join(counts, "signal", "left").select("name", "signal", "n")
