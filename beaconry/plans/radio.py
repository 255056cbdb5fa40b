"""Queries over radio vectors: normalising, sparse and dense, ranges, channels, fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import csi as C
from ..functions import geometry as G
from ..functions import signals as S
from ..functions import vectors as V
from ..operators import heads as H
from ..operators.ranging import trilaterated
from ..operators.shaping import gathered, vocabulary
from .registry import query, table
from .views import FP, RANGES, SCANS, fingerprints, ranges, rounded, scans


def _vector(name: str, sql: str, build, source: str = "features", prefix: str = "") -> None:
    """A query of one vector function over the fingerprints; ``v`` stands for the vector in the SQL."""
    cell = f"list_transform({sql}, lambda z: round(z, 6) + 0.0)"
    text = f"WITH {FP}, s AS (SELECT sample_id, {source} AS v FROM fp){prefix} SELECT sample_id, {cell} AS v FROM s"

    def run(spark, sf_dir):
        fp = fingerprints(spark, sf_dir)
        return rounded(fp.select("sample_id", build(fp).alias("v")))

    query(name, text)(run)


F_ = lambda: F.col("features")
BLE = lambda: F.transform("features", lambda v: F.when(v == 100, -100.0).otherwise(v))
BLE_SQL = "list_transform(features, lambda e: CASE WHEN e = 100 THEN -100.0 ELSE e END)"
ABS = lambda: F.transform("features", lambda v: F.abs(v))
ABS_SQL = "list_transform(features, lambda e: abs(e))"
MEAN, STD = "(list_sum(L) / len(L))", "list_aggregate(L, 'stddev_pop')"


def moments(of: str, body: str) -> str:
    """SQL with m and sd of a list expression."""
    m, sd = (x.replace("L", f"({of})") for x in (MEAN, STD))
    return body.replace("$M", m).replace("$S", sd)


_vector("wifi_minmax", "list_transform(v, lambda e: (CASE WHEN e = 100 THEN -104 ELSE e END + 104) / 104)", lambda d: S.wifi(F_(), "minmax"))
_vector("wifi_positive", "list_transform(v, lambda e: CASE WHEN e = 100 THEN 0 ELSE abs(e) END)", lambda d: S.wifi(F_(), "positive"))
_vector("wifi_standard", moments("list_filter(v, lambda e: e <> 100)", "CASE WHEN len(list_filter(v, lambda e: e <> 100)) = 0 THEN v ELSE list_transform(v, lambda e: CASE WHEN e = 100 THEN 0 ELSE (e - $M) / ($S + 1e-8) END) END"), lambda d: S.wifi(F_(), "standard"))
_vector("ble_minmax", "list_transform(v, lambda e: CASE WHEN e = -100 THEN 0 ELSE (e + 100) / 100 END)", lambda d: S.ble(BLE(), "minmax"), BLE_SQL)
_vector("ble_positive", "list_transform(v, lambda e: CASE WHEN e = -100 THEN 0 ELSE e + 100 END)", lambda d: S.ble(BLE(), "positive"), BLE_SQL)
_vector("ble_standard", moments("list_filter(v, lambda e: e <> -100)", "list_transform(v, lambda e: CASE WHEN e = -100 OR $S = 0 THEN 0 ELSE (e - $M) / $S END)"), lambda d: S.ble(BLE(), "standard"), BLE_SQL)
_vector("uwb_minmax", "CASE WHEN list_max(v) > list_min(v) THEN list_transform(v, lambda e: (e - list_min(v)) / (list_max(v) - list_min(v))) ELSE v END", lambda d: S.ranges(ABS(), "minmax"), ABS_SQL)
_vector("uwb_standard", moments("v", "CASE WHEN $S > 0 THEN list_transform(v, lambda e: (e - $M) / $S) ELSE v END"), lambda d: S.ranges(ABS(), "standard"), ABS_SQL)
_vector("softmax", "list_transform(v, lambda e: exp(e - list_max(v)) / list_sum(list_transform(v, lambda q: exp(q - list_max(v)))))", lambda d: V.softmax(F_()))
_vector("padded", "list_resize(v, 70, 100.0)", lambda d: V.padded(F_(), 70, 100.0))
_vector("sequence_slice", "v[11:30]", lambda d: F.slice(F_(), 11, 20))

#: Complex values: successive halves of a fingerprint as real and imaginary parts.
RE, IM = lambda: F.slice(F_(), 1, 32), lambda: F.slice(F_(), 33, 32)
Z = lambda: C.from_parts(RE(), IM())
ZM = "list_transform(list_zip(features[1:32], features[33:64]), lambda p: sqrt(p[1] ^ 2 + p[2] ^ 2))"
ZP = "list_transform(list_zip(features[1:32], features[33:64]), lambda p: atan2(p[2], p[1]))"
_vector("csi_magnitude", "v", lambda d: C.magnitudes(Z()), ZM)
_vector("csi_phase", "v", lambda d: C.phases(Z()), ZP)
_vector("csi_mag_phase", "v", lambda d: C.magnitude_phase(Z()), f"list_concat({ZM}, {ZP})")
_vector("csi_real_imag", "v", lambda d: C.real_imaginary(Z()), "features")
_vector("csi_from_polar", "v", lambda d: C.real_imaginary(C.from_polar(RE(), IM())), "list_concat(list_transform(list_zip(features[1:32], features[33:64]), lambda p: p[1] * cos(p[2])), list_transform(list_zip(features[1:32], features[33:64]), lambda p: p[1] * sin(p[2])))")
_vector("csi_standard", f"list_concat({moments('v[1:32]', 'list_transform(v[1:32], lambda e: (e - $M) / ($S + 1e-8))')}, {moments('v[33:64]', 'list_transform(v[33:64], lambda e: (e - $M) / ($S + 1e-8))')})", lambda d: C.real_imaginary(C.normalised(Z(), "standard")))
_vector("csi_minmax", "list_transform(v, lambda e: (e - list_min(v)) / (list_max(v) - list_min(v) + 1e-8))", lambda d: C.magnitudes(C.normalised(Z(), "minmax")), ZM)
_vector("csi_unit", "list_transform(v, lambda e: e / (e + 1e-8))", lambda d: C.magnitudes(C.normalised(Z(), "unit")), ZM)

PARTS = lambda: F.create_map(F.lit("wifi"), F.slice(F_(), 1, 40), F.lit("ble"), F.slice(F_(), 41, 14), F.lit("magnetic"), F.slice(F_(), 55, 10))
WEIGHTS = lambda: F.create_map(F.lit("wifi"), F.lit(0.7), F.lit("ble"), F.lit(0.3))
_vector("hybrid_concat", "list_concat(list_concat(v[41:54], v[55:64]), v[1:40])", lambda d: S.fused(PARTS()))
_vector("hybrid_weighted", "list_concat(list_concat(list_transform(v[41:54], lambda e: e * 0.3), v[55:64]), list_transform(v[1:40], lambda e: e * 0.7))", lambda d: S.fused(PARTS(), WEIGHTS()))


def _rows(name: str, sql: str, build) -> None:
    query(name, f"WITH {FP} SELECT sample_id, {sql} FROM fp")(lambda s, d: rounded((fp := fingerprints(s, d)).select("sample_id", *build(fp))))


_rows("detected_count", "len(list_filter(features, lambda e: e <> 100))::INT AS n", lambda d: [S.detected(F_()).alias("n")])
_rows("argmax_class", "(list_position(features, list_max(features)) - 1)::INT AS cls, (list_position(features, list_max(features)) + 2)::INT AS shifted", lambda d: [V.argmax(F_()).alias("cls"), H.classified(F_(), 3).alias("shifted")])
_rows("joint_loss", "round(0.8 * x + 0.2 * y, 6) AS loss", lambda d: [H.joint_loss([(0.8, F.col("x")), (0.2, F.col("y"))]).alias("loss")])
_rows("path_loss", "round(10 ^ ((-59 - features[1]) / 20), 6) AS d, CASE WHEN sample_id % 2 = 0 THEN round(10 ^ ((-59 - features[2]) / 20), 6) END AS e", lambda d: [S.path_loss_distance(F.get(F_(), F.lit(0)), F.lit(-59.0)).alias("d"), S.path_loss_distance(F.get(F_(), F.lit(1)), F.when(F.col("sample_id") % 2 == 0, F.lit(-59.0))).alias("e")])
_rows("light_distance", "CASE WHEN features[1] > 0 THEN round(sqrt(1 / features[1]), 6) END AS d", lambda d: [S.light_distance(F.get(F_(), F.lit(0))).alias("d")])
_rows("tof_distance", "round(331.3::DOUBLE + 0.606::DOUBLE * (sample_id % 30), 6) AS speed, round((331.3::DOUBLE + 0.606::DOUBLE * (sample_id % 30)) * (0.01::DOUBLE * (sample_id % 7)), 6) AS d", lambda d: [S.sound_speed(F.col("sample_id") % 30).alias("speed"), F.element_at(S.flight_distances(F.create_map(F.lit("US1"), 0.01 * (F.col("sample_id") % 7)), S.sound_speed(F.col("sample_id") % 30)), "US1").alias("d")])
_rows("weight_shares", "round((1 + sample_id % 3) / (1 + sample_id % 3 + 2), 6) AS wifi", lambda d: [F.element_at(S.weight_shares(F.create_map(F.lit("wifi"), (1 + F.col("sample_id") % 3).cast("double"), F.lit("ble"), F.lit(2.0))), "wifi").alias("wifi")])
_rows("sorted_anchor_vector", "[x, x + 1, x + 2] AS v", lambda d: [S.sorted_values(F.create_map(F.lit("A2"), F.col("x") + 2, F.lit("A10"), F.col("x") + 1, F.lit("A1"), F.col("x"))).alias("v")])
_rows("polar_xy", "round(x * cos(radians(y)), 6) AS px, round(x * sin(radians(y)), 6) AS py", lambda d: [c.alias(n) for c, n in zip(G.polar(F.col("x"), F.col("y")), ("px", "py"), strict=True)])
_rows("dist2d_3d", "round(sqrt((x - 1) ^ 2 + (y - 2) ^ 2), 6) AS d2, round(sqrt((x - 1) ^ 2 + (y - 2) ^ 2 + (floor - 3) ^ 2), 6) AS d3", lambda d: [G.distance_2d(F.col("x"), F.col("y"), F.lit(1.0), F.lit(2.0)).alias("d2"), G.distance_3d(F.col("x"), F.col("y"), F.col("floor"), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("d3")])
_rows("coordinate_algebra", "x + y AS ax, x - y AS sx, x * 2.5 AS mx", lambda d: (lambda a, b: [G.added(a, b)["x"].alias("ax"), G.subtracted(a, b)["x"].alias("sx"), G.scaled(a, 2.5)["x"].alias("mx")])(G.coordinate(F.col("x"), F.col("y")), G.coordinate(F.col("y"), F.col("x"))))
_rows("location_matches", "CASE WHEN sample_id % 4 = 0 THEN true ELSE floor = sample_id % 5 END AS m", lambda d: [G.matches(F.when(F.col("sample_id") % 4 != 0, F.col("floor")), F.col("sample_id") % 5).alias("m")])
_rows("json_round_trip", "x, floor, building", lambda d: (lambda j: [j["x"].alias("x"), j["floor"].alias("floor"), j["building"].alias("building")])(F.from_json(F.to_json(F.struct("x", "floor", "building")), "x double, floor int, building string")))


@query("beacon_id", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || ':' || p_size || ':' || p_partkey WHEN p_size % 3 = 1 THEN p_type ELSE 'unknown' END AS id FROM part")
def _(spark, sf_dir):
    size = F.col("p_size") % 3
    return table(spark, sf_dir, "part").select("p_partkey", S.beacon_id(F.when(size == 0, F.col("p_brand")), F.col("p_size"), F.col("p_partkey"), F.when(size == 1, F.col("p_type"))).alias("id"))


VOCABULARY = "vocabulary AS (SELECT list(ap ORDER BY ap) AS w FROM (SELECT DISTINCT ap FROM long))"


def _dense(spark, sf_dir) -> tuple:
    long = scans(spark, sf_dir)
    return gathered(long, ["scan"], "ap", "rssi").crossJoin(F.broadcast(vocabulary(long, "ap")))  # one row


@query("vocab", f"WITH {SCANS} SELECT DISTINCT ap FROM long")
def _(spark, sf_dir):
    return vocabulary(scans(spark, sf_dir), "ap").select(F.explode("vocabulary").alias("ap"))


@query("sparse_to_dense", f"WITH {SCANS}, {VOCABULARY}, g AS (SELECT scan, map(list(ap), list(rssi)) AS m FROM long GROUP BY scan) SELECT scan, list_transform(w, lambda k: coalesce(m[k], 100.0)) AS v FROM g, vocabulary")
def _(spark, sf_dir):
    return _dense(spark, sf_dir).select("scan", S.to_dense(F.col("readings"), F.col("vocabulary")).alias("v"))


@query("dense_to_sparse", f"WITH {SCANS} SELECT scan, count(*)::INT AS n, round(sum(rssi), 6) AS total FROM long GROUP BY scan")
def _(spark, sf_dir):
    dense = _dense(spark, sf_dir).withColumn("v", S.to_dense(F.col("readings"), F.col("vocabulary")))
    back = dense.select("scan", S.to_sparse(F.col("v"), F.col("vocabulary")).alias("m"))
    return rounded(back.select("scan", F.size("m").alias("n"), V.total(F.map_values("m")).alias("total")))


@query("get_rssi", f"WITH {SCANS} SELECT scan, max(CASE WHEN ap = 'AP7' THEN rssi END) AS rssi FROM long GROUP BY scan")
def _(spark, sf_dir):
    return gathered(scans(spark, sf_dir), ["scan"], "ap", "rssi").select("scan", S.reading(F.col("readings"), F.lit("AP7")).alias("rssi"))


@query("trilaterate", f"WITH {RANGES} SELECT DISTINCT sample_id, round(tx, 3) + 0.0 AS px, round(ty, 3) + 0.0 AS py, round(tz, 3) + 0.0 AS pz FROM ranges")
def _(spark, sf_dir):
    return rounded(trilaterated(ranges(spark, sf_dir)), 3)


@query("trilaterate_flipped", f"WITH {RANGES} SELECT DISTINCT sample_id, round(-tx, 3) + 0.0 AS px, round(-ty, 3) + 0.0 AS py, round(-tz, 3) + 0.0 AS pz FROM ranges")
def _(spark, sf_dir):
    return rounded(trilaterated(ranges(spark, sf_dir), flipped=True), 3)
