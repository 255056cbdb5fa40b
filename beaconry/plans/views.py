"""Sensor-like views of the standard tables, in DataFrames and, alike, in SQL.

Fingerprints come from ``embeddings``: a component not above 0 is an undetected transmitter. Scans come from ``lineitem``,
motion from ``events``, anchors and ranges from ``supplier`` and ``orders``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signals import wifi
from ..operators.shaping import row_halves
from .registry import table

FP = """fp AS (
  SELECT vec_id AS sample_id, list_transform(embedding, lambda e: CASE WHEN e <= 0 THEN 100.0::DOUBLE ELSE -104.0::DOUBLE + 104.0::DOUBLE * e::DOUBLE END) AS features,
         list_transform(embedding, lambda e: CASE WHEN e <= 0 THEN 0.0::DOUBLE ELSE (-104.0::DOUBLE + 104.0::DOUBLE * e::DOUBLE + 104.0::DOUBLE) / 104.0::DOUBLE END) AS unit,
         (label * 10 + vec_id % 7)::DOUBLE AS x, ((label % 3) * 20 + vec_id % 11)::DOUBLE AS y, label % 5 AS floor,
         (label // 5)::VARCHAR AS building, vec_id % 13 AS user_id FROM embeddings)"""
SPLIT = f"""{FP}, ranked AS (SELECT *, row_number() OVER (ORDER BY sample_id) AS rn, count(*) OVER () AS n FROM fp),
train AS (SELECT * FROM ranked WHERE rn <= floor(n * 0.7)), test AS (SELECT * FROM ranked WHERE rn > floor(n * 0.7))"""


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rssi = F.transform("embedding", lambda v: F.when(v <= 0, 100.0).otherwise(-104.0 + 104.0 * v.cast("double")))
    label, vec = F.col("label"), F.col("vec_id")
    return e.select(
        vec.alias("sample_id"), rssi.alias("features"), (label * 10 + vec % 7).cast("double").alias("x"), ((label % 3) * 20 + vec % 11).cast("double").alias("y"),
        (label % 5).alias("floor"), F.expr("cast(label div 5 as string)").alias("building"), (vec % 13).alias("user_id"),
    )


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, sf_dir).withColumn("features", wifi(F.col("features")))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Normalised fingerprints, split by order: 0.7 for training, the rest to be located."""
    return row_halves(normalised(spark, sf_dir), 0.7, "sample_id")


SCANS = """long AS (SELECT l_orderkey AS scan, 'AP' || (l_suppkey % 50) AS ap, max(-(30 + l_quantity)) AS rssi FROM lineitem GROUP BY 1, 2)"""


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows ``scan, ap, rssi``: all readings of each transmitter in a scan."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan"), F.concat(F.lit("AP"), F.col("l_suppkey") % 50).alias("ap"), (-(30 + F.col("l_quantity"))).alias("rssi"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows ``scan, ap, rssi``: the strongest reading of each transmitter in a scan."""
    return heard(spark, sf_dir).groupBy("scan", "ap").agg(F.max("rssi").alias("rssi"))


MOTION = """motion AS (
  SELECT user_id AS sample_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS idx, epoch_us(ts) / 1000000.0 AS ts,
         value AS ax, value * 0.5 - event_id % 7 AS ay, (event_id % 11)::DOUBLE AS az FROM events)"""


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples ``sample_id, idx, ts, ax, ay, az``, one sequence per user."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    idx = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    seconds = F.expr("unix_micros(cast(ts as timestamp))") / 1_000_000.0
    return e.select(F.col("user_id").alias("sample_id"), idx.alias("idx"), seconds.alias("ts"), F.col("value").alias("ax"), (F.col("value") * 0.5 - F.col("event_id") % 7).alias("ay"), (F.col("event_id") % 11).cast("double").alias("az"))


RANGES = """anchors AS (SELECT s_suppkey AS anchor_id, s_nationkey::DOUBLE AS x, (s_suppkey % 17)::DOUBLE AS y, (s_suppkey % 5)::DOUBLE AS z FROM supplier WHERE s_suppkey <= 8),
places AS (SELECT o_orderkey AS sample_id, (o_orderkey % 23)::DOUBLE AS tx, (o_orderkey % 19)::DOUBLE AS ty, (o_orderkey % 3)::DOUBLE AS tz FROM orders),
ranges AS (SELECT *, sqrt((tx - x) ^ 2 + (ty - y) ^ 2 + (tz - z) ^ 2) AS distance FROM places, anchors)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distances from every order's place to eight anchors, the site that the queries assume."""
    a = table(spark, sf_dir, "supplier").where("s_suppkey <= 8").select(F.col("s_suppkey").alias("anchor_id"), F.col("s_nationkey").cast("double").alias("x"), (F.col("s_suppkey") % 17).cast("double").alias("y"), (F.col("s_suppkey") % 5).cast("double").alias("z"))
    key = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(key.alias("sample_id"), (key % 23).cast("double").alias("tx"), (key % 19).cast("double").alias("ty"), (key % 3).cast("double").alias("tz"))
    gap = sum(((F.col(f"t{c}") - F.col(c)) * (F.col(f"t{c}") - F.col(c)) for c in "yz"), (F.col("tx") - F.col("x")) * (F.col("tx") - F.col("x")))
    return p.crossJoin(F.broadcast(a)).withColumn("distance", F.sqrt(gap))  # eight anchors


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles and arrays of doubles rounded, so that the order of sums doesn't show."""

    def cell(name: str, kind: str) -> Column:
        if kind == "double":
            return (F.round(name, places) + 0.0).alias(name)
        if kind == "array<double>":
            return F.transform(name, lambda v: F.round(v, places) + 0.0).alias(name)
        return F.col(name)

    return df.select(*(cell(n, k) for n, k in df.dtypes))
