"""Dataset statistics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import heading, magnitude
from ..functions.signals import detected
from ..functions.vectors import mean


def distinct_with_null(name: str) -> Column:
    """Number of different values, an unknown one included."""
    return F.count_distinct(name) + F.max(F.col(name).isNull().cast("int"))


def dataset(df: DataFrame) -> DataFrame:
    """Count, extent, and floors and buildings with their sorted sets of known values."""
    return df.agg(
        F.count("*").alias("num_samples"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        distinct_with_null("floor").alias("num_floors"), F.array_sort(F.collect_set("floor")).alias("floors"),
        distinct_with_null("building").alias("num_buildings"), F.array_sort(F.collect_set("building")).alias("buildings"),
    )


def detections(df: DataFrame, vector: str = "features", absent: float = 100.0) -> DataFrame:
    n = detected(F.col(vector), absent)
    return df.agg(F.avg(n).alias("avg_detected"), F.min(n).alias("min_detected"), F.max(n).alias("max_detected"))


def distance_spread(df: DataFrame, distances: str = "distances") -> DataFrame:
    """Over all values of a map column of distances."""
    long = df.select(F.explode(F.map_values(distances)).alias("d"))
    return long.agg(F.avg("d").alias("mean_distance"), F.min("d").alias("min_distance"), F.max("d").alias("max_distance"), F.stddev_pop("d").alias("std_distance"))


def channel(df: DataFrame, magnitudes: str = "magnitudes") -> DataFrame:
    """Mean and population deviation of the samples' mean magnitudes."""
    per = df.select(mean(F.col(magnitudes)).alias("m"))
    return per.agg(F.avg("m").alias("mean_magnitude"), F.stddev_pop("m").alias("std_magnitude"))


def magnetic(samples: DataFrame) -> DataFrame:
    """Field strength and heading over all readings; headings are averaged as numbers, not as angles."""
    told = samples.select(magnitude(F.col("mx"), F.col("my"), F.col("mz")).alias("m"), heading(F.col("mx"), F.col("my")).alias("h"))
    return told.agg(F.avg("m").alias("avg_magnitude"), F.min("m").alias("min_magnitude"), F.max("m").alias("max_magnitude"), F.stddev_pop("m").alias("std_magnitude"), F.avg("h").alias("avg_heading"), F.stddev_pop("h").alias("std_heading"))


def modalities(df: DataFrame, column: str = "modalities") -> DataFrame:
    """Whole part of the mean width of each modality in a map of vectors."""
    long = df.select(F.explode(column).alias("modality", "v"))
    return long.groupBy("modality").agg(F.floor(F.avg(F.size("v"))).cast("int").alias("dim"))


def per_floor(df: DataFrame) -> DataFrame:
    return df.groupBy("building", "floor").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
