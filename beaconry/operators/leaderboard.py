"""Published results and comparisons with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "dataset string, method string, mean_error double, floor_accuracy double, building_accuracy double, year int, source string, is_sota boolean, ord int"
#: Published accuracies per dataset, with their sources as published. Method, mean error (m), floor and
#: building accuracy (%), year, source, state of the art.
PUBLISHED: dict[str, list[tuple]] = {
    "ujindoorloc": [
        ("GBDT + Sample Diff", 2.45, 99.14, None, 2021, "Li et al., A universal Wi-Fi fingerprint localization method, Satellite Navigation, 2021", True),
        ("XGBoost + Sample Diff", 3.42, 99.40, None, 2021, "Li et al., Satellite Navigation, 2021", False),
        ("FasterKAN", 3.56, 99.00, 99.00, 2024, "Kolmogorov-Arnold Networks for Indoor Localization, 2024", False),
        ("LSTM", 4.2, None, None, 2019, "Hoang et al., Recurrent Neural Networks For Accurate RSSI Indoor Localization, IEEE IoT Journal, 2019", False),
        ("DNN-WKNN Hybrid", 7.82, 95.00, None, 2025, "Fingerprinting Indoor Positioning Based on Improved Sequential Deep Learning, MDPI Algorithms, 2025", False),
        ("MLNN", 7.5, None, None, 2019, "Hoang et al., IEEE IoT Journal, 2019", False),
        ("CNN (Lightweight)", 9.5, 90.00, 99.00, 2019, "Comparison of CNN Applications for RSSI-Based Fingerprint Indoor Localization, MDPI Electronics, 2019", False),
        ("CNNLoc", 11.78, 91.35, 99.91, 2019, "Song et al., CNNLoc: Deep-Learning Based Indoor Localization with WiFi Fingerprinting, IEEE CCNC, 2019", False),
        ("CCPos (CDAE-CNN)", 12.4, 95.30, 99.60, 2020, "CDAELoc: Convolutional Denoising Autoencoder for Indoor Localization, 2020", False),
        ("RADAR (KNN)", 8.1, None, None, 2019, "Hoang et al., IEEE IoT Journal, 2019", False),
        ("KNN (k=1)", 7.9, 91.60, 99.20, 2014, "Torres-Sospedra et al., UJIndoorLoc: A new multi-building database, IPIN 2014", False),
        ("WKNN (k=3)", 7.3, 92.50, None, 2014, "Torres-Sospedra et al., IPIN 2014", False),
        ("Hierarchical DNN", 9.29, 92.40, None, 2018, "Kim et al., A Scalable Deep Neural Network Architecture for Multi-Building Indoor Localization, Big Data Analytics, 2018", False),
        ("Random Forest", 10.8, 89.00, None, 2017, "Ensemble Methods for WiFi Indoor Localization, 2017", False),
    ],
    "sodindoorloc": [
        ("DNN Hierarchical", 6.78, 94.30, None, 2018, "SOD Dataset Paper", True),
        ("CNN-2D", 7.23, 92.80, None, 2020, "CNN Indoor Loc", False),
        ("KNN (k=1)", 12.45, 85.60, None, 2018, "Baseline", False),
        ("WKNN (k=3)", 10.23, 88.90, None, 2018, "Baseline", False),
        ("WKNN (k=5)", 9.87, 90.10, None, 2018, "Baseline", False),
        ("Random Forest", 8.92, 91.20, None, 2019, "Ensemble Study", False),
    ],
    "tampere": [
        ("DNN (3-layer)", 3.45, 96.70, None, 2017, "Tampere Dataset Paper", False),
        ("CNN-1D", 2.89, 98.10, None, 2020, "1D Conv Study", True),
        ("ResNet-18", 3.12, 97.40, None, 2021, "Transfer Learning Study", False),
        ("KNN (k=1)", 5.21, 91.20, None, 2017, "Baseline", False),
        ("WKNN (k=3)", 4.56, 93.40, None, 2017, "Baseline", False),
        ("WKNN (k=5)", 4.32, 94.10, None, 2017, "Baseline", False),
        ("Random Forest", 4.78, 92.30, None, 2019, "Ensemble Study", False),
        ("Gaussian Process", 3.89, 95.60, None, 2018, "GP Localization", False),
    ],
}
ALIASES = {"uji": "ujindoorloc", "sod": "sodindoorloc"}


def rows() -> list[tuple]:
    return [(d, *e, k) for d, es in PUBLISHED.items() for k, e in enumerate(es)]


def published(spark: SparkSession, dataset: str | None = None) -> DataFrame:
    """The results of one dataset, by name or alias in any case, or of all."""
    all_ = spark.createDataFrame(rows(), SCHEMA)
    if dataset is None:
        return all_
    name = dataset.lower()
    return all_.where(F.col("dataset") == ALIASES.get(name, name))


def registered(spark: SparkSession, table: DataFrame, dataset: str, entries: list[tuple]) -> DataFrame:
    """``table`` with results of another dataset."""
    return table.unionByName(spark.createDataFrame([(dataset.lower(), *e, k) for k, e in enumerate(entries)], SCHEMA))


def state_of_the_art(table: DataFrame) -> DataFrame:
    """Per dataset its flagged result, the first if several, else the one of least mean error."""
    order = F.struct((~F.col("is_sota")).alias("a"), F.when(F.col("is_sota"), F.col("ord").cast("double")).otherwise(F.col("mean_error")).alias("b"), F.col("ord").alias("c"))
    return table.groupBy("dataset").agg(F.min_by(F.struct("method", "mean_error"), order).alias("s")).select("dataset", F.col("s.method").alias("sota_method"), F.col("s.mean_error").alias("sota_error"))


def compared(results: DataFrame, table: DataFrame) -> DataFrame:
    """``results (dataset, mean_error)`` with beats, rank, entries, and the gap to the state of the art in m and %."""
    theirs = table.select("dataset", F.col("mean_error").alias("b"))
    both = results.join(theirs, "dataset")
    counted = both.groupBy("dataset", "mean_error").agg(
        F.sum((F.col("mean_error") < F.col("b")).cast("int")).alias("beats_count"), (1 + F.sum((F.col("b") < F.col("mean_error")).cast("int"))).alias("ranking"), F.count("*").alias("num_entries"))
    gap = F.col("mean_error") - F.col("sota_error")
    return counted.join(state_of_the_art(table), "dataset").withColumn("gap_to_sota", gap).withColumn("gap_to_sota_percent", F.when(F.col("sota_error") != 0, 100 * gap / F.col("sota_error")))


def result_comparison(spark: SparkSession, results: DataFrame, dataset: str) -> DataFrame:
    """A summary row beside a dataset's published results, best first; ours is marked. Without published results no rows.

    Gaps are ours less theirs, in metres; equal errors rank by the order of publication, ours last.
    """
    theirs = published(spark, dataset).select("method", "mean_error", "floor_accuracy", "building_accuracy", "year", "source", "ord", F.lit(False).alias("ours"))
    mine = results.select(F.lit("this run").alias("method"), *("mean_error", "floor_accuracy", "building_accuracy"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("source"), F.lit(1 << 30).alias("ord"), F.lit(True).alias("ours"))
    known = theirs.agg(F.count("*").alias("_n"))
    both = theirs.unionByName(mine).crossJoin(F.broadcast(known)).where("_n > 0")  # one number
    own = F.max(F.when(F.col("ours"), F.col("mean_error"))).over(W.partitionBy("_n"))
    place = F.row_number().over(W.partitionBy("_n").orderBy("mean_error", "ord"))  # a dataset's published results: a few rows
    return both.withColumn("place", place).withColumn("gap", own - F.col("mean_error")).drop("ord", "_n").orderBy("place")


def comparison_text(rows: list) -> str:
    """A printable table of ``result_comparison``."""
    number = lambda v, unit: f"{v:.2f} {unit}" if v is not None else "-"
    head = f"{'':<4}{'method':<24}{'error':>10}{'floor':>10}{'building':>11}{'gap':>10}  source"
    line = lambda r: f"{r['place']:<4}{('> ' if r['ours'] else '') + r['method']:<24}{number(r['mean_error'], 'm'):>10}{number(r['floor_accuracy'], '%'):>10}{number(r['building_accuracy'], '%'):>11}{number(r['gap'], 'm'):>10}  {r['source'] or ''}"
    return "\n".join([head, *(line(r).rstrip() for r in rows)])


def author() -> Column:
    """The first author of a source, in lower case."""
    return F.lower(F.trim(F.get(F.split("source", ","), F.lit(0))))


def first_by_author(table: DataFrame) -> DataFrame:
    """One source per dataset and first author, the first listed."""
    return table.groupBy("dataset", author().alias("author")).agg(F.min_by("source", "ord").alias("source"))
