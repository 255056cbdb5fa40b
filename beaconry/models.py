"""Locators by name, and the sink of their predictions."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.knn import KNNLocalizer, WKNNLocalizer
from .operators.metrics import evaluated, results, same, with_error
from .operators.network import NetworkLocalizer
from .registry import LOCALIZERS

for _name, _builder in (("knn", KNNLocalizer), ("KNNLocalizer", KNNLocalizer), ("wknn", WKNNLocalizer), ("WKNNLocalizer", WKNNLocalizer), ("deep", NetworkLocalizer), ("DeepLocalizer", NetworkLocalizer)):
    LOCALIZERS.register(_name)(_builder)
#: Fingerprints up to which ``auto`` takes neighbours; above, a network.
FEW = 5000


def create_model(name: str | dict = "auto", *, dataset: DataFrame | None = None, **options) -> KNNLocalizer | NetworkLocalizer:
    """A locator by name or settings; ``auto`` is weighted neighbours up to FEW rows of ``dataset``, and a network above.

    Without a ``dataset`` ``auto`` is weighted neighbours.
    """
    told = dict(name) if isinstance(name, dict) else {"type": name}
    if told.get("type") == "auto":
        told["type"] = "deep" if dataset is not None and dataset.limit(FEW + 1).count() > FEW else "wknn"
    return LOCALIZERS.build(told, **options)


def load_model(spark: SparkSession, path: str) -> KNNLocalizer | NetworkLocalizer:
    """The locator of either kind that ``save`` left at ``path``."""
    return (NetworkLocalizer if "hidden" in spark.read.json(f"{path}/parameters").columns else KNNLocalizer).load(spark, path)


def labels(places: DataFrame) -> DataFrame:
    """``sample_id, x, y, floor, building`` as numbers, for learners: an unknown floor or building is -1.

    A building that isn't a whole number is an error, as it would be lost; ``StringIndexer`` numbers names.
    """
    number = F.col("building").try_cast("int")
    checked = F.when(F.col("building").isNull(), -1).when(number.isNull(), F.raise_error(F.concat(F.lit("a building isn't a whole number: "), F.col("building").cast("string")))).otherwise(number)
    return places.select("sample_id", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.coalesce(F.col("floor").cast("int"), F.lit(-1)).alias("floor"), checked.cast("int").alias("building"))


def list_models() -> list[str]:
    return LOCALIZERS.names()


def with_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions beside ``gt_x, gt_y, gt_floor, gt_building``, joined by id; unpredicted columns are null."""
    told = truth.select(F.col("sample_id").alias("query_id"), *(F.col(c).alias(f"gt_{c}") for c in ("x", "y", "floor", "building") if c in truth.columns))
    both = predictions.join(told, "query_id")
    for c in ("floor", "building"):
        for side in ("pred", "gt"):
            if f"{side}_{c}" not in both.columns:
                both = both.withColumn(f"{side}_{c}", F.lit(None).cast("string"))
    return both


def evaluate(model: KNNLocalizer, queries: DataFrame, metrics: tuple | None = None) -> DataFrame:
    """One row: the summary, or the metrics that are named."""
    both = with_truth(model.predict(queries), queries)
    return results(both) if metrics is None else evaluated(both, metrics)


def timed(model: KNNLocalizer, queries: DataFrame) -> tuple[list, float]:
    """A small query table's predictions and the milliseconds they took."""
    began = time.perf_counter()
    rows = model.predict(queries).collect()
    return rows, 1000 * (time.perf_counter() - began)


#: Columns of the predictions' file.
COLUMNS = ("pred_x", "pred_y", "pred_floor", "pred_building", "gt_x", "gt_y", "gt_floor", "gt_building", "error_2d", "floor_correct", "building_correct")


def prediction_rows(both: DataFrame) -> DataFrame:
    return with_error(both).withColumn("floor_correct", same("floor")).withColumn("building_correct", same("building")).select(*COLUMNS)


def save_predictions(both: DataFrame, path: str) -> None:
    prediction_rows(both).write.mode("overwrite").option("header", True).csv(path)
