"""Outputs of learned models on array columns: class, probability, offset, joint loss; and native learners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax, once, softmax


def classified(logits: Column, offset: int = 0, names: list[str] | None = None) -> Column:
    """Class index plus an offset, or its name."""
    at = argmax(logits)
    return F.get(F.array(*map(F.lit, names)), at) if names else at + F.lit(offset)


def probability(logits: Column) -> Column:
    return F.array_max(softmax(logits))


def cross_entropy(logits: Column, label: Column) -> Column:
    return -F.log(F.get(softmax(logits), label))


def joint_loss(losses: list[tuple[float, Column]]) -> Column:
    """Weighted sum of losses."""
    return sum((F.lit(w) * c for w, c in losses[1:]), F.lit(losses[0][0]) * losses[0][1])


def reshaped(features: Column, height: int, width: int) -> Column:
    """A vector as rows of a matrix, filled with zeros or cut."""
    from ..functions.vectors import padded

    flat = padded(features, height * width, 0.0)
    return F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda k: F.slice(flat, k * width + 1, F.lit(width)))


def refined(coarse: Column, *residuals: Column) -> Column:
    """Coordinates by scales: a coarse estimate, moved by the residual of each finer scale."""
    out = coarse
    for r in residuals:
        out = F.zip_with(out, r, lambda a, b: a + b)
    return out


def hierarchical(buildings: Column, floors: Column, places: Column) -> Column:
    """``struct<building, floor, place>``: the best building, its best floor, and the coordinates there.

    ``buildings`` are logits, ``floors`` logits by building, ``places`` coordinates by building and floor.
    """
    b = argmax(buildings)
    return once(b, lambda k: once(argmax(F.get(floors, k)), lambda f: F.struct(k.alias("building"), f.alias("floor"), F.get(F.get(places, k), f).alias("place"))))


def learned_scales(train: DataFrame, test: DataFrame, *, scales: int = 3, seed: int = 42, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``test`` with ``pred_<column>``: a linear estimate, then trees that learn what the scales before left, from it and the features."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    a, b = (d.withColumn("_v", array_to_vector("features")) for d in (train, test))
    for c in columns:
        a, b = (LinearRegression(featuresCol="_v", labelCol=c, predictionCol=f"pred_{c}", regParam=0.1).fit(a).transform(d) for d in (a, b))
    for k in range(1, scales):
        both = VectorAssembler(inputCols=["_v", *(f"pred_{c}" for c in columns)], outputCol="_w")
        a, b = both.transform(a), both.transform(b)
        for c in columns:
            model = DecisionTreeRegressor(featuresCol="_w", labelCol="_left", predictionCol="_step", maxDepth=3 + k, seed=seed).fit(a.withColumn("_left", F.col(c) - F.col(f"pred_{c}")))
            a, b = (model.transform(d).withColumn(f"_next_{c}", F.col(f"pred_{c}") + F.col("_step")).drop("_step") for d in (a, b))
        a, b = (d.drop("_w", *(f"pred_{c}" for c in columns)).withColumnsRenamed({f"_next_{c}": f"pred_{c}" for c in columns}) for d in (a, b))
    return b.drop("_v")


def learned_hierarchy(train: DataFrame, test: DataFrame, *, seed: int = 42) -> DataFrame:
    """``test`` with ``pred_building, pred_floor, pred_x, pred_y``, each learned from the features and the labels before it.

    Training sees true labels, prediction the predicted ones. Buildings are names, floors whole numbers from 0.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    a, b = (d.withColumn("_v", array_to_vector("features")) for d in (train, test))
    names = StringIndexer(inputCol="building", outputCol="_b", handleInvalid="keep").fit(a)
    a = names.transform(a).withColumn("_f", F.col("floor").cast("double"))

    def chosen(label: str, features: str) -> DataFrame:
        model = RandomForestClassifier(featuresCol=features, labelCol=label, predictionCol="_p", numTrees=20, maxDepth=6, seed=seed).fit(a)
        return model.transform(b).drop("rawPrediction", "probability").withColumnRenamed("_p", label)

    def beside(label: str, features: str, out: str) -> tuple[DataFrame, DataFrame]:
        code = OneHotEncoder(inputCol=label, outputCol=f"{label}_code", handleInvalid="keep").fit(a)
        join = VectorAssembler(inputCols=[features, f"{label}_code"], outputCol=out)
        return join.transform(code.transform(a)), join.transform(code.transform(b))

    b = chosen("_b", "_v")
    a, b = beside("_b", "_v", "_vb")
    b = chosen("_f", "_vb")
    a, b = beside("_f", "_vb", "_vbf")
    for c in ("x", "y"):
        b = LinearRegression(featuresCol="_vbf", labelCol=c, predictionCol=f"pred_{c}", regParam=0.1).fit(a).transform(b)
    b = IndexToString(inputCol="_b", outputCol="pred_building", labels=names.labels).transform(b)
    return b.withColumn("pred_floor", F.col("_f").cast("int")).select(*test.columns, "pred_building", "pred_floor", "pred_x", "pred_y")


def learned(train: DataFrame, test: DataFrame, *, seed: int = 42, hidden: int = 32) -> DataFrame:
    """``test`` with ``pred_x, pred_y, pred_floor`` from linear regressions and a perceptron, trained by Spark's learners.

    ``train`` and ``test`` have ``features, x, y, floor``; floors are numbers from 0.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    width, floors = len(train.first()["features"]), train.agg(F.max("floor")).first()[0] + 1
    a, b = (d.withColumn("_v", array_to_vector("features")) for d in (train, test))
    for target in ("x", "y"):
        b = LinearRegression(featuresCol="_v", labelCol=target, predictionCol=f"pred_{target}", regParam=0.1).fit(a).transform(b)
    floor = MultilayerPerceptronClassifier(featuresCol="_v", labelCol="floor", predictionCol="_f", layers=[width, hidden, max(2, floors)], maxIter=30, seed=seed)
    out = floor.fit(a).transform(b)
    return out.withColumn("pred_floor", F.col("_f").cast("int")).drop("_v", "_f", "rawPrediction", "probability")
