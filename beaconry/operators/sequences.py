"""Operators over ordered samples: steps, windows, rates, durations, per-axis scaling, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import global_rank


def steps(samples: DataFrame, value: str = "magnitude", *, key: str = "sample_id", order: str = "idx", threshold: float = 1.0) -> DataFrame:
    """Rows that are a strict local peak and stand more than ``threshold`` above the lower neighbour; ends never do."""
    w = W.partitionBy(key).orderBy(order)
    near = samples.withColumn("_before", F.lag(value).over(w)).withColumn("_after", F.lead(value).over(w))
    v = F.col(value)
    peak = (v > F.col("_before")) & (v > F.col("_after")) & (v - F.least("_before", "_after") > threshold)
    return near.where(peak).drop("_before", "_after")


def window_of(samples: DataFrame, start: int, size: int, *, order: str = "idx") -> DataFrame:
    """``size`` samples from index ``start``."""
    return samples.where((F.col(order) >= start) & (F.col(order) < start + size))


def span_of(values: Column, start: int, end: int) -> Column:
    """Elements of an array from index ``start`` up to ``end``, exclusive."""
    return F.slice(values, start + 1, max(0, end - start))


def sampling_rate(timestamp: str = "ts") -> Column:
    """Samples a second from the mean gap, as an aggregate; null for fewer than two."""
    span = F.max(timestamp) - F.min(timestamp)
    return F.when(span > 0, (F.count(timestamp) - 1) / span)


def duration(timestamp: str = "ts", order: str = "idx", rate: Column | None = None) -> Column:
    """Seconds from first to last sample; without timestamps the number of samples over ``rate``, else 0."""
    told = F.max_by(timestamp, order) - F.min_by(timestamp, order)
    counted = F.count("*") / rate if rate is not None else F.lit(None).cast("double")
    return F.coalesce(told, counted, F.lit(0.0))


def axis_scaled(samples: DataFrame, columns: tuple[str, ...], method: str = "standard", *, key: str = "sample_id", epsilon: float = 1e-8, gravity: float = 9.81) -> DataFrame:
    """Each axis scaled inside its sample: ``standard``, ``minmax``, ``gravity``; other methods change nothing."""
    w = W.partitionBy(key)
    if method == "standard":
        new = {c: (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + epsilon) for c in columns}
    elif method == "minmax":
        new = {c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + epsilon) for c in columns}
    elif method == "gravity":
        new = {c: F.col(c) / gravity for c in columns}
    else:
        new = {}
    return samples.withColumns(new) if new else samples


def first_seen(rows: DataFrame, label: str, order: str) -> DataFrame:
    """``label, place``: labels numbered from 0 in order of their first row, by ranges."""
    first = rows.groupBy(label).agg(F.min(order).alias("_first"))
    return global_rank(first, ["_first", label], "place").withColumn("place", (F.col("place") - 1).cast("int")).drop("_first")


def as_of(left: DataFrame, right: DataFrame, value: str, *, key: str, time: str, name: str) -> DataFrame:
    """``left`` with ``name``: the latest ``value`` of ``right`` with the same key and a time not after; null if none."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.select(key, time, F.lit(0).alias("_side"), F.col(value).alias("_value"))
    w = W.partitionBy(key).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(name, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_value")


def nearest_in_time(left: DataFrame, right: DataFrame, columns: tuple[str, ...], *, key: str, time: str, tolerance: float, gap: str = "gap", spans: int = 64) -> DataFrame:
    """``left`` with ``columns`` of the ``right`` row of the same key whose ``time`` is nearest, and their ``gap`` in seconds.

    Rows more than ``tolerance`` seconds away don't count, and then the columns are null. Of two equally near rows the
    earlier one is taken, of rows at one time the least. ``time`` is in seconds. Rows of ``left`` with a null key or time
    get nulls, those of ``right`` take no part.

    Keys are cut into stretches of ``spans`` tolerances; a right row near an edge is also dealt to the next stretch, so each
    stretch is joined by itself and a key that holds most rows is many tasks' work.
    """
    if tolerance < 0:
        raise ValueError("the tolerance is below 0")
    width = max(spans * tolerance, 1e-6)
    stretch = lambda at: F.floor(at / F.lit(width))
    struct = F.struct(*(F.col(c) for c in columns))
    known = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, F.col(time).cast("double").alias("_at")).agg(F.min(struct).alias("_told"))
    copies = known.withColumn("_s", F.explode(F.sequence(stretch(F.col("_at") - tolerance), stretch(F.col("_at") + tolerance))))
    asked = left.withColumn("_at", F.col(time).cast("double")).withColumn("_s", stretch(F.col("_at"))).withColumn("_side", F.lit(1))
    both = asked.unionByName(copies.select(key, "_at", "_s", F.lit(0).alias("_side"), F.struct(F.col("_at").alias("at"), F.col("_told").alias("told")).alias("_r")), allowMissingColumns=True)
    near = W.partitionBy(key, "_s")
    before = F.last("_r", ignorenulls=True).over(near.orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.last("_r", ignorenulls=True).over(near.orderBy(F.desc("_at"), "_side").rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = both.withColumn("_before", before).withColumn("_after", after).where("_side = 1")
    back, ahead = F.col("_at") - F.col("_before.at"), F.col("_after.at") - F.col("_at")
    best = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("_before")).otherwise(F.col("_after"))
    out = ends.withColumn("_best", best).withColumn(gap, F.abs(F.col("_best.at") - F.col("_at"))).withColumn("_best", F.when(F.col(gap) <= tolerance, F.col("_best")))
    named = {c: F.col("_best.told").getField(c) for c in columns} | {gap: F.when(F.col("_best").isNotNull(), F.col(gap))}
    return out.withColumns(named).drop("_at", "_s", "_side", "_r", "_before", "_after", "_best")
