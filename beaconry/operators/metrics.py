"""Position errors, accuracies and their distribution.

A metric is an aggregate Column, or a percentile: those are read from ranks over all errors, which ranges of errors give, so
that no task holds every error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import distance_2d
from ..shared import written

#: Error limits of the cumulative distribution, in metres.
LIMITS = (1, 2, 3, 5, 10, 15, 20)
ERROR = "error_2d"


def with_error(df: DataFrame, px: str = "pred_x", py: str = "pred_y", gx: str = "gt_x", gy: str = "gt_y") -> DataFrame:
    return df.withColumn(ERROR, distance_2d(F.col(px), F.col(py), F.col(gx), F.col(gy)))


def share(condition: Column) -> Column:
    """Percent of rows."""
    return 100 * F.avg(condition.cast("int"))


def same(name: str) -> Column:
    """Whether prediction and truth agree; two unknown values do."""
    return F.col(f"pred_{name}").eqNullSafe(F.col(f"gt_{name}"))


class Percentile(float):
    """A metric that is read from ranks."""


#: Name, unit and aggregate, or percentile, of each metric.
METRICS: dict[str, tuple[str, object]] = {
    "mean_position_error": ("m", lambda **_: F.avg(ERROR)),
    "median_position_error": ("m", lambda **_: Percentile(50)),
    "percentile_error": ("m", lambda percentile=75, **_: Percentile(percentile)),
    "max_position_error": ("m", lambda **_: F.max(ERROR)),
    "rms_position_error": ("m", lambda **_: F.sqrt(F.avg(F.col(ERROR) * F.col(ERROR)))),
    "floor_accuracy": ("%", lambda **_: share(same("floor"))),
    "building_accuracy": ("%", lambda **_: share(same("building"))),
    "floor_building_accuracy": ("%", lambda **_: share(same("floor") & same("building"))),
}
DEFAULT = ("mean_position_error", "median_position_error", "percentile_error", "rms_position_error", "floor_accuracy", "building_accuracy")


def percentiles(errors: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """One row: by name the exact percentile (0 to 100) of ERROR, between two errors in proportion; null without errors."""
    known = errors.select(ERROR).where(F.col(ERROR).isNotNull())
    ranked = global_rank(known, [ERROR], "_rank")
    ranked = ranked.crossJoin(F.broadcast(known.agg(F.count("*").alias("_n"))))  # one number
    at = {name: F.lit(p / 100.0) * (F.col("_n") - 1) for name, p in wanted.items()}
    error = lambda place: F.max(F.when(F.col("_rank") - 1 == place, F.col(ERROR)))
    ends = [c for name, h in at.items() for c in (error(F.floor(h)).alias(f"_lo_{name}"), error(F.ceil(h)).alias(f"_hi_{name}"), F.max(h - F.floor(h)).alias(f"_part_{name}"))]
    between = lambda name: F.col(f"_lo_{name}") + F.col(f"_part_{name}") * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
    return ranked.agg(*ends).select(*(between(name).alias(name) for name in wanted))


def told(df: DataFrame, figures: dict[str, Column | Percentile]) -> DataFrame:
    """One row with ``figures`` over ``df``, which has ERROR: aggregates from one pass, percentiles from the ranks."""
    ranks = {name: float(f) for name, f in figures.items() if isinstance(f, Percentile)}
    sums = [f.alias(name) for name, f in figures.items() if name not in ranks]
    one = df.agg(*sums) if sums else None
    if ranks:
        two = percentiles(df, ranks)
        one = one.crossJoin(two) if one is not None else two  # one row each
    return one.select(*figures)


def register_metric(name: str, unit: str, build) -> None:
    """Add a metric; a name that is taken raises KeyError."""
    if name in METRICS:
        raise KeyError(name)
    METRICS[name] = (unit, build)


def evaluated(df: DataFrame, metrics: tuple[str | tuple[str, dict], ...] = DEFAULT) -> DataFrame:
    """One row with all metrics; no rows give nulls."""
    wanted = [(m, {}) if isinstance(m, str) else m for m in metrics]
    return told(with_error(df), {name: METRICS[name][1](**options) for name, options in wanted})


def within(limits: tuple[float, ...] = LIMITS) -> list[Column]:
    """Percent of errors up to each limit, inclusive."""
    return [share(F.col(ERROR) <= t).alias(f"within_{t}m") for t in limits]


def results(df: DataFrame) -> DataFrame:
    """The summary row: eleven figures with the population deviation."""
    return told(with_error(df), {
        "mean_error": F.avg(ERROR), "median_error": Percentile(50), "std_error": F.stddev_pop(ERROR), "min_error": F.min(ERROR), "max_error": F.max(ERROR),
        "rms_error": F.sqrt(F.avg(F.col(ERROR) * F.col(ERROR))), "p75_error": Percentile(75), "p90_error": Percentile(90), "p95_error": Percentile(95),
        "floor_accuracy": share(same("floor")), "building_accuracy": share(same("building")),
    })


def cdf_curve(errors: DataFrame, points: int = 100) -> DataFrame:
    """``point, value, fraction``: evenly spaced errors up to the greatest, and the share of errors not above each.

    Each error is counted once, at the first point that reaches it; a running sum over the few points does the rest.
    """
    ends = errors.agg(F.max(ERROR).alias("top"), F.count(ERROR).alias("n"))
    grid = ends.select("top", "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn("value", F.col("point") * F.col("top") / (points - 1))
    first = F.when(F.col("top") > 0, F.ceil(F.col(ERROR) * (points - 1) / F.col("top"))).otherwise(0)
    near = errors.where(F.col(ERROR).isNotNull()).join(F.broadcast(ends), how="cross").withColumn("_k", first)
    # rounding may put an error one point off; the comparison that defines the curve settles it
    value = lambda k: k * F.col("top") / (points - 1)
    k = F.col("_k")
    exact = F.when((k > 0) & (F.col(ERROR) <= value(k - 1)), k - 1).when(F.col(ERROR) > value(k), k + 1).otherwise(k)
    counts = near.groupBy(exact.cast("int").alias("point")).agg(F.count("*").alias("c"))
    running = F.sum(F.coalesce("c", F.lit(0))).over(W.orderBy("point"))
    return grid.join(counts, "point", "left").select("point", "value", (running / F.col("n")).alias("fraction"))


def empirical_cdf(errors: DataFrame, order: str) -> DataFrame:
    """Each error's rank over their number; ties keep ranks of their own. Ranks come from a range-partitioned sort."""
    return global_rank(errors, [ERROR, order], "place").crossJoin(F.broadcast(errors.agg(F.count("*").alias("n")))).withColumn("fraction", F.col("place") / F.col("n")).drop("place", "n")


def global_rank(df: DataFrame, by: list, name: str) -> DataFrame:
    """``df`` with ``name``: row numbers from 1 in an order over all rows, without gathering them in one task.

    Rows are dealt by range and numbered within their part; the parts' sizes, one number each, give the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "rank")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", offset.alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*by))
    return dealt.withColumn("_place", place).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def histogram(errors: DataFrame, bins: int = 50) -> DataFrame:
    """``bin, low, high, n`` over the errors' range; the last bin is closed and empty bins stay."""
    ends = errors.agg(F.min(ERROR).alias("lo"), F.max(ERROR).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    at = F.when(width > 0, F.least(F.floor((F.col(ERROR) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = errors.where(F.col(ERROR).isNotNull()).join(F.broadcast(ends), how="cross").groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def summary(row: dict) -> str:
    """A printable summary of a results row."""
    unit = lambda k: "%" if k.endswith("accuracy") else "m"
    return "\n".join(f"{k:<20}{v:>10.2f} {unit(k)}" if v is not None else f"{k:<20}{'-':>10}" for k, v in row.items())
