"""Between wide, long, sparse and dense rows; splits, unions, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written
from .metrics import global_rank


def usable(name: Column) -> Column:
    """Whether an id cell names something."""
    return name.isNotNull() & (F.trim(name) != "") & (F.lower(F.trim(name)) != "nan")


def unpivoted(df: DataFrame, pairs: list[tuple[str, ...]], names: tuple[str, ...] = ("id", "value")) -> DataFrame:
    """Wide groups of columns as rows beside the other columns; rows with an unusable first or a null later cell go."""
    fields = [F.struct(*(F.col(c).cast("string" if k == 0 else "double").alias(n) for k, (c, n) in enumerate(zip(p, names, strict=True)))) for p in pairs]
    rest = [c for c in df.columns if not any(c in p for p in pairs)]
    long = df.select(*rest, F.explode(F.array(*fields)).alias("_p")).select(*rest, "_p.*")
    keep = usable(F.col(names[0]))
    for n in names[1:]:
        keep = keep & F.col(n).isNotNull() & ~F.isnan(n)
    return long.where(keep).withColumn(names[0], F.trim(names[0]))


def gathered(long: DataFrame, key: list[str], key_column: str = "id", value: str = "value") -> DataFrame:
    """One row per key with a map of its readings; of readings with one id the greatest stays."""
    one = long.groupBy(*key, key_column).agg(F.max(value).alias("_v"))
    return one.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key_column, "_v")))).alias("readings"))


def vocabulary(long: DataFrame, name: str = "id", most: int = 100_000) -> DataFrame:
    """One row: the sorted distinct ids. More than ``most`` of them, by a count, are refused: such readings stay sparse."""
    ids = written(long.select(name).distinct(), "vocabulary")
    if (n := ids.count()) > most:
        raise ValueError(f"{n} transmitters are more than the {most} that a dense vector may have")
    return ids.agg(F.array_sort(F.collect_list(name)).alias("vocabulary"))


def grouped_scans(rows: DataFrame, key: list[str], items: list[str], order: str) -> DataFrame:
    """One row per key with its items in row order; null keys go."""
    known = rows.where(" and ".join(f"`{k}` is not null" for k in key))
    listed = F.array_sort(F.collect_list(F.struct(order, *items)))
    return known.groupBy(*key).agg(F.transform(listed, lambda s: F.struct(*(s[i].alias(i) for i in items))).alias("items"))


def looked_up(df: DataFrame, dimension: DataFrame, on: str, most: int = 100_000) -> DataFrame:
    """Left join to a dimension, which is broadcast only if a count shows at most ``most`` rows."""
    small = dimension.limit(most + 1).count() <= most
    return df.join(F.broadcast(dimension) if small else dimension, on, "left")


def first_matches(left: DataFrame, right: DataFrame, on: str, order: str) -> DataFrame:
    """Left join to the first row of each key."""
    columns = [c for c in right.columns if c not in (on, order)]
    one = right.groupBy(on).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(on, "_r.*")
    return left.join(one, on, "left")


def by_position(parts: list[DataFrame], order: str = "src_idx") -> DataFrame:
    """Files joined on their row numbers; rows of the first that others lack get nulls."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, order, "left")
    return out


def row_halves(df: DataFrame, ratio: float, order: str) -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * ratio)`` rows in order, and the rest, from one ranking."""
    ranked = global_rank(df, [order], "_rank")
    cut = int(df.count() * ratio)
    return ranked.where(F.col("_rank") <= cut).drop("_rank"), ranked.where(F.col("_rank") > cut).drop("_rank")


def row_split(df: DataFrame, ratio: float, order: str, *, train: bool) -> DataFrame:
    """One of the halves of ``row_halves``."""
    return row_halves(df, ratio, order)[0 if train else 1]


def group_split(df: DataFrame, ratio: float, group: str, *, train: bool) -> DataFrame:
    """Rows of the first groups in order, or of the rest; groups stay whole."""
    return df.join(row_split(df.select(group).distinct(), ratio, group, train=train), group, "left_semi")


def random_split(df: DataFrame, ratio: float, key: str, *, train: bool, seed: int = 42) -> DataFrame:
    """Rows in an order of their hashes, cut as in ``row_split``."""
    return row_split(df.withColumn("_h", F.struct(F.xxhash64(F.lit(seed), key), key)), ratio, "_h", train=train).drop("_h")


def united(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a part lacks become null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def group_number(df: DataFrame, by: list[str], name: str = "group_id") -> DataFrame:
    """Groups numbered from 0 in order of their keys; null is a key like others and comes first."""
    numbered = global_rank(df.select(*by).distinct(), by, "_g").select(*(F.col(c).alias(f"_{k}_key") for k, c in enumerate(by)), (F.col("_g") - 1).alias(name))
    same = [df[c].eqNullSafe(numbered[f"_{k}_key"]) for k, c in enumerate(by)]
    return df.join(numbered, same).select(*(df[c] for c in df.columns), name)


def as_json(df: DataFrame, name: str = "value") -> DataFrame:
    """One text column: each row as JSON, nulls left out."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(name))


def from_json(df: DataFrame, schema: str, name: str = "value") -> DataFrame:
    """Rows of ``schema`` from a text column of JSON; fields that a text lacks are null, and a text that isn't JSON gives nulls."""
    return df.select(F.from_json(name, schema).alias("_j")).select("_j.*")


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
