"""Readers by file layout. Each returns rows with ``src_idx``, which keeps the order of the file's rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signals import to_dense
from ..operators.metrics import global_rank
from ..operators.shaping import united, usable, vocabulary

#: What row numbers of one file stay below, with as many as 2 ** 17 splits.
FILE = 1 << 50


def numbered(df: DataFrame) -> DataFrame:
    """Row numbers that rise with the place in a file; splits of one file are read in order."""
    return df.withColumn("src_idx", F.monotonically_increasing_id())


def in_order(read: Callable[[str], DataFrame], paths: str | list[str]) -> DataFrame:
    """The rows of all files, numbered file by file in the order of ``paths``; columns that a file lacks are null."""
    paths = [paths] if isinstance(paths, str) else paths
    return united(*(numbered(read(p)).withColumn("src_idx", F.col("src_idx") + F.lit(k * FILE)) for k, p in enumerate(paths)))


def counted(df: DataFrame) -> DataFrame:
    """``df`` with its row numbers counted from 1 without gaps, so that rows of files of one length meet."""
    return global_rank(df, ["src_idx"], "_row").withColumn("src_idx", F.col("_row")).drop("_row")


def header_csv(spark: SparkSession, paths: str | list[str], separator: str = ",") -> DataFrame:
    """CSV files with a header; every cell is text until a layout casts it."""
    return in_order(spark.read.option("header", True).option("sep", separator).csv, paths)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def csv_columns(spark: SparkSession, path: str, separator: str = ",", skip: int = 0) -> DataFrame:
    """A CSV file whose header follows ``skip`` lines, with columns of numbers where all cells are numbers."""
    if not skip:
        return spark.read.option("header", True).option("inferSchema", True).option("sep", separator).csv(path)
    lines = numbered(spark.read.text(path))
    first = lines.orderBy("src_idx").limit(skip + 1).collect()
    names = [n.strip() for n in first[-1]["value"].split(separator)]
    cells = F.split("value", re.escape(separator), -1)
    rows = lines.where(F.col("src_idx") > first[-1]["src_idx"]).where("trim(value) <> ''")
    return rows.select(*(F.trim(F.get(cells, F.lit(k))).try_cast("double").alias(n) for k, n in enumerate(names)))


def number(df: DataFrame, *names: str, default: float | None = 0.0) -> Column:
    """The first of ``names`` that is a column, as a number; ``default`` if none is. A null cell stays null."""
    found = next((n for n in names if n in df.columns), None)
    return F.col(f"`{found}`").try_cast("double") if found else F.lit(default).cast("double")


def text(df: DataFrame, *names: str) -> Column:
    found = next((n for n in names if n in df.columns), None)
    return F.col(f"`{found}`").cast("string") if found else F.lit(None).cast("string")


def floor_of(value: Column) -> Column:
    """Whole numbers towards 0."""
    return value.try_cast("double").cast("int")


def vector(columns: list[str], fill: float | None) -> Column:
    """Columns as one vector; missing cells become ``fill``, or stay null."""
    cells = [F.col(f"`{c}`").try_cast("double") for c in columns]
    return F.array(*(F.coalesce(F.when(F.isnan(c), None).otherwise(c), F.lit(float(fill))) if fill is not None else c for c in cells)) if cells else F.expr("cast(array() as array<double>)")


def wide(df: DataFrame, pick: Callable[[list[str]], list[str]], *, fill: float | None, width: int | None = None) -> DataFrame:
    """``df`` with ``features`` from the columns that ``pick`` names; without any, ``width`` zeros."""
    columns = pick([c for c in df.columns if c != "src_idx"])
    empty = F.array_repeat(F.lit(0.0), width or 0)
    return df.withColumn("features", vector(columns, fill) if columns else empty)


def positional_csv(spark: SparkSession, path: str, features: int, names: list[str]) -> DataFrame:
    """Lines with at least ``features + len(names)`` cells; longer ones keep their first cells, shorter ones and the header go."""
    cells = F.split("value", ",", -1)
    lines = numbered(spark.read.text(path)).where(F.size(cells) >= features + len(names))
    rows = lines.where(F.get(cells, F.lit(0)).try_cast("double").isNotNull())
    values = F.transform(F.slice(cells, 1, features), lambda v: v.try_cast("double"))
    return rows.select("src_idx", values.alias("features"), *(F.get(cells, F.lit(features + k)).try_cast("double").alias(n) for k, n in enumerate(names)))


def text_matrix(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of numbers between white space, of which the last three are x, y and floor; unreadable cells drop a line."""
    cells = F.transform(F.split(F.trim("value"), r"\s+"), lambda v: v.try_cast("double"))
    rows = in_order(lambda p: spark.read.text(p).withColumn("file", F.input_file_name()), paths).withColumn("c", cells).where(~F.exists("c", lambda v: v.isNull()) & (F.size("c") > 3))
    n = F.size("c")
    return rows.select("src_idx", F.slice("c", F.lit(1), n - 3).alias("features"), F.get("c", n - 3).alias("x"), F.get("c", n - 2).alias("y"), F.get("c", n - 1).cast("int").alias("floor"), "file")


def text_records(spark: SparkSession, path: str, least: int) -> DataFrame:
    """Lines of at least ``least`` fields between white space, as ``c array<string>``."""
    return numbered(spark.read.text(path)).withColumn("c", F.split(F.trim("value"), r"\s+")).where(F.size("c") >= least).drop("value")


def paired(columns: list[str], first: str, *others: str) -> list[tuple[str, ...]]:
    """Column groups by their shared number: patterns with one group each."""
    by = [{m[1]: c for c in columns if (m := re.fullmatch(p, c, re.IGNORECASE))} for p in (first, *others)]
    keys = sorted(set.intersection(*(set(b) for b in by)), key=lambda k: (len(k), k)) if by else []
    return [tuple(b[k] for b in by) for k in keys]


def readings(df: DataFrame, pairs: list[tuple[str, ...]]) -> DataFrame:
    """Rows with a map ``readings`` of their usable pairs; rows without any go, of repeated ids the last pair stays."""
    cells = (F.struct(F.lit(k).alias("k"), F.trim(F.col(f"`{i}`").cast("string")).alias("id"), F.col(f"`{v}`").try_cast("double").alias("v")) for k, (i, v, *_) in enumerate(pairs))
    good = F.filter(F.array(*cells), lambda e: usable(e["id"]) & e["v"].isNotNull() & ~F.isnan(e["v"]))
    last = F.filter(good, lambda e: ~F.exists(good, lambda o: (o["id"] == e["id"]) & (o["k"] > e["k"])))
    told = df.withColumn("_r", last).where(F.size("_r") > 0)
    return told.withColumn("readings", F.map_from_entries(F.transform("_r", lambda e: F.struct(e["id"], e["v"])))).drop("_r")


def densified(df: DataFrame, fill: float) -> DataFrame:
    """``df`` with ``features`` over the sorted ids of all rows: the transmitters of a site, whose number is checked."""
    known = vocabulary(df.select(F.explode(F.map_keys("readings")).alias("id"))).withColumnRenamed("vocabulary", "_known")
    return df.crossJoin(F.broadcast(known)).withColumn("features", to_dense(F.col("readings"), F.col("_known"), fill)).drop("_known")  # one row


def arrays_from_files(spark: SparkSession, path: str, opened: Callable[[bytes], dict]) -> DataFrame:
    """``file, name, shape, re, im`` for each array that ``opened`` finds in each binary file under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts):
        import numpy as np
        import pandas as pd

        for part in parts:
            for file, content in zip(part["path"], part["content"], strict=True):
                rows = []
                for name, a in opened(bytes(content)).items():
                    a = np.asarray(a)
                    flat = a.astype(complex).ravel()
                    rows.append((file, name, list(a.shape), flat.real.tolist(), flat.imag.tolist()))
                yield pd.DataFrame(rows, columns=["file", "name", "shape", "re", "im"])

    return files.mapInPandas(run, ARRAYS)


ARRAYS = "file string, name string, shape array<int>, re array<double>, im array<double>"


def saved_arrays(arrays: DataFrame, path: str) -> None:
    """Named arrays, as ``arrays_from_files`` gives them, as Parquet with gzip: a row for each, groups as names with a slash."""
    arrays.write.mode("overwrite").option("compression", "gzip").parquet(path)


def stored_arrays(spark: SparkSession, path: str) -> DataFrame:
    """What ``saved_arrays`` wrote."""
    return spark.read.schema(ARRAYS).parquet(path)


def hdf5_arrays(keys: tuple[str, ...] | None = None) -> Callable[[bytes], dict]:
    """For ``arrays_from_files``: datasets of an HDF5 file by path, groups included; needs h5py on the executors."""

    def opened(content: bytes) -> dict:
        import io

        import h5py

        found = {}
        with h5py.File(io.BytesIO(content), "r") as f:
            f.visititems(lambda name, item: found.update({name: item[()]}) if isinstance(item, h5py.Dataset) else None)
        return {k: v for k, v in found.items() if keys is None or k in keys}

    return opened


def npy_arrays() -> Callable[[bytes], dict]:
    """For ``arrays_from_files``: the arrays of an ``.npz`` file, or the one of an ``.npy`` file."""

    def opened(content: bytes) -> dict:
        import io

        import numpy as np

        found = np.load(io.BytesIO(content), allow_pickle=False)
        return dict(found) if hasattr(found, "files") else {"array": found}

    return opened


def available() -> dict[str, bool]:
    """Which optional readers can run here."""
    from importlib.util import find_spec

    return {name: find_spec(name) is not None for name in ("h5py", "yaml")}
