"""Where data lie, and whether files are whole. Nothing here downloads."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def data_home(root: str | None = None, variable: str = "BEACONRY_DATA") -> str:
    """A root as given, else the one that the variable names, else a folder in the user's cache."""
    return root or os.environ.get(variable) or str(Path.home() / ".cache" / "beaconry")


def whole(path: str, md5: str | None = None, part: int = 1 << 20) -> bool:
    """Whether a local file is there and, if told, has this MD5 sum."""
    if not os.path.isfile(path):
        return False
    if md5 is None:
        return True
    found = hashlib.md5(usedforsecurity=False)
    with open(path, "rb") as f:
        while block := f.read(part):
            found.update(block)
    return found.hexdigest() == md5.lower()


def scenarios(spark: SparkSession, root: str, kind: str = "mat") -> list[str]:
    """Names of the files of a kind in a folder or its subfolders, as Spark's readers see them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", True).load(root).select("path")
    return [r["s"] for r in files.select(F.regexp_extract("path", rf"([^/]+)\.{kind}$", 1).alias("s")).distinct().orderBy("s").collect()]


def distinct_values(df: DataFrame, column: str) -> list:
    """A dataset's buildings, floors, areas or scenarios, sorted; a few values, which go to the driver."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
