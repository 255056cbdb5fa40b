"""Samples by number: rows kept in order, so that a lookup reads one file."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import global_rank
from ..shared import written

#: Rows of a file, and rows of a group inside it, whose least and greatest number Parquet keeps.
FILE_ROWS, GROUP_BYTES = 100_000, 1 << 20


class RowStore:
    """A table whose rows are numbered from 0 and sorted into files of one size each.

    ``store[5]`` and ``store[-1]`` are rows, ``store[10:20]`` is a table, iteration goes in order, and ``len`` is known
    without a scan. Numbers tell the file, and Parquet's statistics tell the part of it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        told = spark.read.schema("n long, size long, columns string").json(f"{path}/told").first()
        self.spark, self.path, self.n, self.size, self.columns = spark, path, told["n"], told["size"], told["columns"]

    @classmethod
    def write(cls, df: DataFrame, path: str, *, order: list[str], size: int = FILE_ROWS) -> RowStore:
        """Keep ``df`` at ``path``, numbered by ``order`` (ties as they come); a column ``row`` of its own is refused."""
        if "row" in {c.lower() for c in df.columns} or size < 1:
            raise ValueError("there is a column row already, or files would have no rows")
        numbered = written(global_rank(df, order, "row").withColumn("row", (F.col("row") - 1).cast("long")), "numbered")
        n = numbered.count()
        placed = numbered.withColumn("_file", F.expr(f"row div {size}"))
        dealt = placed.repartitionByRange(max(1, min(-(-n // size), 10_000)), "_file").sortWithinPartitions("_file", "row")
        dealt.write.mode("overwrite").partitionBy("_file").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/rows")
        told = [(n, size, df.schema.simpleString()[len("struct<") : -1])]
        df.sparkSession.createDataFrame(told, "n long, size long, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/told")
        return cls(df.sparkSession, path)

    def _read(self, files: Iterable[int]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/rows/_file={k}" for k in files)).drop("_file")

    def __len__(self) -> int:
        return self.n

    def rows(self, numbers: Iterable[int]) -> DataFrame:
        """The rows of these numbers, each once, from the files that have them; a number outside is an IndexError."""
        wanted = sorted({k + self.n if k < 0 else k for k in numbers})
        if wanted and not 0 <= wanted[0] <= wanted[-1] < self.n:
            raise IndexError(f"rows are numbered from 0 to {self.n - 1}")
        files = sorted({k // self.size for k in wanted}) or ([0] if self.n else [])
        return self._read(files).where(F.col("row").isin(wanted)) if files else self.spark.createDataFrame([], f"struct<{self.columns},row:bigint>")

    def __getitem__(self, at: int | slice) -> Row | DataFrame:
        if isinstance(at, int):
            return self.rows([at]).first()
        first, last, step = at.indices(self.n)
        if step < 1:
            raise ValueError("a table has no falling order")
        if first >= last:
            return self.rows([])
        found = self._read(range(first // self.size, (last - 1) // self.size + 1)).where((F.col("row") >= first) & (F.col("row") < last))
        return found.where((F.col("row") - first) % step == 0) if step > 1 else found

    def __iter__(self) -> Iterator[Row]:
        """All rows in order, a file at a time."""
        for k in range(-(-self.n // self.size)):
            yield from self._read([k]).sort("row").toLocalIterator()
