"""Text fingerprints as a data source of Spark: ``spark.read.format("fingerprint_lines")``, tables and streams alike.

Lines hold numbers between white space: a fingerprint, then x, y and floor (``layout`` ``matrix``), or the place first
(``places_first``). Files are planned in ranges of bytes, so a large one is read by many tasks; comparisons of x, y and floor
are pushed down and decided before a line's fingerprint is parsed. A stream reads files as they appear, in order of name.

Paths are opened by PyArrow's file systems (``file``, ``hdfs``, ``s3`` and others by URI), on the driver and the executors.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .layouts import FILE

NAME = "fingerprint_lines"
SCHEMA = "src_idx long, features array<double>, x double, y double, floor int"
#: Bytes of a task's range and of a buffer, lines of an Arrow batch, and what must be on for filters to be pushed.
SPLIT, BUFFER, LINES, PUSHDOWN = 64 << 20, 1 << 20, 10_000, "spark.sql.python.filterPushdown.enabled"
TESTS = {
    EqualTo: lambda v, w: v == w, EqualNullSafe: lambda v, w: v == w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w,
    LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w, In: lambda v, w: v in w,
}
LABELS = ("x", "y", "floor")


@dataclass
class Range(InputPartition):
    """Bytes ``start`` up to ``end`` of a file; the lines that begin there belong to it."""

    path: str
    number: int
    start: int
    end: int


def files(path: str) -> list[tuple[str, int]]:
    """Path and bytes of the files that a file, a folder or a pattern in a folder names, by name; hidden ones don't count."""
    where, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri(posixpath.abspath(path))
    folder, pattern = posixpath.split(at.rstrip("/"))
    if any(c in pattern for c in "*?["):
        found = [i for i in where.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatchcase(i.base_name, pattern)]
    else:
        info = where.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(at))
    kept = [i for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    return sorted((f"{scheme}{i.path}", i.size) for i in kept)


def planned(found: list[tuple[str, int]], split: int, first: int = 0) -> list[Range]:
    return [Range(p, first + k, at, min(at + split, size)) for k, (p, size) in enumerate(found) for at in range(0, size, split)]


def lines_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each line that begins in a range."""
    where, at = fs.FileSystem.from_uri(part.path)
    with io.BufferedReader(where.open_input_file(at), BUFFER) as f:
        f.seek(max(0, part.start - 1))
        place = part.start
        if part.start:  # the line that the byte before belongs to is the range before's
            place += len(f.readline()) - 1
        while place < part.end and (line := f.readline()):
            yield place, line
            place += len(line)


def parsed(part: Range, wanted: list[tuple[str, type, object]], places_first: bool) -> Iterator[pa.RecordBatch]:
    """Batches of SCHEMA; lines that aren't numbers, or too few, are left out, and those that a filter excludes aren't parsed whole."""
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["src_idx", "features", *LABELS])

    for place, line in lines_of(part):
        cells = line.split()
        if len(cells) < 4:
            continue
        ends, rest = (cells[:3], cells[3:]) if places_first else (cells[-3:], cells[:-3])
        try:
            told = dict(zip(LABELS, (float(ends[0]), float(ends[1]), int(float(ends[2]))), strict=True))
            if not all(TESTS[kind](told[name], value) for name, kind, value in wanted):
                continue
            rows.append((part.number * FILE + place, [float(c) for c in rest], *told.values()))
        except (ValueError, OverflowError):
            continue
        if len(rows) >= LINES:
            yield batch()
            rows = []
    if rows:
        yield batch()


class _Lines:
    def __init__(self, options: dict) -> None:
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.places_first, self.wanted = options.get("layout", "matrix") == "places_first", []

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return parsed(partition, self.wanted, self.places_first)


class LinesReader(_Lines, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the engine's name
        """Take comparisons of a label with a value; labels are never null here. The others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, IsNotNull) and name in LABELS:
                continue
            if type(f) in TESTS and name in LABELS and f.value is not None:
                self.wanted.append((name, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        return planned(files(self.path), self.split) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.path else iter(())


class LinesStream(_Lines, DataSourceStreamReader):
    """Offsets count files in order of name, so a new file's name must come after those that were read."""

    def initialOffset(self) -> dict:  # noqa: N802  the engine's name
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802  the engine's name
        return {"files": len(files(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return planned(files(self.path)[start["files"] : end["files"]], self.split, start["files"])


class FingerprintLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(self.options)

    def streamReader(self, schema: StructType) -> LinesStream:  # noqa: N802  the engine's name
        return LinesStream(self.options)


def register(spark: SparkSession) -> str:
    """Make the format known to a session, with filters pushed down; its name."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(FingerprintLines)
    return NAME
