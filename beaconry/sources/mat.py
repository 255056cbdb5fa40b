"""MAT files of level 5, by their public format: numeric arrays in slices, without a library.

A file is a header and a line of elements, each a tag (type, bytes) and data, or a compressed stream of one. A matrix element
holds flags, dimensions, a name and values in column order, the imaginary ones behind the real; a struct holds a matrix for
each field of each entry. Elements are read from a stream, compressed ones as they are inflated, and values are told in
slices of CHUNK, so beside the file no array is held whole.
"""

from __future__ import annotations

import io
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of a slice, and bytes that are inflated at a time.
CHUNK, INFLATED = 65_536, 1 << 16
#: NumPy kinds of the format's data types and of its numeric array classes; numbers of other types and classes.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, OBJECT, CHARS, SPARSE = 1, 2, 3, 4, 5
NUMERIC = range(6, 16)
#: Columns of ``mat_slices``.
SLICES = "file string, name string, index long, field string, shape array<int>, part string, at long, data array<double>"


class _Stream:
    """Bytes in order, with the place."""

    def __init__(self, source: io.BufferedIOBase, left: int | None = None) -> None:
        self.source, self.left = source, left

    def read(self, n: int) -> bytes:
        if self.left is not None:
            n = min(n, self.left)
        out = self.source.read(n)
        if self.left is not None:
            self.left -= len(out)
        return out

    def exactly(self, n: int) -> bytes:
        out = self.read(n)
        if len(out) != n:
            raise ValueError("the file ends inside an element")
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            n -= len(self.exactly(min(n, INFLATED)))


class _Inflated(io.RawIOBase):
    """What a compressed element inflates to, a bounded number of bytes at a time."""

    def __init__(self, source: _Stream, n: int) -> None:
        self.source, self.left, self.engine, self.rest = source, n, zlib.decompressobj(), b""

    def read(self, n: int = -1) -> bytes:
        out = b""
        while len(out) < n:
            if not self.rest and self.left:
                self.rest = self.source.exactly(min(INFLATED, self.left))
                self.left -= len(self.rest)
            made = self.engine.decompress(self.rest, n - len(out))
            self.rest = self.engine.unconsumed_tail
            out += made
            if not made and not self.rest and not self.left:
                break
        return out

    def drained(self) -> None:
        """Pass over what wasn't inflated."""
        self.source.skip(self.left)
        self.left = 0


def _tag(stream: _Stream, order: str) -> tuple[int, int, bytes | None] | None:
    """Type and bytes of the next element, and its data if the tag holds it; None at the end."""
    head = stream.read(8)
    if not head:
        return None
    if len(head) < 8:
        raise ValueError("the file ends inside a tag")
    kind, n = struct.unpack(f"{order}II", head)
    if kind >> 16:  # a small element: the bytes stand in the tag's upper half, the data in place of its length
        return kind & 0xFFFF, kind >> 16, head[4 : 4 + (kind >> 16)]
    return kind, n, None


def _whole(stream: _Stream, order: str) -> tuple[int, bytes]:
    """Type and data of a short element, with the padding behind it passed over."""
    told = _tag(stream, order)
    if told is None:
        raise ValueError("an element is missing")
    kind, n, data = told
    if data is None:
        data = stream.exactly(n)
        stream.skip(-n % 8)
    return kind, data


def _values(stream: _Stream, order: str, shape: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The values of a numeric element, as place and slice."""
    told = _tag(stream, order)
    if told is None:
        raise ValueError("values are missing")
    kind, n, data = told
    if kind not in TYPES:
        raise ValueError(f"values of type {kind} aren't numbers")
    dtype = np.dtype(order + TYPES[kind])
    many = n // dtype.itemsize
    if many != math.prod(shape):
        raise ValueError("an array has another size than its dimensions")
    if data is not None:
        yield 0, np.frombuffer(data, dtype, many).astype(float)
        return
    for at in range(0, many, CHUNK):
        k = min(CHUNK, many - at)
        yield at, np.frombuffer(stream.exactly(k * dtype.itemsize), dtype).astype(float)
    stream.skip(-n % 8)


def _matrix(stream: _Stream, order: str, name: str | None = None, index: int = 0, field: str = "") -> Iterator[tuple]:
    """``name, index, field, shape, part, at, values`` of the slices in a matrix element whose tag has been read."""
    flags = np.frombuffer(_whole(stream, order)[1], f"{order}u4")[0]
    kind, is_complex = int(flags) & 0xFF, bool(int(flags) >> 11 & 1)
    shape = np.frombuffer(_whole(stream, order)[1], f"{order}i4").tolist()
    own = _whole(stream, order)[1].decode("latin-1")
    name = own if name is None else name
    if kind in NUMERIC:
        for part in ("re", "im") if is_complex else ("re",):
            for at, values in _values(stream, order, shape):
                yield name, index, field, shape, part, at, values
    elif kind in (STRUCT, OBJECT):
        if kind == OBJECT:
            _whole(stream, order)
        width = int(np.frombuffer(_whole(stream, order)[1], f"{order}i4")[0])
        text = _whole(stream, order)[1]
        fields = [text[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(text), width)]
        for entry in range(math.prod(shape)):
            for f in fields:
                yield from _element(stream, order, name, entry if not field else index, f"{field}.{f}" if field else f)
    elif kind == CELL:
        for entry in range(math.prod(shape)):
            yield from _element(stream, order, name, entry if not field else index, field)
    # texts and sparse arrays have no slices; the caller passes over what is left of them


def _element(stream: _Stream, order: str, name: str | None = None, index: int = 0, field: str = "") -> Iterator[tuple]:
    """The slices of the next element; nothing for one that has none."""
    told = _tag(stream, order)
    if told is None:
        return
    kind, n, data = told
    if data is not None:
        return
    if kind == COMPRESSED:
        inner = _Inflated(stream, n)
        yield from _element(_Stream(inner), order, name, index, field)
        inner.drained()
        return
    if kind == MATRIX and n:
        inside = _Stream(stream, n)
        yield from _matrix(inside, order, name, index, field)
        inside.skip(inside.left)
    else:
        stream.skip(n)
    stream.skip(-n % 8)


def slices(source: io.BufferedIOBase) -> Iterator[tuple]:
    """``name, index, field, shape, part, at, values`` of all numeric arrays of a file, in its order.

    ``index`` and ``field`` tell the entry of a struct or cell array, ``part`` is ``re`` or ``im``, ``at`` is the place of the
    first value in column order. Texts, sparse arrays and what isn't numeric is passed over.
    """
    head = source.read(128)
    if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of level 5")
    order, stream = ("<", _Stream(source)) if head[126:128] == b"IM" else (">", _Stream(source))
    while True:
        at = stream.read(1)
        if not at:
            return
        yield from _element(_Stream(_Behind(at, source)), order)


class _Behind(io.RawIOBase):
    """A byte that was read to see whether the file goes on, and what follows it."""

    def __init__(self, first: bytes, source: io.BufferedIOBase) -> None:
        self.first, self.source = first, source

    def read(self, n: int = -1) -> bytes:
        out, self.first = self.first[:n], self.first[n:]
        return out + self.source.read(n - len(out)) if len(out) < n else out


def mat_slices(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The slices of all numeric arrays of files, one task a file: columns as in SLICES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, index, field, shape, part, at, values in slices(pa.BufferReader(content.as_buffer())):
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.list_(pa.float64()))
                    row = (path, name, index, field, shape, part, at, values)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["file", "name", "index", "field", "shape", "part", "at", "data"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, SLICES)


def squeezed(shape: Column) -> Column:
    """Dimensions without those of one element; a vector is one row."""
    left = F.filter(shape, lambda n: n != 1)
    whole = F.aggregate(shape, F.lit(1), lambda a, n: a * n)
    return F.when(F.size(left) > 1, left).otherwise(F.array(F.lit(1), whole))


def by_first(found: DataFrame) -> DataFrame:
    """``file, name, index, field, i, re, im``: rows of arrays along their first dimension, from ``mat_slices``.

    A row's values come in row order of the other dimensions; ``im`` is null for real arrays. Each value is dealt to its row,
    whatever slice it came in, so no array is gathered whole.
    """
    first, rest = F.element_at("shape", 1), F.slice("shape", F.lit(2), F.size("shape") - 1)
    long = found.select("file", "name", "index", "field", "shape", "part", "at", F.posexplode("data").alias("k", "v")).withColumn("p", F.col("at") + F.col("k"))
    # in column order the first dimension moves fastest, in row order the last
    start = F.struct(F.expr("p div element_at(shape, 1)").cast("long").alias("left"), F.lit(0).cast("long").alias("place"))
    walked = F.aggregate(rest, start, lambda s, n: F.struct(F.floor(s["left"] / n).cast("long").alias("left"), (s["place"] * n + s["left"] % n).cast("long").alias("place")))
    placed = long.withColumn("i", F.pmod("p", first)).withColumn("place", walked["place"])
    listed = lambda part: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("place", "v")))), lambda e: e["v"])
    told = placed.groupBy("file", "name", "index", "field", "i").agg(listed("re").alias("re"), listed("im").alias("im"))
    return told.withColumn("im", F.when(F.size("im") > 0, F.col("im")))
