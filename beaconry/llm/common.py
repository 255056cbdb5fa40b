"""What the corpus operators share: words, shared folders, hashing and small graph steps."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of characters other than the space and the five control characters from tab to carriage return.
#: ``bytes.split()`` splits UTF-8 at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: bytes | None) -> list[bytes]:
    """The words of UTF-8 text; none for null."""
    return text.split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def valid_text(column: str) -> Column:
    """Text for Python: bytes that aren't UTF-8 become U+FFFD, as a decoder that replaces them gives."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def as_bytes(column: str) -> Column:
    """Text as its bytes, so that Arrow hands it to Python without decoding."""
    return F.col(column).cast("string").cast("binary")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front, so that no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def marked(text_col: str) -> Column:
    """A hash of the text, which with the id tells apart rows that repeat an id or have none."""
    return F.xxhash64(F.col(text_col).cast("string"))


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``doc_id`` and text aren't those of ``rows (doc_id, mark)``; null ids match null ids."""
    name, mark = unused(docs, "_gone"), unused(docs, "_mark")
    gone = rows.toDF(name, mark).distinct()
    text = F.xxhash64(docs["text"].cast("string"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[name]) & (text == gone[mark]), "left_anti")


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach; a temporary one is set only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='beaconry-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive any executor.

    ``drop`` removes one that no later plan reads; the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session has ended before; nothing can be deleted through it
            return


def _held() -> dict:
    """What this Python process keeps for its later tasks."""
    return vars(sys.modules.setdefault("_beaconry_worker", types.ModuleType("_beaconry_worker"))).setdefault("held", {})


def kept_in_worker(key: object, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in a Python worker's process and found again by its later tasks.

    A worker keeps one thing, the last that was asked for, so what one operator remembers makes room for the next one's.
    """
    held = _held()
    if key not in held:
        let_go()
        held[key] = make()
    return held[key]


def let_go() -> None:
    """Frees what a worker keeps, and what Arrow's pool has of freed batches: called by tasks that need none of it."""
    _held().clear()
    pa.default_memory_pool().release_unused()


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bounded number of words."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` words, in order; a text with fewer words is one window, none without words."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def arrow_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterator[tuple]]], *, most: int = 2000) -> DataFrame:
    """``df`` row by row through Python in Arrow batches.

    ``make`` runs once in each task and returns a function that gets a row's values and yields output rows.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                made = [x for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for x in rows_of(*row)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


#: A join broadcasts the keys that hold more than 1 / HOT of all rows each: fewer than HOT keys, whatever the data.
HOT = 4096


def joined_by_key(rows: DataFrame, told: DataFrame, key: str, many: str, total: int) -> DataFrame:
    """``rows`` joined with ``told``, which has one row for each key and in ``many`` how many of at most ``total`` rows hold it.

    Rows of a hot key stay where they are and meet a broadcast row; the others are dealt by key, so none fills a task.
    """
    limit = F.lit(total / HOT)
    hot, cold = F.broadcast(told.where(F.col(many) > limit)), told.where(F.col(many) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))


#: Edges that one task should get, and nodes that it holds before it tells what it has and begins anew.
PER_TASK, HELD = 250_000, 500_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root`` for each node of the edges, roots included: what these edges connect, by merging sets.

    A bounded number of nodes is held at a time; nodes that are told again with another root connect the two.
    """
    above: dict = {}

    def top(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(above), pa.array(map(top, list(above)))], names=["node", "root"])

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (p := top(u)) != (q := top(v)):
                above[max(p, q)] = min(p, q)
        if len(above) > HELD:
            yield told()
            above.clear()
    if above:
        yield told()


def _dealt(edges: DataFrame, n: int, scratch: Scratch, name: str) -> DataFrame:
    """``n`` edges for tasks of about PER_TASK: each edge goes to both its ends, a node with more edges than that to several tasks."""
    tasks = -(-2 * n // PER_TASK)
    if tasks == 1:
        return edges.coalesce(1)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hubs = both.groupBy("u").agg(F.count("*").alias("_n")).where(F.col("_n") > PER_TASK)
    hubs = scratch.write(hubs.select("u", F.expr(f"_n div {PER_TASK} + 1").alias("_salts")), f"{name}-hubs")
    salted = both if hubs.isEmpty() else both.join(hubs, "u", "left")
    salt = F.lit(0) if salted is both else F.coalesce(F.expr("pmod(xxhash64(v), _salts)"), F.lit(0))
    return salted.withColumn("_salt", salt).repartition(tasks, "u", "_salt").select("u", "v")


def components(edges: DataFrame, scratch: Scratch, name: str, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of ``edges``: one row ``(node, root)`` for each node with an edge; the root is the least node.

    1. Each task connects the edges that it has and tells a root for each of its nodes, a star in place of any edges.
    2. A node with roots of several tasks connects these, so the roots are the nodes of the next, smaller graph. A node
       that is no root anywhere is done with: its least root stands for it.
    3. The edges between roots are dealt anew, to both ends, until none is left; then roots are handed back level by level.

    The first step shuffles no edge. A node has a row for each task that tells it, so none is a hot key, and tasks hold a
    bounded number of nodes. Each level is written to the shared folder.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    kind, levels = dict(now.dtypes)["u"], []
    while True:
        told = now.mapInArrow(_stars, f"node {kind}, root {kind}").withColumn("least", F.min("root").over(W.partitionBy("node")))
        levels.append(scratch.write(told, f"{name}-{len(levels)}"))
        between = levels[-1].where("root <> least").select(F.col("root").alias("u"), F.col("least").alias("v")).distinct()
        between = scratch.write(between, f"{name}-between-{len(levels)}")
        if not (n := between.count()):
            break
        now = _dealt(between, n, scratch, f"{name}-{len(levels)}")
    out = levels.pop().select("node", F.col("least").alias("root")).distinct()
    while levels:
        over = out.select(F.col("node").alias("least"), F.col("root").alias("over"))
        out = levels.pop().select("node", "least").distinct().join(over, "least", "left").select("node", F.coalesce("over", "least").alias("root"))
        out = scratch.write(out, f"{name}-told-{len(levels)}")
    return out
