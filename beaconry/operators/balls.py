"""An exact index for nearest neighbours in a metric space: balls around pivots, cut into shells.

Each reference belongs to its nearest pivot, and a ball's members are packed by their distance from it. By the triangle
inequality a query at distance ``D`` from a pivot is at least ``D - high`` and ``low - D`` from all members of a shell whose
distances lie between ``low`` and ``high``. A query first meets the shells that its neighbours most likely are in; the k-th
distance found there bounds the others, and it meets only those shells that may hold something nearer. So the result is
that of meeting all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written
from .knn import BLOCK_BYTES, JOINED, METRICS, QUERIES, _compared, _measured, distances, matrix, ranked, usable

#: Pivots at most, rows of a shell at least, shells at most (they are known to every task), quantiles of a ball's distances.
PIVOTS, BALL, SHELLS, QUANTILES = 256, 512, 200_000, 64
#: Groups of shells about, which bounded queries meet at once.
GROUPS = 32
#: Vectors, and bytes of them, among which pivots are chosen.
SAMPLE, SAMPLE_BYTES = 20 * PIVOTS, 64 << 20
#: What rounding may add to a bound, relative and absolute.
SLACK = 1e-9


def far_apart(vectors: np.ndarray, n: int, metric: str, p: float) -> np.ndarray:
    """``n`` of the vectors, each the farthest from those before it; fewer if the rest are copies of these."""
    chosen, away = [0], distances(vectors[0], vectors, metric, p)
    while len(chosen) < min(n, len(vectors)):
        k = int(away.argmax())
        if away[k] <= 0:
            break
        chosen.append(k)
        away = np.minimum(away, distances(vectors[k], vectors, metric, p))
    return vectors[chosen]


def to_all(vectors: np.ndarray, pivots: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of each vector, a row, from each pivot."""
    return np.stack([distances(x, vectors, metric, p) for x in pivots], axis=1) if len(vectors) else np.empty((0, len(pivots)))


@dataclass
class Shells:
    """What a task knows of the shells: pivot, least and greatest distance from it, rows."""

    pivots: np.ndarray
    block: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def groups(self) -> np.ndarray:
        """The first shell of each group of successive shells; a group has a GROUPS-th of the rows, up to JOINED, and a shell at least."""
        size = max(1, min(JOINED, int(self.rows.sum()) // GROUPS))
        number = (np.cumsum(self.rows) - self.rows) // size
        return np.flatnonzero(np.diff(number, prepend=-1) > 0)

    def bounds(self, away: np.ndarray) -> np.ndarray:
        """The least distance that members of each shell may have from a query at distances ``away`` from the pivots."""
        d = away[self.pivot]
        return np.maximum(0, np.maximum(d - self.high, self.low - d) - SLACK * (1 + d))

    def likely(self, away: np.ndarray, k: int) -> np.ndarray:
        """The shells of least bound, the nearer pivot first, that together have k rows."""
        order = np.lexsort((self.block, away[self.pivot], self.bounds(away)))
        return order[: int(np.searchsorted(np.cumsum(self.rows[order]), k)) + 1]


class BallIndex:
    """Shells of a fingerprint table, as ``blocks (block, pivot, low, high, n, r_ids, r_vectors)``, and their pivots."""

    def __init__(self, blocks: DataFrame, pivots: np.ndarray, metric: str, p: float) -> None:
        self.blocks, self.metric, self.p = blocks, metric, p
        told = blocks.select("block", "pivot", "low", "high", "n").orderBy("block").toPandas()  # SHELLS and few more rows
        self.shells = Shells(pivots, *(told[c].to_numpy() for c in ("block", "pivot", "low", "high", "n")))

    @classmethod
    def built(cls, references: DataFrame, *, metric: str = "euclidean", p: float = 2.0, rows: int = BALL, reference_id: str = "sample_id", vector: str = "features") -> BallIndex:
        """The index of all rows that can be compared; pivots come from a sample of at most SAMPLE vectors, by a hash.

        ``metric`` must have a triangle inequality: not cosine, nor Minkowski's with p below 1.
        """
        if metric not in METRICS or metric == "cosine" or (metric == "minkowski" and p < 1):
            raise ValueError(f"{metric} has no triangle inequality")
        known = usable(references, reference_id, vector)
        n, width = _measured(known)
        size = max(rows, BALL, -(-n // SHELLS))
        size = max(1, min(size, BLOCK_BYTES // max(1, 8 * width)))
        most = max(1, min(SAMPLE, SAMPLE_BYTES // max(1, 8 * width)))
        sample = known.orderBy(F.xxhash64("id", "v"), "id").limit(most).select("v").collect()
        vectors = np.array([r["v"] for r in sample], float).reshape(len(sample), width)
        pivots = far_apart(vectors, min(PIVOTS, max(1, n // size)), metric, p) if len(vectors) else vectors

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away = to_all(matrix(batch.column(1)), pivots, metric, p)
                at = away.argmin(axis=1) if len(away) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(away[np.arange(len(at)), at])], names=["id", "v", "pivot", "away"])

        near = written(known.mapInArrow(nearest, "id long, v array<double>, pivot int, away double"), "balls")
        steps = [q / QUANTILES for q in range(1, QUANTILES)]
        balls = near.groupBy("pivot").agg(F.count("*").alias("m"), F.percentile_approx("away", steps, 1000).alias("cuts"))
        # of a ball's quantiles as many as its rows need; what one of them holds too much is dealt by a hash
        every = F.greatest(F.lit(1), F.floor(F.lit(QUANTILES) / F.ceil(F.col("m") / size))).cast("int")
        balls = balls.select("pivot", F.filter("cuts", lambda _, k: (k + 1) % every == 0).alias("cuts"), F.greatest(F.lit(1), F.ceil(F.col("m") / (QUANTILES * size))).alias("parts"))
        dealt = near.join(F.broadcast(balls), "pivot")  # a row for each pivot
        shell = F.struct("pivot", F.size(F.filter("cuts", lambda c: c < F.col("away"))).alias("shell"), F.pmod(F.xxhash64("id", "v"), F.col("parts")).alias("part"))
        packs = dealt.groupBy(shell.alias("s")).agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n"), F.collect_list(F.struct("id", "v")).alias("m"))
        number = F.expr("(s.pivot * 64L + s.shell) * 1048576L + s.part").alias("block")
        blocks = packs.select(number, F.col("s.pivot").alias("pivot"), "low", "high", "n", F.col("m.id").alias("r_ids"), F.col("m.v").alias("r_vectors"))
        return cls(written(blocks, "shells"), pivots, metric, p)

    def _homes(self, queries: DataFrame) -> DataFrame:
        """``id, v, home``: queries with their nearest pivot."""
        shells, metric, p = self.shells, self.metric, self.p

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away = to_all(matrix(batch.column(1)), shells.pivots, metric, p)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away.argmin(axis=1) if len(away) else [], pa.int32())], names=["id", "v", "home"])

        return queries.mapInArrow(run, "id long, v array<double>, home int")

    def _visits(self, asked: DataFrame, k: int) -> DataFrame:
        """``block, q_ids, q_vectors``: which queries of ``asked (ids, vectors, bounds)`` meet the shells that likely hold k neighbours."""
        shells, metric, p = self.shells, self.metric, self.p

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    ids, vectors = np.asarray(batch.column(0)[row].values), matrix(batch.column(1)[row].values)
                    told: dict[int, list[int]] = {}
                    for at, away in enumerate(to_all(vectors, shells.pivots, metric, p)):
                        for b in shells.likely(away, k).tolist():
                            told.setdefault(b, []).append(at)
                    for b, at in told.items():  # a batch each, so that a pack's vectors aren't held once for each shell
                        width = vectors.shape[1]
                        each = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(vectors[at].ravel()))
                        q_vectors = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), each)
                        yield pa.RecordBatch.from_arrays([pa.array([shells.block[b]], pa.int64()), pa.array([ids[at]], pa.list_(pa.int64())), q_vectors], names=["block", "q_ids", "q_vectors"])

        return asked.select("ids", "vectors").mapInArrow(run, "block long, q_ids array<long>, q_vectors array<array<double>>")

    def _chosen(self, asked: DataFrame) -> DataFrame:
        """``q_ids, q_vectors, q_bounds, q_blocks``: packs, and for each query the groups with shells that may hold something within its bound."""
        shells, metric, p, starts = self.shells, self.metric, self.p, self.shells.groups()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    vectors, limits = matrix(batch.column(1)[row].values), np.asarray(batch.column(2)[row].values)
                    met = []
                    for limit, away in zip(limits, to_all(vectors, shells.pivots, metric, p), strict=True):
                        may = shells.bounds(away) <= limit * (1 + SLACK) + SLACK
                        met.append(shells.block[starts[np.logical_or.reduceat(may, starts)]])
                    yield pa.RecordBatch.from_arrays([*batch.slice(row, 1).columns, pa.array([met], pa.list_(pa.list_(pa.int64())))], names=["q_ids", "q_vectors", "q_bounds", "q_blocks"])

        told = "q_ids array<long>, q_vectors array<array<double>>, q_bounds array<double>, q_blocks array<array<long>>"
        return asked.select("ids", "vectors", "bounds").mapInArrow(run, told)

    def _packed(self, queries: DataFrame) -> DataFrame:
        """``ids, vectors, bounds`` of blocks of ``queries (id, v, home, bound)`` near the same pivot, QUERIES each at most."""
        often = queries.groupBy("home").agg(F.count("*").alias("m"))
        dealt = queries.join(F.broadcast(often), "home")  # a row for each pivot
        part = F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("m") / (QUERIES // 2)))
        packs = dealt.groupBy("home", part.alias("_part")).agg(F.collect_list(F.struct("id", "v", "bound")).alias("m"))
        return packs.select(F.col("m.id").alias("ids"), F.col("m.v").alias("vectors"), F.col("m.bound").alias("bounds"))

    def _pairs(self, queries: DataFrame, k: int, query_id: str, vector: str) -> tuple[DataFrame, list[DataFrame]]:
        asked = usable(queries, query_id, vector)
        n, width = _measured(asked)
        if n and len(self.shells.pivots) and width != self.shells.pivots.shape[1]:
            raise ValueError(f"queries of {width} elements can't be compared with references of {self.shells.pivots.shape[1]}")
        homes = written(self._homes(asked), "homes")
        visits = written(self._visits(self._packed(homes.withColumn("bound", F.lit(0.0))), k), "visits")
        found = written(_compared(visits.join(self.blocks, "block"), k, 0.0, self.metric, self.p), "found")
        reach = ranked(found, k).groupBy("query_id").agg(F.max("distance").alias("reach"), F.count("*").alias("m"))
        bound = F.when(F.col("m") < k, float("inf")).otherwise(F.col("reach")).alias("bound")
        bounded = homes.join(reach.select(F.col("query_id").alias("id"), bound), "id")
        packs = written(self._chosen(self._packed(bounded)).withColumn("any", F.array_distinct(F.flatten("q_blocks"))), "packs")
        # packs and groups are read from their files where they meet: no vector is shuffled once for each group
        met = written(self._grouped(), "groups").crossJoin(packs.hint("shuffle_replicate_nl")).where(F.array_contains("any", F.col("block")))
        more = packs.select(F.explode(F.flatten("q_blocks")).alias("block"), F.array(F.lit(0)).alias("q_ids"))
        return _compared(met, k, 0.0, self.metric, self.p, chosen=True), [visits, more]  # the likely shells again, in their groups

    def _grouped(self) -> DataFrame:
        """``block, r_ids, r_vectors`` of the groups, by their first shell."""
        starts, spark = self.shells.groups(), self.blocks.sparkSession
        group = self.shells.block[starts[np.searchsorted(starts, np.arange(len(self.shells.block)), side="right") - 1]]
        of = spark.createDataFrame(list(zip(self.shells.block.tolist(), group.tolist(), strict=True)), "block long, _group long")
        joined = self.blocks.join(F.broadcast(of), "block").groupBy(F.col("_group").alias("block"))
        packs = joined.agg(F.collect_list(F.struct("r_ids", "r_vectors")).alias("m"))  # ids and vectors in one list, so that their orders agree
        return packs.select("block", F.flatten("m.r_ids").alias("r_ids"), F.flatten("m.r_vectors").alias("r_vectors"))

    def neighbours(self, queries: DataFrame, k: int = 5, *, query_id: str = "sample_id", vector: str = "features") -> DataFrame:
        """What ``knn.neighbours`` gives, from the shells that may hold neighbours; queries that repeat an id share a bound of the nearest."""
        if not len(self.shells.block):
            return queries.sparkSession.createDataFrame([], "query_id long, reference_id long, distance double, rank int")
        return ranked(self._pairs(queries, k, query_id, vector)[0], k)

    def met(self, queries: DataFrame, k: int = 5, *, query_id: str = "sample_id", vector: str = "features") -> tuple[int, int]:
        """How many meetings of a query with a shell the neighbours take, and how many there are in all."""
        visits = self._pairs(queries, k, query_id, vector)[1]
        starts = self.shells.groups()
        many = dict(zip(self.shells.block[starts].tolist(), np.diff(starts, append=len(self.shells.block)).tolist(), strict=True))
        took = visits[0].agg(F.coalesce(F.sum(F.size("q_ids")), F.lit(0))).first()[0]
        took += sum(r["n"] * many[r["block"]] for r in visits[1].groupBy("block").agg(F.sum(F.size("q_ids")).alias("n")).collect())  # a row for each group
        return took, usable(queries, query_id, vector).count() * len(self.shells.block)

    def save(self, path: str) -> None:
        spark = self.blocks.sparkSession
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        rows = [(k, v.tolist(), self.metric, float(self.p)) for k, v in enumerate(self.shells.pivots)]
        spark.createDataFrame(rows, "pivot int, v array<double>, metric string, p double").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BallIndex:
        rows = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()  # PIVOTS rows at most
        metric, p = (rows[0]["metric"], rows[0]["p"]) if rows else ("euclidean", 2.0)
        return cls(spark.read.parquet(f"{path}/blocks"), np.array([r["v"] for r in rows], float), metric, p)
