"""Nearest neighbours of sparse fingerprints, from inverted lists per transmitter; no dense vector of all transmitters is made.

Readings are long rows ``id, key, value`` with values of 0 or more; what a fingerprint lacks counts as 0. The squared
distance of two fingerprints is the sum of their squared lengths less twice their product, and only transmitters that both
have add to the product. So

* of the references that share nothing with a query, the shortest are nearest: the k shortest of all speak for them;
* a query first meets the chunks of those whose two strongest transmitters are among its three strongest; the k-th distance
  there is its limit. The squares of what a reference lacks add to its distance, so one within the limit shares some pair of
  the query's strongest transmitters, or one of them where the limit is wide (``signature``). Only references with such a
  pair, and of a length that the limit allows, are compared: matrix products tell which may be near, exact distances decide.

References are packed into chunks once, queries into packs; each pack meets each chunk from their files, so neither is shuffled
for each that it meets. Of equal fingerprints the k of least id speak for all, and equal queries are asked once. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written
from .knn import ranked

#: Fingerprints of a chunk, queries of a pack, cells of a dense part, queries of a product, and fingerprints for which a task is worth it.
SCANS, PAGE, CELLS, TILE, FEW = 1 << 18, 1 << 17, 1 << 22, 128, 1 << 12
#: Products of a query among which a first k-th distance is sought, and pairs whose distances are held.
SAMPLE, PAIRS = 1024, 1 << 20
#: What rounding may add to a bound.
SLACK = 1e-9
LISTED = "ids array<long>, counts array<int>, keys array<string>, told array<double>"
SIGNED = "limits array<double>, at array<int>, one array<string>, other array<string>"


def readings(rows: DataFrame, id_col: str, key: str, value: str) -> DataFrame:
    """``id, key, value`` of the known readings above 0, dealt and sorted by id; values below 0 are refused."""
    known = rows.select(F.col(id_col).cast("long").alias("id"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    known = known.where("id is not null and key is not null and value is not null and not isnan(value)")
    checked = F.when((F.col("value") >= 0) & (F.col("value") < float("inf")), F.col("value")).otherwise(F.raise_error(F.lit("a reading below 0 or infinite has no sparse form")))
    return known.withColumn("value", checked).where("value > 0").repartition("id").sortWithinPartitions("id")


def fingerprints(rows: DataFrame, id_col: str, key: str, value: str) -> DataFrame:
    """``id, readings, size, strong``: each fingerprint's readings above 0 by transmitter, the greatest of those that repeat it, their squares' sum and the three strongest, ties by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = np.asarray(batch.column(0))
            ended = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            if not len(ids) or (ended == 0 and held and held[-1].column(0)[0] == batch.column(0)[0]):
                held.append(batch)
                continue
            yield whole([*held, batch.slice(0, ended)])
            held = [batch.slice(ended)]
        if held:
            yield whole(held)

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, keys, value = (pa.concat_arrays([b.column(c) for b in parts]) for c in range(3))
        ids, value, coded = np.asarray(ids), np.asarray(value), keys.dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[np.asarray(pc.sort_indices(coded.dictionary))] = np.arange(len(place))
        code = place[np.asarray(coded.indices)]
        by = np.lexsort((-value, code, ids))
        again = np.append(False, (ids[by][1:] == ids[by][:-1]) & (code[by][1:] == code[by][:-1]))
        by = by[~again]
        ids, code, value, keys = ids[by], code[by], value[by], keys.take(pa.array(by))
        start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.empty(0, np.int64)
        ends = pa.array(np.append(start, len(ids)), pa.int32())
        told = pa.StructArray.from_arrays([keys, pa.array(value)], names=["key", "value"])
        first = np.lexsort((code, -value, ids))
        kept = first[np.arange(len(ids)) - np.repeat(start, np.diff(ends)) < 3]
        strong = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.minimum(np.diff(ends), 3))), pa.int32()), keys.take(pa.array(kept)))
        size = np.add.reduceat(value**2, start) if len(start) else np.empty(0)
        return pa.RecordBatch.from_arrays([pa.array(ids[start]), pa.ListArray.from_arrays(ends, told), pa.array(size), strong], names=["id", "readings", "size", "strong"])

    return readings(rows, id_col, key, value).mapInArrow(run, "id long, readings array<struct<key: string, value: double>>, size double, strong array<string>")


class Listed:
    """Fingerprints as arrays: the row, the transmitter and the value of each reading; rows by length if ``by_length``."""

    def __init__(self, ids: pa.Array, counts: pa.Array, keys: pa.Array, told: pa.Array, *, by_length: bool = False) -> None:
        self.ids, count, self.value = np.asarray(ids), np.asarray(counts, np.int64), np.asarray(told, float)
        self.n, self.names, self.code = len(self.ids), keys, None
        self.row = np.repeat(np.arange(self.n), count)
        self.own = np.bincount(self.row, self.value * self.value, minlength=self.n)
        if by_length:
            order = np.argsort(self.own, kind="stable")
            at = spread(np.cumsum(count) - count, count, order)
            self.ids, self.own, self.value, self.names, count = self.ids[order], self.own[order], self.value[at], keys.take(pa.array(at)), count[order]
            self.row = np.repeat(np.arange(self.n), count)
        self.count, self.start = count, np.cumsum(count) - count

    def coded(self, names: pa.Array) -> Listed:
        """Codes are places in ``names``, -1 elsewhere."""
        self.code = np.asarray(pc.fill_null(pc.index_in(self.names, value_set=names), -1)).astype(np.int64)
        return self

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the readings of ``rows``, and which of ``rows`` each belongs to."""
        return spread(self.start, self.count, rows), np.repeat(np.arange(len(rows)), self.count[rows])

    def dense(self, rows: np.ndarray, column: np.ndarray, width: int, kind: type) -> np.ndarray:
        """Values of ``rows`` in ``width`` columns, of which ``column`` tells each code's, -1 for none."""
        at, row = self.entries(rows)
        to, out = column[self.code[at]], np.zeros((len(rows), width), kind)
        out[row[to >= 0], to[to >= 0]] = self.value[at[to >= 0]]
        return out


def spread(start: np.ndarray, count: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The places ``start`` to ``start + count`` of each of ``rows``, one after another."""
    n = count[rows]
    return np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def signature(squares: list[float], limit: float) -> list[tuple[int, int]]:
    """Pairs of places in ``squares``, the greatest first, or a place and -1: whatever is within ``limit`` and shares a place has such a pair.

    A pair is the first and the second place that both have; squares of places that are lacking sum to the limit at most.
    """
    out, before, after = [], 0.0, sum(squares)
    for first, square in enumerate(squares):
        if before > limit:
            break
        after -= square
        if before + after <= limit + SLACK * (before + after):
            out.append((first, -1))
        else:
            lacking = before
            for second in range(first + 1, len(squares)):
                if lacking > limit:
                    break
                out.append((first, second))
                lacking += squares[second]
        before += square
    return out


def strongest(squares: list[float], _: float) -> list[tuple[int, int]]:
    """The pairs among the first three places, or the only place."""
    return [(0, -1)] if len(squares) == 1 else [(0, 1), (0, 2), (1, 2)][: 1 if len(squares) == 2 else 3]


def signed(q: Listed, limits: np.ndarray, how) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Rows of ``q`` with the two transmitters, the second null for none, of each pair that ``how`` names, ordered by them and length."""
    order = np.lexsort((-q.value, q.row))
    squares = (q.value[order] ** 2).tolist()
    at, one, other = [], [], []
    for row, (start, count) in enumerate(zip(q.start.tolist(), q.count.tolist(), strict=True)):
        for a, b in how(squares[start : start + count], limits[row]):
            at.append(row)
            one.append(start + a)
            other.append(start + b if b >= 0 else -1)
    names = pc.unique(q.names)
    names = names.take(pc.sort_indices(names))
    code = np.append(np.asarray(pc.index_in(q.names, value_set=names)).astype(np.int64)[order], -1)
    at, one, other = np.array(at, np.int64), code[np.array(one, np.int64)], code[np.array(other, np.int64)]
    low, high = np.where(other < 0, one, np.minimum(one, other)), np.where(other < 0, -1, np.maximum(one, other))
    by = np.lexsort((q.own[at], high, low))
    return at[by], names.take(pa.array(low[by])), names.take(pa.array(high[by], mask=high[by] < 0))


class Chunk:
    """References by length, and those of each transmitter."""

    def __init__(self, *lists: pa.Array) -> None:
        self.refs = Listed(*lists, by_length=True)
        names = pc.unique(self.refs.names)
        self.names = names.take(pc.sort_indices(names))
        self.refs.coded(self.names)
        self.rows = self.refs.row[np.argsort(self.refs.code, kind="stable")]
        self.ends = np.searchsorted(np.sort(self.refs.code), np.arange(len(self.names) + 1))
        self.sizes = np.sqrt(self.refs.own)

    def having(self, code: int) -> np.ndarray:
        return self.rows[self.ends[code] : self.ends[code + 1]]

    def products(self, q: Listed, limits: np.ndarray, at: np.ndarray, one: pa.Array, other: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, references, their products less half the references' squared lengths, and the products' error for each query.

        ``at, one, other`` are pairs of ``signed``. Only references of a length that a query of the tile may meet are there.
        """
        r, places = self.refs, len(self.names)
        low = np.asarray(pc.fill_null(pc.index_in(one, value_set=self.names), -1)).astype(np.int64)
        high = np.asarray(pc.fill_null(pc.index_in(other, value_set=self.names), -1)).astype(np.int64)
        kept = (low >= 0) & ((high >= 0) | np.asarray(pc.is_null(other)))
        at, low, high = at[kept], low[kept], high[kept]
        kind = np.float32 if max(q.own.max(initial=0), r.own.max(initial=0)) < 1e30 else np.float64
        size, reach, has = np.sqrt(q.own), np.sqrt(limits), np.zeros(r.n, bool)
        starts = np.flatnonzero(np.diff(low, prepend=-1)) if len(low) else []
        for start, end in zip(starts, np.append(starts, len(low))[1:], strict=False):
            used = np.unique(q.code[q.entries(np.unique(at[start:end]))[0]])
            used = used[used >= 0]
            column = np.full(places, -1)
            column[used] = np.arange(len(used))
            column, width, every = np.append(column, -1), len(used) + 1, self.having(low[start])
            pairs = start + np.flatnonzero(np.diff(high[start:end], prepend=-2))
            for first in range(0, len(every), step := max(1, CELLS // width)):
                rows = every[first : first + step]
                dense = r.dense(rows, column, width, kind)
                dense[:, -1] = -r.own[rows] / 2
                for a, b in zip(pairs, np.append(pairs, end)[1:], strict=True):
                    mine, told = rows, dense
                    if high[a] >= 0:
                        has[them := self.having(high[a])] = True
                        both = np.flatnonzero(has[rows])
                        has[them] = False
                        mine, told = rows[both], dense[both]
                    for c in range(a, b, TILE):
                        queries = at[c : min(b, c + TILE)]
                        near = slice(*np.searchsorted(self.sizes[mine], [((size - reach)[queries] - 1e-6 * size[queries]).min(), ((size + reach)[queries] * (1 + 1e-6)).max()]))
                        if near.start >= near.stop:
                            continue
                        ask = q.dense(queries, column, width, kind)
                        ask[:, -1] = 1
                        slack = (q.count[queries] + 8) * np.finfo(kind).eps * 4 * (q.own[queries] + r.own[mine[near.stop - 1]])
                        yield queries, mine[near], ask @ told[near].T, slack

    def limits(self, q: Listed, limits: np.ndarray, k: int, *pairs) -> np.ndarray:
        """Squared distances that k references of a pair are within, for each query; infinite where fewer have one."""
        out = np.full(q.n, np.inf)
        for queries, refs, product, slack in self.products(q.coded(self.names), limits, *pairs):
            if len(refs) >= k:
                np.minimum.at(out, queries, np.maximum(0, q.own[queries] - 2 * greatest(product, k)) + 2 * slack)
        return out

    def found(self, q: Listed, limits: np.ndarray, k: int, *pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, references and their distances: the k nearest within the limits that have a pair, ties by id."""
        best, more, held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), [], 0
        for queries, refs, product, slack in self.products(q.coded(self.names), limits, *pairs):
            least = (q.own - limits * (1 + SLACK))[queries] / 2 - slack
            a, b = reached(product, least)
            if len(a) > 8 * k * len(queries) and len(refs) > k:
                a, b = reached(product, np.maximum(least, greatest(product, k) - 2 * slack))
            more.append(queries[a] * self.refs.n + refs[b])
            held += len(a)
            if held > PAIRS:
                best, more, held = self._best(q, k, best, more), [], 0
        return self._best(q, k, best, more)

    def _best(self, q: Listed, k: int, best: tuple, more: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = np.setdiff1d(np.concatenate([*more, np.empty(0, np.int64)]), best[0] * self.refs.n + best[1])
        a, b = np.divmod(pairs, self.refs.n)
        a, b, d = np.append(best[0], a), np.append(best[1], b), np.append(best[2], gaps(q, a, self.refs, b))
        order = np.lexsort((self.refs.ids[b], d, a))
        a, b, d = a[order], b[order], d[order]
        first = np.searchsorted(a, a)
        kept = np.arange(len(a)) - first < k
        return a[kept], b[kept], d[kept]


def reached(table: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells that reach their row's ``least``."""
    return np.divmod(np.flatnonzero(table >= least.astype(table.dtype)[:, None]), table.shape[1])


def greatest(table: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row."""
    n = table.shape[1]
    if n <= 2 * max(SAMPLE, k):
        return np.partition(table, n - k, axis=1)[:, n - k]
    some = table[:, :: n // max(SAMPLE, k)]
    least = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k]
    out = np.empty(len(table), table.dtype)
    for at, row in enumerate(table):
        row = row[row >= least[at]]
        out[at] = np.partition(row, len(row) - k)[len(row) - k]
    return out


def gaps(q: Listed, a: np.ndarray, r: Listed, b: np.ndarray) -> np.ndarray:
    """Distances of the queries ``a`` from the references ``b``, each summed by the order of transmitters, so that equal pairs have equal ones."""
    out = np.empty(len(a))
    q_names = q.names.take(pa.array(q.entries(np.unique(a))[0]))
    names = pc.unique(pa.concat_arrays([q_names, r.names.take(pa.array(r.entries(np.unique(b))[0]))]))
    names = names.take(pc.sort_indices(names))
    q_code, r_code = (np.asarray(pc.fill_null(pc.index_in(x.names, value_set=names), -1)).astype(np.int64) for x in (q, r))
    for first in range(0, len(a), step := max(1, min(1 << 14, CELLS // max(1, len(names))))):
        away = np.zeros((len(names), len(a[first : first + step])))
        at, pair = q.entries(a[first : first + step])
        away[q_code[at], pair] = q.value[at]
        at, pair = r.entries(b[first : first + step])
        away[r_code[at], pair] -= r.value[at]
        away *= away
        total = np.zeros(away.shape[1])
        for one in away:
            total += one
        out[first : first + step] = np.sqrt(total)
    return out


def _lists(batch: pa.RecordBatch, row: int, names: list[str]) -> list[pa.Array]:
    return [batch.column(name)[row].values for name in names]


def _listed(batch: pa.RecordBatch) -> list[pa.Array]:
    """``ids, counts, keys, told`` of a batch with ``id, readings``."""
    told = batch.column("readings")
    flat = told.flatten()
    return [batch.column("id"), told.value_lengths(), flat.field("key"), flat.field("value")]


def _packed(df: DataFrame, size: int, parts: int) -> DataFrame:
    """``block, ids, counts, keys, told, limits``: ``df (block, id, readings, limit)`` by block in lists of some ``size`` rows at most, from ``parts`` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        many: dict[int, int] = {}

        def out(block: int) -> pa.RecordBatch:
            many.pop(block)
            lists = [pa.concat_arrays(x) for x in zip(*held.pop(block), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)], names=["block", "ids", "counts", "keys", "told", "limits"])

        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            for block in np.unique(blocks).tolist():
                mine = batch.filter(pa.array(blocks == block))
                held.setdefault(block, []).append([*_listed(mine), mine.column("limit")])
                many[block] = many.get(block, 0) + mine.num_rows
                if many[block] >= size:
                    yield out(block)
        for block in list(held):
            yield out(block)

    return df.repartition(parts, "block").select("block", "id", "readings", "limit").mapInArrow(run, f"block long, {LISTED}, limits array<double>")


class SparseIndex:
    """Chunks of references, made when it is known how many neighbours are asked."""

    def __init__(self, references: DataFrame, *, id_col: str = "sample_id", key: str = "key", value: str = "value") -> None:
        """All fingerprints with a reading above 0; a fingerprint without any has no row here and takes no part."""
        self.references, self.names = references, (id_col, key, value)
        self.copies = 0

    def _built(self, k: int) -> None:
        """Chunks of the k references of least id of each fingerprint, by the two strongest transmitters; a pair of very many is dealt into several."""
        if self.copies >= k:
            return
        told = fingerprints(self.references, *self.names).withColumn("hash", F.xxhash64("readings"))
        place = F.row_number().over(W.partitionBy("hash", "readings").orderBy("id"))
        told = told.withColumn("place", place).where(F.col("place") <= k).select("id", "readings", "size", "hash", _pair(0, 1).alias("home"))
        self.scans = written(told, "scans")
        n, cores = self.scans.count(), told.sparkSession.sparkContext.defaultParallelism
        self.parts = max(1, -(-n // SCANS), min(2 * cores, -(-n // FEW)))  # few chunks still fill the cluster
        often = self.scans.groupBy("home").agg(F.count("*").alias("m")).where(F.col("m") > SCANS).select("home", F.ceil(F.col("m") / SCANS).alias("dealt"))
        dealt = self.scans.join(F.broadcast(often), "home", "left")  # fewer rows than chunks
        salt = F.pmod("hash", F.coalesce("dealt", F.lit(1)))
        block = F.pmod(F.xxhash64("home", salt), F.lit(self.parts))
        self.chunks = written(_packed(dealt.withColumn("block", block).withColumn("limit", F.lit(0.0)), SCANS, self.parts), "chunks").drop("limits")
        self.shortest = self.scans.orderBy("size", "id").limit(k).select("id", "readings", "size").toArrow()  # k rows that every task knows
        self.copies = k

    def _first(self, asked: DataFrame, k: int, *, counted: bool = False) -> DataFrame:
        """``id, limit``: a squared distance that k references of each query of ``asked (id, readings, strong)`` are within."""
        block = lambda a, b: F.pmod(F.xxhash64(_pair(a, b), F.lit(0).cast("long")), F.lit(self.parts))
        more = F.when(F.size("strong") > 2, F.array(block(0, 1), block(0, 2), block(1, 2))).otherwise(F.array(block(0, 1)))
        visits = asked.select("id", "readings", F.lit(float("inf")).alias("limit"), F.explode(F.array_distinct(more)).alias("block"))
        met = written(_packed(visits, PAGE, self.parts), "visits").withColumnsRenamed({"ids": "q_ids", "counts": "q_counts", "keys": "q_keys", "told": "q_told"}).join(self.chunks, "block")
        return _met(met, k, strongest, counted=counted)

    def _limited(self, asked: DataFrame, limits: DataFrame, k: int) -> DataFrame:
        """Packs of ``asked (id, readings, size)`` with their limits and pairs."""
        size = float(np.asarray(self.shortest["size"])[-1]) if self.shortest.num_rows == k else float("inf")
        limit = F.least(F.coalesce("limit", F.lit(float("inf"))), (F.col("size") + size) * (1 + SLACK)).alias("limit")
        told = asked.join(limits, "id", "left").select("id", "readings", limit)
        n, cores = asked.count(), asked.sparkSession.sparkContext.defaultParallelism
        packs = max(1, -(-n // PAGE), min(2 * cores // self.parts, -(-n // FEW)))
        packed = _packed(told.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(packs))), PAGE, packs)
        names, lists = packed.columns, packed.columns[1:5]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    one = batch.slice(row, 1)
                    q, limits = Listed(*_lists(one, 0, lists)), np.asarray(one.column("limits")[0].values)
                    at, low, high = signed(q, limits, signature)
                    more = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), x) for x in (pa.array(at, pa.int32()), low, high)]
                    yield pa.RecordBatch.from_arrays([*one.columns, *more], names=[*names, "at", "one", "other"])

        return written(packed.mapInArrow(run, f"block long, {LISTED}, {SIGNED}"), "packs")

    def _short(self, packs: DataFrame) -> DataFrame:
        """``query_id, reference_id, distance`` to those of the k shortest references that may be near though they share nothing."""
        lists = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in _listed(self.shortest.combine_chunks().to_batches()[0])] if self.shortest.num_rows else []
        names = packs.columns[1:5]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = Listed(*lists)
            for batch in batches:
                for row in range(batch.num_rows):
                    q, limits = Listed(*_lists(batch, row, names)), np.asarray(batch.column("limits")[row].values)
                    a, b = np.nonzero(q.own[:, None] + r.own[None, :] <= limits[:, None] * (1 + 4 * SLACK))
                    yield _pairs(q.ids[a], r.ids[b], gaps(q, a, r, b))

        return packs.where(F.lit(bool(lists))).mapInArrow(run, "query_id long, reference_id long, distance double")

    def neighbours(self, queries: DataFrame, k: int = 5, *, id_col: str = "sample_id", key: str = "key", value: str = "value") -> DataFrame:
        """``query_id, reference_id, distance, rank``: the k nearest references of each query with a reading above 0, ties by id."""
        every, asked, packs = self._asked(queries, k, id_col, key, value)
        met = _met(self._all(packs), k, None)
        best = ranked(met.unionByName(self._short(packs)).distinct(), k)
        same = every.select("id", "readings").join(asked.select("readings", F.col("id").alias("query_id")), "readings").select("id", "query_id")
        return written(best, "best").join(same, "query_id").select(F.col("id").alias("query_id"), "reference_id", "distance", "rank")

    def _asked(self, queries: DataFrame, k: int, id_col: str, key: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """All queries, one of each fingerprint (the least id), and packs of these with their limits."""
        self._built(k)
        every = written(fingerprints(queries, id_col, key, value), "asked")
        asked = written(every.groupBy("readings").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("strong").alias("strong")), "distinct")
        limits = self._first(asked, k).groupBy("id").agg(F.min("limit").alias("limit"))
        return every, asked, self._limited(asked, limits, k)

    def _all(self, packs: DataFrame) -> DataFrame:
        """Each pack with each chunk, read from their files."""
        asked = packs.withColumnsRenamed({"ids": "q_ids", "counts": "q_counts", "keys": "q_keys", "told": "q_told"}).drop("block")
        return self.chunks.crossJoin(asked.hint("shuffle_replicate_nl"))

    def met(self, queries: DataFrame, k: int = 5, *, id_col: str = "sample_id", key: str = "key", value: str = "value") -> tuple[int, int]:
        """How many pairs of a query and a reference the neighbours compare, and how many there are in all."""
        every, asked, packs = self._asked(queries, k, id_col, key, value)
        took = [x.agg(F.sum("met")).first()[0] or 0 for x in (self._first(asked, k, counted=True), _met(self._all(packs), k, None, counted=True))]
        return sum(took), every.count() * fingerprints(self.references, *self.names).count()


def _pair(a: int, b: int):
    """A hash of two of the strongest transmitters, whichever is stronger; of the only one where there is no other."""
    one, other = F.get("strong", F.lit(a)), F.get("strong", F.lit(b))
    return F.xxhash64(F.least(one, other), F.greatest(one, other))


def _pairs(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "reference_id", "distance"])


def _met(met: DataFrame, k: int, how, *, counted: bool = False) -> DataFrame:
    """What packs find in chunks: ``id, limit`` with the pairs that ``how`` names, ``query_id, reference_id, distance`` with their own; or the pairs ``met``.

    Successive rows of one chunk use it as it is.
    """
    own = [] if how else ["at", "one", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values
                if (name := (ids[0].as_py(), len(ids))) != last:
                    chunk, last = Chunk(*_lists(batch, row, ["ids", "counts", "keys", "told"])), name
                q, limits = Listed(*_lists(batch, row, ["q_ids", "q_counts", "q_keys", "q_told"])), np.asarray(batch.column("limits")[row].values)
                if how:
                    pairs = signed(q, limits, how)
                else:
                    at, one, other = _lists(batch, row, own)
                    pairs = np.asarray(at).astype(np.int64), one, other
                if counted:
                    yield pa.RecordBatch.from_arrays([pa.array([sum(len(a) * len(b) for a, b, *_ in chunk.products(q.coded(chunk.names), limits, *pairs))], pa.int64())], names=["met"])
                elif how:
                    yield pa.RecordBatch.from_arrays([pa.array(q.ids, pa.int64()), pa.array(chunk.limits(q, limits, k, *pairs))], names=["id", "limit"])
                else:
                    a, b, d = chunk.found(q, limits, k, *pairs)
                    yield _pairs(q.ids[a], chunk.refs.ids[b], d)

    columns = ["ids", "counts", "keys", "told", "q_ids", "q_counts", "q_keys", "q_told", "limits", *own]
    told = "met long" if counted else "id long, limit double" if how else "query_id long, reference_id long, distance double"
    return met.select(*columns).mapInArrow(run, told)
