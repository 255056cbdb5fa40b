"""Importance resampling towards a target distribution: a weighted draw without replacement, in ranks.

1. Features are runs of one or two words, hashed into BUCKETS buckets. Counts of both texts give each bucket's gain, an
   array of fixed size, and a document's weight is the mean gain of its features.
2. Weight plus Gumbel noise is a document's score; the highest scores are a draw without replacement by weight.
3. Each partition writes its eligible rows as a sorted run, cut into slices by the same splitters everywhere. The slices of
   one range are merged by a k-way tournament tree; ranges that begin behind the draw count aren't read.

Splitters come from a bounded sample and only decide which task merges what; order and ranks don't depend on them. Every
key is unique (the row number comes last), so any number of equal scores is split like other rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, marked

#: Buckets of features, words that a document needs to be drawn, and the share of such documents that is drawn, in percent.
BUCKETS, LEAST_WORDS, PERCENT = 10_000, 20, 25
#: Rows that one range should have, ranges at most, sampled keys per range, rows of a run's slice in one row of its table.
RANGE_ROWS, RANGES, SAMPLED, SLICE = 200_000, 4_096, 64, 32_768
#: Bytes of text that are hashed together, and the length from which a word behind another is hashed with it.
STRETCH, LONG = 4 << 20, 64
#: Lower-cases A-Z; digits, letters and bytes beyond ASCII are kept, all others part words.
KEPT_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: The reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def _shifts() -> np.ndarray:
    """``[n, k, b]``: what the byte ``b`` at place ``k`` of a CRC-32 becomes when ``n`` zero bytes follow; flat."""
    byte = np.arange(256, dtype=np.uint32)
    after = byte
    for _ in range(8):
        after = np.where(after & 1, (after >> 1) ^ np.uint32(_POLYNOMIAL), after >> 1)
    out = np.empty((LONG + 1, 4, 256), np.uint32)
    out[0] = byte << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(LONG):
        out[n + 1] = after[out[n] & 0xFF] ^ (out[n] >> np.uint32(8))
    return out.ravel()


SHIFTS = _shifts()


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each feature of ``texts``, text by text, and each text's number of words.

    A text of ``n`` words has its ``n`` words and then the ``n - 1`` runs of two. Each distinct word is hashed once; as
    CRC-32 is linear, the hash of two words follows from the first's, shifted by the bytes behind it, and the second's.
    """
    lists = [t.translate(KEPT_BYTES).split() if t else [] for t in texts]
    n_words = np.fromiter(map(len, lists), np.int64, len(lists))
    coded = pa.array(list(chain.from_iterable(lists)), pa.binary()).dictionary_encode()
    kinds, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    size = np.fromiter(map(len, kinds), np.int64, len(kinds))
    alone = np.fromiter(map(zlib.crc32, kinds), np.uint32, len(kinds))
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in kinds), np.uint32, len(kinds))

    one = alone[code]
    text = np.repeat(np.arange(len(texts)), n_words)
    behind = np.flatnonzero(text[1:] == text[:-1]) + 1
    second, was = code[behind], one[behind - 1]
    shift = np.minimum(size[second] + 1, LONG) << 10
    two = spaced[second]
    for k in range(4):
        two ^= SHIFTS[shift + (k << 8) + ((was >> np.uint32(8 * k)) & np.uint32(0xFF))]
    for at in np.flatnonzero(size[second] >= LONG).tolist():
        two[at] = zlib.crc32(b" " + kinds[second[at]], int(was[at]))

    many = np.maximum(2 * n_words - 1, 0)
    out, base = np.empty(int(many.sum()), np.uint32), np.cumsum(many) - many
    place = np.arange(len(code)) - (np.cumsum(n_words) - n_words)[text]
    out[base[text] + place] = one
    out[(base + n_words)[text[behind]] + place[behind] - 1] = two
    return (out % np.uint32(BUCKETS)).astype(np.int64), n_words


def _stretches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of batches of about STRETCH bytes of text, with their texts."""
    for batch in batches:
        at, held = 0, batch.column(column)
        size = np.cumsum([x.as_buffer().size if x.is_valid else 0 for x in held])
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + STRETCH, "right")))
            yield batch.slice(at, end - at), held.slice(at, end - at).to_pylist()
            at = end


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all rows fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, part in _stretches(batches, 0):
            total += np.bincount(features(part)[0], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in texts.select(as_bytes(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down, in doubles."""
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (s_all + BUCKETS)) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variate by a hash of the id (nothing for null), rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, *, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, n_words, n_features, weight, score`` for each row; without words the weight is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _stretches(batches, 2):
            buckets, n_words = features(texts)
            many = np.maximum(2 * n_words - 1, 0)
            sums = np.concatenate([[0], np.cumsum(gain[buckets])])
            ends = np.cumsum(many)
            weight = np.where(many > 0, (sums[ends] - sums[ends - many]) // np.maximum(many, 1), 0)
            score = weight + np.array([noise(d, seed) for d in part.column(0).to_pylist()], np.int64)
            told = [pa.array(x.astype(np.int64)) for x in (n_words, many, weight, score)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *told], names=["doc_id", "mark", "n_words", "n_features", "weight", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), marked(text_col).alias("mark"), as_bytes(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, mark long, n_words long, n_features long, weight long, score long")


class Tournament:
    """A tree of losers over sorted runs: each step yields the least head and replays the matches of its run alone."""

    def __init__(self, runs: Iterable[Iterator], key: Callable = lambda x: x) -> None:
        self.runs, self.key = list(runs), key
        self.width = 1
        while self.width < max(1, len(self.runs)):
            self.width *= 2
        self.heads: list = [self._next(k) for k in range(self.width)]
        self.loser = [0] * self.width
        self.winner = self._play(1)

    def _next(self, k: int) -> tuple:
        """A run's next row behind its key; an ended or missing run comes after all."""
        if k < len(self.runs):
            for row in self.runs[k]:
                return (0, self.key(row), k, row)
        return (1, None, k, None)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x[0] < y[0] or x[0] == y[0] == 0 and (x[1], a) < (y[1], b)

    def _play(self, node: int) -> int:
        """The winner below ``node``; its leaves are the runs."""
        if node >= self.width:
            return node - self.width
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._before(a, b) else (b, a)
        self.loser[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.heads[self.winner][0] == 0:
            k = self.winner
            yield self.heads[k][3]
            self.heads[k] = self._next(k)
            node = (k + self.width) // 2
            while node:
                if self._before(self.loser[node], k):
                    k, self.loser[node] = self.loser[node], k
                node //= 2
            self.winner = k


#: What a key orders by: falling scores, rising ids with nulls last, then the text's hash and the row.
KEY = ("down", "no_id", "id", "mark", "row")
RUN = ("down", "no_id", "id", "mark", "row", "n_features", "weight")


def _keyed(rows: DataFrame) -> DataFrame:
    """Columns of RUN for each row of ``scored`` with its number ``row``."""
    return rows.select((-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark", "row", "n_features", "weight")


def _range_of(splitters: list[tuple], columns: list[np.ndarray]) -> np.ndarray:
    """For rows that are sorted by KEY, the number of splitters not after each."""
    keys = list(zip(*(c.tolist() for c in columns), strict=True))
    return np.array([bisect_right(splitters, k) for k in keys], np.int32)


def _sliced(sorted_rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Each partition's sorted run as rows ``range, run, slice, n, data``: ``data`` has the columns of RUN one after another."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, at, k = TaskContext.get().partitionId(), [], None, 0

        def told(part: np.ndarray) -> pa.RecordBatch:
            data = np.ascontiguousarray(part.T).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([own], pa.int32()), pa.array([k], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([data], pa.binary())], names=["range", "run", "slice", "n", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            where, rows = _range_of(splitters, columns[: len(KEY)]), np.stack(columns, axis=1)
            cuts = np.flatnonzero(np.diff(where)) + 1
            for part, number in zip(np.split(rows, cuts), where[np.concatenate([[0], cuts])].tolist(), strict=True):
                if held and (number != at or sum(map(len, held)) >= SLICE):
                    yield told(np.concatenate(held))
                    k, held = k + 1 if number == at else 0, []
                at = number
                held.append(part)
        if held:
            yield told(np.concatenate(held))

    return sorted_rows.mapInArrow(run, "range int, run int, slice int, n long, data binary")


def _merged(slices: DataFrame, before: dict[int, int], most: int) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` and the key of the first ``most`` rows, range by range."""

    def rows_of(parts: list[bytes]) -> Iterator[tuple]:
        for data in parts:
            yield from zip(*np.frombuffer(data, np.int64).reshape(len(RUN), -1).tolist(), strict=True)

    def merged(number: int, runs: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        rank, out = before[number], []

        def told() -> pa.RecordBatch:
            cells = np.array(out, np.int64).reshape(-1, len(RUN) + 1)
            no_id = cells[:, 1] == 1
            ids = pa.array(cells[:, 2], mask=no_id)
            return pa.RecordBatch.from_arrays([ids, *(pa.array(cells[:, c]) for c in (5, 6)), pa.array(-cells[:, 0]), pa.array(cells[:, 7]), pa.array(cells[:, 3]), pa.array(cells[:, 4])], names=["doc_id", "n_features", "weight", "score", "rank", "mark", "row"])

        for row in Tournament(rows_of(parts) for parts in runs.values()):
            if rank >= most:
                break
            rank += 1
            out.append((*row, rank))
            if len(out) >= SLICE:
                yield told()
                out = []
        if out:
            yield told()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, runs = None, {}
        for batch in batches:
            for number, own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True):
                if number != at:
                    if runs:
                        yield from merged(at, runs)
                    at, runs = number, {}
                runs.setdefault(own, []).append(data.as_py())
        if runs:
            yield from merged(at, runs)

    return slices.mapInArrow(run, "doc_id long, n_features long, weight long, score long, rank long, mark long, row long")


def _splitters(rows: DataFrame, n: int) -> list[tuple]:
    """Keys that cut ``n`` rows into ranges of about RANGE_ROWS, from at most about ``2 * RANGES * SAMPLED`` sampled keys."""
    ranges = min(RANGES, -(-n // RANGE_ROWS))
    if ranges < 2:
        return []
    every = max(1, n // (ranges * SAMPLED))
    sample = rows.where(F.pmod(F.xxhash64("row", "mark"), F.lit(every)) == 0).select(*KEY).limit(2 * RANGES * SAMPLED).collect()
    keys = sorted(tuple(r) for r in sample)
    return [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each row of ``docs``; ``rank`` is null for rows that aren't drawn.

    Of the ``N`` rows with at least ``least_words`` words the ``percent * N // 100`` of highest score are drawn, ties to
    the smaller id, nulls last; rows that are alike in both come in the order of their texts' hashes. A null or empty text,
    or one without words, has no features and weight 0. Rows that repeat an id have the same noise and are ranked each. An
    empty ``docs`` gives an empty result; with an empty ``target`` every gain follows from the corpus alone. Texts of any
    length and with any bytes are read whole. Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "resampling")
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    told = scored(docs, gain, seed=seed, id_col=id_col, text_col=text_col).withColumn("row", F.monotonically_increasing_id())
    told = scratch.write(told, "scored")
    eligible = F.col("n_words") >= least_words
    n = told.where(eligible).count()
    most = percent * n // 100
    columns = ("doc_id", "n_features", "weight", "score")
    undrawn = told.select(*columns, F.lit(None).cast("long").alias("rank"))
    if not most:
        return undrawn
    keyed = _keyed(told.where(eligible))
    slices = scratch.write(_sliced(keyed.sortWithinPartitions(*KEY), _splitters(keyed, n)), "runs")
    sizes = {r["range"]: r["n"] for r in slices.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # RANGES rows at most
    before, at = {}, 0
    for number in sorted(sizes):
        before[number], at = at, at + sizes[number]
    wanted = [k for k, b in before.items() if b < most]
    dealt = slices.where(F.col("range") <= max(wanted)).repartitionById(max(wanted) + 1, "range").sortWithinPartitions("range", "run", "slice")
    drawn = scratch.write(_merged(dealt, before, most), "drawn")
    scratch.drop("runs")
    last = drawn.where(F.col("rank") == most).select(*_key_of(drawn)).first()
    beyond = F.struct(*_key_of(told)) > F.struct(*(F.lit(v).cast("long").alias(k) for k, v in zip(KEY, last, strict=True)))
    return drawn.select(*columns, "rank").unionByName(told.where(~eligible | beyond).select(*columns, F.lit(None).cast("long").alias("rank")))


def _key_of(rows: DataFrame) -> list:
    """The columns of KEY from ``doc_id, score, mark, row``."""
    return [(-rows["score"]).alias("down"), rows["doc_id"].isNull().cast("long").alias("no_id"), F.coalesce(rows["doc_id"], F.lit(0)).alias("id"), rows["mark"].alias("mark"), rows["row"].alias("row")]


#: DuckDB SQL for the table ``crc_table (t)`` that ``crc_sql`` reads.
CRC_TABLE = "crc_table AS (SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b))"


def crc_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text's UTF-8 bytes."""
    steps = f"list_prepend(4294967295::BIGINT, list_transform(range(strlen({text})), lambda i: ('0x' || hex({text})[2 * i + 1:2 * i + 2])::BIGINT))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


#: DuckDB SQL for resampled, with the parameters' defaults.
ORACLE = rf"""
WITH {CRC_TABLE}, texts AS (SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
kinds AS (SELECT DISTINCT f FROM f),
hashed AS (SELECT f, ({crc_sql("f")}) % {BUCKETS} AS b FROM kinds, crc_table),
counts AS (SELECT b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM f JOIN hashed USING (f) GROUP BY b),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gain AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + {BUCKETS})) / ((s + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS g FROM counts, totals),
weights AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS g FROM f JOIN hashed USING (f) JOIN gain USING (b) WHERE side = 's' GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n IS NULL THEN 0 WHEN g % n <> 0 AND g < 0 THEN g // n - 1 ELSE g // n END::BIGINT AS weight,
  ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM w LEFT JOIN weights USING (r) WHERE side = 's'),
told AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS n FROM told)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed
"""
