"""Token ids as independent blocks of a static range asymmetric numeral system (rANS).

One frequency table, counted over all documents, serves every block. In a block, id ``i`` belongs to lane ``i % lanes``;
all lanes advance together as one NumPy vector. Lanes share one stream of 32-bit words, in the order in which a decoder
asks for them. Every ``STEPS`` steps a checkpoint keeps the lanes' states and the place in the stream, so parts of a block
can be decoded on their own; checksums cover the table, each block's payload and, through the reader, each document.

A written output is a folder with the Parquet tables ``table (id, freq)`` and ``blocks (part, block, n_ids, data)``.
Spark's writers commit both, so a lost executor leaves no half-written block and any file system of Spark's will do.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, arrow_rows, as_bytes, kept_in_worker, let_go
from .tokenized import Encoder, as_text

#: Ids of a block (a longer document has a block of its own), lanes, steps between checkpoints.
BLOCK, LANES, STEPS = 1 << 19, 1024, 256
#: Least state of a lane; states stay below LOW << 32.
LOW = np.uint64(1 << 31)
HEAD = "<4sBxHIIIIII"
MAGIC = b"rANS"


def quantised(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies that add up to ``2 ** bits``, at least 1 for each id that occurs; and ``bits``."""
    seen = np.flatnonzero(counts)
    bits = max(12, int(len(seen) - 1).bit_length() + 3) if len(seen) else 12
    freq = np.zeros(len(counts), np.int64)
    if len(seen):
        freq[seen] = np.maximum(1, (counts[seen].astype(np.float64) * (1 << bits) / counts.sum()).astype(np.int64))
        by_size = seen[np.argsort(-freq[seen], kind="stable")]
        while over := int(freq.sum()) - (1 << bits):
            if over < 0:
                freq[by_size[0]] -= over
                break
            cut = np.minimum(freq[by_size] // 2, np.maximum(0, freq[by_size] - 1))
            cut = np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
            freq[by_size] -= cut
    return freq, bits


class Table:
    def __init__(self, freq: np.ndarray, bits: int) -> None:
        self.freq, self.bits = freq.astype(np.uint64), bits
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.symbol: np.ndarray | None = None

    def symbols(self) -> np.ndarray:
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self.symbol


def encode(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], table: Table) -> bytes:
    """A block of whole documents: ``lengths`` of ``ids`` belong to each of ``doc_ids``."""
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    bits, all_freq, all_start = np.uint64(table.bits), table.freq[ids], table.start[ids]
    state = np.full(lanes, LOW, np.uint64)
    limit, low32, word = np.uint64(63 - table.bits), np.uint64(0xFFFFFFFF), np.uint64(32)
    out, marks, written = [], [], 0
    for t in range(steps - 1, -1, -1):
        f, c = all_freq[t * lanes : (t + 1) * lanes], all_start[t * lanes : (t + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << limit)
        if full.any():
            out.append((x[full] & low32).astype("<u4"))
            written += len(out[-1])
            x[full] >>= word
        q = x // f
        x[:] = (q << bits) + (x - q * f) + c
        if t and t % STEPS == 0:
            marks.append((written, state.copy()))
    words = np.concatenate(out[::-1]).tobytes() if out else b""
    held = [written - w for w, _ in marks[::-1]]
    nulls = np.packbits([d is None for d in doc_ids]).tobytes()
    payload = b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls, np.array(lengths, "<u4").tobytes(), np.array(held, "<u4").tobytes(),
        *(s.astype("<u8").tobytes() for s in (state, *(s for _, s in marks[::-1]))), words,
    ])
    return struct.pack(HEAD, MAGIC, table.bits, lanes, n, len(doc_ids), len(held), written, table.crc, zlib.crc32(payload)) + payload


class Block:
    """A block's parts, after its checksum."""

    def __init__(self, data: bytes, table: Table) -> None:
        magic, bits, self.lanes, self.n, docs, marks, words, crc, sum_ = struct.unpack_from(HEAD, data)
        if magic != MAGIC or bits != table.bits or crc != table.crc:
            raise ValueError("the block is of another format or frequency table")
        if zlib.crc32(memoryview(data)[struct.calcsize(HEAD) :]) != sum_:
            raise ValueError("the block's checksum doesn't hold")
        at = struct.calcsize(HEAD)

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, k, at)
            at += got.nbytes
            return got

        ids, nulls = take("<i8", docs), np.unpackbits(take("u1", -(-docs // 8)), count=docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls, strict=True)]
        self.lengths = take("<u4", docs)
        self.places = [0, *take("<u4", marks).tolist()]
        self.states = [take("<u8", self.lanes) for _ in range(marks + 1)]
        self.words, self.table = take("<u4", words), table

    def part(self, k: int) -> np.ndarray:
        """The ids from checkpoint ``k`` (0: the start) to the next one, decoded on their own."""
        table, lanes = self.table, self.lanes
        bits, mask, word = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(32)
        first = k * STEPS * lanes
        last = min(self.n, first + STEPS * lanes)
        x_all, at, out = self.states[k].copy(), self.places[k], np.empty(last - first, np.uint32)
        symbols = table.symbols()
        for i in range(0, len(out), lanes):
            s = out[i : i + lanes]
            x = x_all[: len(s)]
            slot = x & mask
            s[:] = symbols[slot]
            x[:] = table.freq[s] * (x >> bits) + slot - table.start[s]
            need = x < LOW
            if k_need := int(np.count_nonzero(need)):
                x[need] = (x[need] << word) | self.words[at : at + k_need]
                at += k_need
        return out

    def ids(self) -> np.ndarray:
        return np.concatenate([self.part(k) for k in range(len(self.places))]) if self.n else np.empty(0, np.uint32)


def tokenizer_file(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


class Parts:
    """Ranges of ids, one part each; an id that fills several parts by itself, and nulls, which come first, are dealt to as many."""

    def __init__(self, cuts: list[int], nulls: int, n: int, parts: int) -> None:
        """``cuts``: the ids at ``parts - 1`` even steps of ``n`` rows, repeated where one id spans steps."""
        often = Counter(cuts)
        self.bounds = sorted({*often, *(v + 1 for v, c in often.items() if c > 1)})
        widths = [max(1, -(-nulls * parts // max(1, n))), 1, *(max(1, often[v]) for v in self.bounds)]
        self.first = [sum(widths[:k]) for k in range(len(widths) + 1)]
        self.count = self.first[-1]

    def of(self, doc_id: int | None, turn: int) -> int:
        """The part of a row; ``turn`` deals rows of one id."""
        k = 0 if doc_id is None else 1 + bisect_right(self.bounds, doc_id)
        return self.first[k] + turn % (self.first[k + 1] - self.first[k])


def _tokens(docs: DataFrame, file: str, end_id: int, ranges: Parts, id_col: str, text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(file)  # a vocabulary: a few MB, whatever the corpus
    key = zlib.crc32(file.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_in_worker(("encoder", key), lambda: Encoder(sent.value))
        end, turn = np.array([end_id], coder.dtype).tobytes(), count()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                doc_ids, ids = part.column(0).to_pylist(), [x + end for x in coder.encode_all(as_text(part.column(1)))]
                parts = [ranges.of(d, next(turn)) for d in doc_ids]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])
                del ids
                pa.default_memory_pool().release_unused()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return slim.mapInArrow(run, "part int, doc_id long, ids binary")


def _packs(ordered: DataFrame, width: int) -> DataFrame:
    """Runs of whole documents of about BLOCK ids: one row each, numbered within its part."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        part, block, doc_ids, held, size = None, 0, [], [], 0

        def pack() -> pa.RecordBatch:
            row = {"part": part, "block": block, "doc_ids": doc_ids, "lengths": [len(x) // width for x in held], "ids": b"".join(held)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for p, d, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc_ids and (p != part or size + len(ids) > BLOCK * width):
                    yield pack()
                    block, doc_ids, held, size = block + 1 if p == part else 0, [], [], 0
                part = p
                doc_ids.append(d)
                held.append(ids)
                size += len(ids)
        if doc_ids:
            yield pack()

    return ordered.mapInArrow(run, "part int, block long, doc_ids array<long>, lengths array<long>, ids binary")


def _counts(packs: DataFrame, dtype: str, vocab: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype), minlength=vocab)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    out = np.zeros(vocab, np.int64)
    for row in packs.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        out[row["id"]] = row["n"]
    return out


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), append ``end_id``, and write the ids in ascending ``doc_id`` order to ``path``.

    ``tokenizer`` is the path of a tokenizers JSON file on the driver. Null ids come first. Rows that repeat a ``doc_id``
    stay apart, in the order of their ids' bytes within a part; an id, or null, that holds more rows than a part should is
    dealt to several in turn. Bytes that aren't UTF-8 are read as U+FFFD. An empty table gives an empty table of blocks.
    Other columns are not read.
    """
    spark = docs.sparkSession
    scratch, file = Scratch(spark, "token-ids"), tokenizer_file(tokenizer)
    coder = Encoder(file)
    width, dtype = coder.dtype.itemsize, coder.dtype.str
    vocab = max(coder.all.get_vocab_size(), (end_id or 0) + 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = F.col(id_col).cast("long")
    told = docs.select(F.percentile_approx(ids, [k / parts for k in range(1, parts)] or [0.5], 100 * parts).alias("cuts"), F.count_if(ids.isNull()).alias("nulls"), F.count("*").alias("n")).first()
    ranges = Parts(told["cuts"] or [], told["nulls"], told["n"], parts)
    tokens = _tokens(docs, file, end_id, ranges, id_col, text_col) if end_id is not None else _tokens(docs, file, 0, ranges, id_col, text_col).withColumn("ids", F.expr(f"substring(ids, 1, length(ids) - {width})"))
    ordered = tokens.repartitionById(ranges.count, "part").sortWithinPartitions("part", "doc_id", "ids")
    packs = scratch.write(_packs(ordered, width), "packs")
    freq, bits = quantised(_counts(packs, dtype, vocab))
    seen = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i]), bits, vocab) for i in seen], "id int, freq int, bits int, vocab int").coalesce(1).write.parquet(f"{path}/table")

    def make():
        let_go()
        table = Table(freq, bits)

        def rows(part: int, block: int, doc_ids: list, lengths: list, ids: bytes) -> Iterator[tuple]:
            got = np.frombuffer(ids, dtype)
            yield part, block, len(got), encode(got, doc_ids, lengths, table)

        return rows

    arrow_rows(packs, "part int, block long, n_ids long, data binary", make, most=1).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop("packs")


def _read_table(spark, path: str) -> Table:
    rows = spark.read.parquet(f"{path}/table").collect()  # at most the vocabulary
    freq = np.zeros(max((r["vocab"] for r in rows), default=1), np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    return Table(freq, rows[0]["bits"] if rows else 12)


def read_token_ids(spark, path: str, *, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids array<int>`` of each document in an output of ``write_token_ids``.

    ``start`` counts the ids of all documents before it; the checksum is that of the ids as little-endian 32-bit integers.
    """
    table, blocks = _read_table(spark, path), spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", "n_ids")
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids")
    total, starts = 0, []
    for row in sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each part
        starts.append((row["part"], total))
        total += row["n"]
    before = sizes.withColumn("within", within).join(F.broadcast(spark.createDataFrame(starts, "part int, base long")), "part")
    placed = before.select("part", "block", (F.col("within") + F.col("base")).alias("at"))

    def make():
        let_go()

        def rows(part: int, block: int, data: bytes) -> Iterator[tuple]:
            held = Block(data, table)
            ids, at = held.ids(), 0
            for doc_id, n in zip(held.doc_ids, held.lengths.tolist(), strict=True):
                own = ids[at : at + n]
                yield (part, block, doc_id, at, n, zlib.crc32(own.astype("<u4").tobytes()), *([own.tolist()] if with_ids else []))
                at += n

        return rows

    schema = "part int, block long, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    told = arrow_rows(blocks.select("part", "block", "data"), schema, make, most=1)
    out = told.join(placed, ["part", "block"]).withColumn("start", F.col("at") + F.col("offset"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_ids(docs: DataFrame, tokenizer: str, *, end_id: int | None = None) -> DataFrame:
    """Write ``docs`` in the file format to a folder among the shared ones, and describe each document from those files.

    Rows are those of ``read_token_ids``. Null texts are empty ones, and texts of any length are encoded whole, one longer
    than a block in a block of its own. Null ids and rows that repeat an id as in ``write_token_ids``. An empty table gives an empty result. Other columns are not read.
    """
    path = f"{Scratch(docs.sparkSession, 'rans').root}/out"
    write_token_ids(docs, path, tokenizer, end_id=end_id)
    return read_token_ids(docs.sparkSession, path, with_ids=False)
