"""Mixing sources to target weights by balanced sampling with the cube method.

A document whose source has target ratio r is taken floor(r) times, and once more with probability r - floor(r). The cube
method picks those extra takes: it walks the vector of probabilities inside the null-space of two constraints (tokens and
documents of the source stay as expected) until almost all are 0 or 1. A walk needs only three undecided documents at a
time: their null-space is one line, and a step to either end of it, chosen so that no probability changes on average,
decides at least one of them.

Three documents of unlike size leave the largest undecided for long. So the LARGE largest of a group are walked first, each
against all smaller ones, whose probabilities take up its tokens and its count in small steps.

Documents of a source are dealt into blocks by a hash, so a hot source is many groups. Each block leaves at most two
undecided documents; these meet in blocks again, level by level, until one group per source is left. Its last documents,
which the landing decides by dropping the token constraint, are small ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, Scratch, marked, unused

#: Documents of a block, blocks that meet at the next level.
BLOCK, FAN = 5_000, 1_000
#: Sources that a broadcast may hold; beyond, documents and sources are dealt by source and one of SALTS parts.
BROADCAST, SALTS = 20_000, 64
#: Documents of a group that are walked against all smaller ones.
LARGE = 500
NEAR = 1e-9


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, mark, source, size``; a null text has size 0, and ``mark`` is its hash."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), marked(text_col).alias("mark"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def placed(per: DataFrame, scratch: Scratch) -> DataFrame:
    """``per (source, ...)`` with ``place``: sources from 0 by code point, null last. Ranges of sources are numbered apart."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = scratch.write(per.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_at", within).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("place", F.col("_at") + F.col("_before") - 1).drop("_part", "_at", "_before")


def water_filled(per: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``per (place, size)`` with ``target``: ``share`` of all sizes by weight, none above ``most`` times its size, the excess reshared.

    Sources take the weights in turn by their place. Shares beyond ``most`` of everything stop there. Each round is one
    aggregate with a few whole numbers as its result: how many sources of each weight are still open, and the size of the
    others. A source that reaches its limit stays there, for the others' share per weight only grows.
    """
    turn, limit = F.col("place") % len(weights), most * F.col("size")
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), turn.cast("int"))
    total, level = per.agg(F.sum("size")).first()[0] or 0, 0.0
    held, before = F.lit(False), -1
    while True:
        told = per.agg(*(F.count_if(~held & (turn == k)) for k in range(len(weights))), F.coalesce(F.sum(F.when(held, F.col("size"))), F.lit(0)), F.count_if(held)).first()
        *open_, full, n = told
        per_weight = sum(w * c for w, c in zip(weights, open_, strict=True))
        if n == before or not per_weight:
            break
        before, level = n, (share * total - most * full) / per_weight
        held = F.lit(level) * weight > limit
    return per.withColumn("target", F.when(held, limit).otherwise(F.lit(level) * weight))


def _uniform(*key: object) -> Iterator[float]:
    """Uniform numbers that depend on the key alone."""
    k = 0
    while True:
        yield (xxhash.xxh3_64_intdigest(repr((*key, k))) >> 11) / (1 << 53)
        k += 1


def flight(sizes: list[float], p: list[float], draw: Iterator[float]) -> list[float]:
    """Probabilities after the walk: their sum and their sum weighted by ``sizes`` are kept, at most two stay undecided."""
    p, live, at, n = list(p), [], 0, len(p)
    while True:
        while len(live) < 3 and at < n:
            if NEAR < p[at] < 1 - NEAR:
                live.append(at)
            at += 1
        if len(live) < 3:
            return p
        a, b, c = live
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        live = _step(p, live, u, draw)


def _step(p: list[float], live: list[int], u: tuple[float, ...], draw: Iterator[float]) -> list[int]:
    """Move ``p`` to one end of the line through it along ``u``, without changing it on average; what stays undecided."""
    moved = [(k, v) for k, v in zip(live, u, strict=True) if v]
    up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in moved)
    down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in moved)
    by = up if next(draw) * (up + down) < down else -down
    for k, v in moved:
        q = p[k] + by * v
        p[k] = 0.0 if q <= NEAR else 1.0 if q >= 1 - NEAR else q
    return [k for k in live if 0 < p[k] < 1]


def walk_large(sizes: np.ndarray, p: np.ndarray, draw: Iterator[float], most: int = LARGE) -> np.ndarray:
    """``p`` after each of the first ``most`` documents was walked against all later ones; ``sizes`` must not increase."""
    p = p.copy()
    for k in range(min(most, len(p) - 3)):
        while NEAR < p[k] < 1 - NEAR:
            rest = k + 1 + np.flatnonzero((p[k + 1 :] > NEAR) & (p[k + 1 :] < 1 - NEAR))
            off = sizes[rest] - sizes[rest].mean() if len(rest) > 2 else np.zeros(1)
            spread = float(off @ off)
            if not spread:
                break
            u = np.concatenate([[1.0], -1 / len(rest) - off * (sizes[k] - sizes[rest].mean()) / spread])
            at = np.concatenate([[k], rest])
            q, moves = p[at], np.abs(u) > 1e-15
            room, back = np.where(u > 0, 1 - q, q)[moves] / np.abs(u[moves]), np.where(u > 0, q, 1 - q)[moves] / np.abs(u[moves])
            up, down = float(room.min()), float(back.min())
            q = q + (up if next(draw) * (up + down) < down else -down) * u
            p[at] = np.where(q <= NEAR, 0.0, np.where(q >= 1 - NEAR, 1.0, q))
    return p


def landing(p: list[float], draw: Iterator[float]) -> list[float]:
    """Decide what a walk left: pairs keep the expected number of documents, a last one is drawn."""
    p = list(p)
    live = [k for k, x in enumerate(p) if 0 < x < 1]
    while len(live) > 1:
        live = _step(p, live[:2], (1.0, -1.0), draw) + live[2:]
    for k in live:
        p[k] = 1.0 if next(draw) < p[k] else 0.0
    return p


def _decided(group: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """Rows with new ``p``, walked block by block; ids stay whole numbers or null throughout."""

    def walk(key: tuple, t: pa.Table) -> pa.Table:
        size, h, doc = (t[c].fill_null(0).to_numpy() for c in ("size", "h", "doc_id"))
        rows = np.lexsort((t["mark"].fill_null(0).to_numpy(), doc, t["doc_id"].is_null().to_numpy(), h, -size))
        draw, sizes = _uniform(seed, level, tuple(k.as_py() for k in key)), size[rows].astype(float)
        p = flight(sizes.tolist(), walk_large(sizes, t["p"].to_numpy()[rows], draw).tolist(), draw)
        t = t.take(pa.array(rows))
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(landing(p, draw) if last else p, pa.float64()))

    return group.groupBy("place", "block").applyInArrow(walk, group.schema)


def _planned(sized: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """``sized`` with its source's row of ``plan``; a counted small plan is broadcast, else a hot source is spread over SALTS parts."""
    known = plan.withColumnRenamed("source", "_s")
    same = F.col("source").eqNullSafe(F.col("_s"))
    if sources <= BROADCAST:
        return sized.join(F.broadcast(known), same).drop("_s", "source")
    salted = sized.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)))
    known = known.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(known, same & (F.col("_salt") == F.col("_to"))).drop("_s", "source", "_salt", "_to")


def cube_mix(
    docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for each row of ``docs``.

    A size is a number of words of the whole text, however long, 0 for null; ``taken`` is ``copies`` times the size, and
    ``copies`` is at most ``most`` rounded up. Null sources are one source, the last. Sources of size 0 take nothing. Rows
    that repeat a ``doc_id``, or have none, are sampled each by itself; equal rows are interchangeable, and rows of equal
    size are walked in an order that depends on their ids and texts alone. The same rows give the same mix, whatever their
    order. An empty table gives an empty mix. Other columns are not read.
    """
    return _mixed(docs, weights, share, most, seed, id_col, text_col, source_col).drop("mark")


def _mixed(docs: DataFrame, weights: tuple, share: float, most: float, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What ``cube_mix`` tells, with the ``mark`` of each row's text."""
    scratch = Scratch(docs.sparkSession, "cube")
    sized = scratch.write(word_sizes(docs, id_col, text_col, source_col), "sizes")
    per = scratch.write(placed(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), scratch), "sources")
    sources, largest = per.agg(F.count("*"), F.max("n")).first()
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    plan = water_filled(per, weights, share, most).select("source", F.col("place").cast("int").alias("place"), F.col("size").alias("source_size"), "target", ratio.alias("ratio"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    planned = _planned(sized, plan, sources)
    whole = F.floor(F.col("ratio") + F.lit(NEAR))
    planned = planned.withColumn("sure", whole).withColumn("p", F.when(F.col("ratio") - whole > NEAR, F.col("ratio") - whole).otherwise(0.0))

    nblocks = -(-(largest or 0) // BLOCK)
    rows = planned.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "mark")).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")))
    level, now = 0, scratch.write(_decided(rows, seed, 0, nblocks <= 1), "level-0")
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    done = [now.where(~undecided)] if nblocks > 1 else [now]
    while nblocks > 1:
        level, nblocks = level + 1, -(-nblocks // FAN)
        left = now.where(undecided).withColumn("block", F.expr(f"block div {FAN}"))
        now = scratch.write(_decided(left, seed, level, nblocks <= 1), f"level-{level}")
        done.append(now.where(~undecided) if nblocks > 1 else now)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("sure") + F.round("p")).cast("long")
    return out.select("doc_id", "mark", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs``, with all columns, each row as often as the mix takes it.

    A row is known by its id and text. The takes of rows that share both are dealt among them, so each of them comes as
    often as any other or once more. Nulls, empty texts and tables as in ``cube_mix``.
    """
    given, null, mark, copies, rows, copy = (unused(docs, n) for n in ("_given", "_null", "_mark", "_copies", "_rows", "_copy"))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(given), F.col("doc_id").isNull().alias(null)]
    mix = _mixed(docs, weights, share, most, seed).groupBy(*key, F.col("mark").alias(mark)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    both = docs.select("*", *key, marked("text").alias(mark)).join(mix, [given, null, mark])
    # only rows that share id and text need numbers; the window finds its rows where the join left them
    place = F.when(F.col(rows) > 1, F.row_number().over(W.partitionBy(given, null, mark).orderBy(rows))).otherwise(1)
    own = F.floor(F.col(copies) / F.col(rows)) + F.when(place <= F.col(copies) % F.col(rows), 1).otherwise(0)
    taken = both.withColumn(copies, own.cast("long")).where(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))
