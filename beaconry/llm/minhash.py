"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each text becomes the set of its word shingles, hashed once; the k least hashes are its sketch. Texts with equal sets
   form a class, so copies never meet as pairs.
2. Inverted lists of retained values generate overlaps. A pair at the threshold shares at least NEED of the LISTS least
   values, so each class enters only the lists of all but its NEED - 1 most frequent values.
3. Inside a list, the k least values of two sketches' union estimate the Jaccard similarity. Pairs that may reach the
   threshold connect; these loose clusters contain every link.
4. The full sets of a loose cluster's members decide, and links become connected components.

A group, list or cluster, of more than a block meets one block of pivots first: each other block is compared with the pivots
alone, so that costs as much as the group has members. Where all members then hang together, which near copies of one text
do, nothing is left to tell. Else the members outside the group's largest part are dealt into blocks, which meet each other
and the blocks of that part: that is linear for a few of them, and quadratic in blocks for a group that neither links nor
falls apart, such as a template with a third of its own in each text. At first a class enters only the list of its most frequent value among those it may enter; the
other lists are opened only where their members don't hang together yet. Blocks are bounded in members and in bytes, no
pairs are written, and what leaves a task grows with its members.

Two sets of similarity 0.8 share fewer than 16 of 32 least values with probability 1.3e-8, and are estimated below 0.55 of
64 values with 4.2e-6 (binomial tails): that is the chance to miss a link at the threshold, and it falls fast above it. With
``exact=True`` sets are kept whole, lists follow from the sets' sizes, full sets decide at once, and no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, WordHashes, arrow_rows, as_bytes, components, kept_in_worker, marked, unused, window_hashes, without_rows, words_of

#: Values of a sketch, values that open inverted lists, list values that a pair must share, members and bytes of a block.
KEPT, LISTS, NEED, BLOCK, BLOCK_BYTES = 64, 32, 16, 512, 16 << 20
#: Columns of an incidence matrix at a time.
COLUMNS = 4096
#: Larger than any hash.
END = np.iinfo(np.int64).max
#: What the estimate may fall below the threshold.
SLACK = 0.25
#: Bits of the filter that spares most texts a second look; it is a table of at most BITS / 64 rows.
BITS = 1 << 23


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles."""
    return np.unique(window_hashes(hashes.of(words), width) >> np.uint64(1)).astype(np.int64)


def fingerprint(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text", kept: int | None = KEPT) -> DataFrame:
    """``doc_id, mark, n_shingles, fp, sketch`` for each row; ``fp`` and ``sketch`` are null without words."""

    def make():
        hashes = kept_in_worker("word hashes", WordHashes)

        def rows(doc_id: int | None, mark: int, text: bytes | None) -> Iterator[tuple]:
            found = shingle_set(words_of(text.lower() if text else None), width, hashes)
            yield (doc_id, mark, len(found), fingerprint(found), found[:kept].tobytes()) if len(found) else (doc_id, mark, 0, None, None)

        return rows

    return arrow_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), marked(text_col).alias("mark"), as_bytes(text_col).alias("text")), "doc_id long, mark long, n_shingles long, fp binary, sketch binary", make)


def _bit(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(BITS))


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``fp, full`` of the classes in ``wanted (fp, rep)``; texts other than their representatives' are mostly not read by Python."""
    bits = wanted.select(_bit("rep").alias("_bit")).groupBy(F.expr("_bit div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits"))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text")).withColumn("_bit", _bit("doc_id"))
    near = slim.join(F.broadcast(bits), (F.expr("_bit div 64") == F.col("_word")) & (F.expr("shiftright(_bits, cast(_bit % 64 as int)) & 1") == 1)).select("doc_id", "text")

    def make():
        hashes = kept_in_worker("word hashes", WordHashes)

        def rows(doc_id: int | None, text: bytes | None) -> Iterator[tuple]:
            found = shingle_set(words_of(text.lower() if text else None), width, hashes)
            if len(found):
                yield doc_id, fingerprint(found), found.tobytes()

        return rows

    sets = arrow_rows(near, "doc_id long, fp binary, full binary", make)
    of = wanted.select(F.col("fp").alias("_fp"), "rep")
    return sets.join(of, (F.col("fp") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").dropDuplicates(["fp"]).select("fp", "full")


def _lists(classes: DataFrame, scratch: Scratch, percent: int, exact: bool) -> DataFrame:
    """``value, fp, first`` for each inverted list that a class enters and that has another class; ``first`` marks its most frequent one."""
    held = F.expr("length(sketch) div 8") if exact else F.least(F.expr("length(sketch) div 8"), F.lit(LISTS))
    values = F.expr("transform(sequence(0, s - 1), at -> substring(sketch, at * 8 + 1, 8))")  # an array, so that no row carries a whole sketch
    long = classes.select("fp", held.cast("int").alias("s"), "sketch").select("fp", "s", F.explode(values).alias("value"))
    often = scratch.write(long.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "often")
    w = W.partitionBy("fp").orderBy(F.desc("df"), "value")
    need = F.greatest(F.expr(f"(s * {percent} + 99) div 100" if exact else f"s * {NEED} div {LISTS}"), F.lit(1))
    kept = long.join(often, "value").withColumn("hot", F.row_number().over(w)).where(F.col("hot") >= need)
    out = scratch.write(kept.select("value", "fp", (F.col("hot") == need).alias("first")), "lists")
    scratch.drop("often")
    return out


def _labels(near: np.ndarray) -> np.ndarray:
    """For each node of a symmetric adjacency matrix, the least node of its component."""
    labels = np.arange(len(near))
    while True:
        after = np.minimum(labels, np.where(near, labels[None, :], len(near)).min(axis=1, initial=len(near)))
        after = np.minimum(after, after[after])
        if (after == labels).all():
            return labels
        labels = after


def _shared(values: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets have in common; sets are incidence rows, a bounded number of columns at a time."""
    size = np.array([len(v) for v in values])
    _, at, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(values)), size), n > 1
    column, keep = np.cumsum(often) - 1, often[at]
    row, at = row[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at, out = row[order], at[order], np.zeros((len(values), len(values)), np.float32)
    for first in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(at, [first, first + COLUMNS])
        grid = np.zeros((len(values), COLUMNS), np.float32)
        grid[row[lo:hi], at[lo:hi] - first] = 1
        out += grid @ grid.T
    return out


def _close(values: list[np.ndarray], percent: int) -> np.ndarray:
    """Which full sets have 100 * shared >= percent * union."""
    size, shared = np.array([len(v) for v in values], np.float64), _shared(values).astype(np.float64)
    return 100 * shared >= percent * (size[:, None] + size[None, :] - shared)


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity by the KEPT least values of each two sketches' union; rows are padded with END."""
    merged = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = (merged[:, 1:] == merged[:, :-1]) & (merged[:, 1:] != END)
    rank = np.cumsum(np.concatenate([np.ones((len(a), 1), bool), ~again], axis=1) & (merged != END), axis=1)
    return np.count_nonzero(again & (rank[:, 1:] <= KEPT), axis=1) / np.minimum(rank[:, -1], KEPT)


def _maybe_close(values: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sketches don't speak against ``percent``, up to connectedness.

    The overlap bounds the estimate from both sides. Pairs whose lower bound passes connect at once; the estimate itself
    is taken only of pairs that this leaves apart.
    """
    size, c = np.array([len(v) for v in values]), _shared(values)
    union = size[:, None] + size[None, :] - c
    seen = np.minimum(union, KEPT)
    need = percent / 100 - SLACK
    sure, may = c - (union - seen) >= need * seen, c >= need * seen
    label = _labels(sure)
    rest = np.argwhere(np.triu(may & (label[:, None] != label[None, :]), 1))
    if len(rest):
        padded = np.full((len(values), KEPT), END, np.int64)
        for k, v in enumerate(values):
            padded[k, : len(v)] = v
        for at in range(0, len(rest), 8192):
            i, j = rest[at : at + 8192].T
            sure[i, j] = sure[j, i] = _estimates(padded[i], padded[j]) >= need
    return sure


def _told(met: DataFrame, payloads: DataFrame, test, percent: int) -> DataFrame:
    """``a, b, whole``: edges that connect what pairs passing ``test`` connect in each group of ``met (key, i, j, nb, fp, root)``, and no more.

    Edges lead between the members' roots, to the least of a component; ``whole`` says that a group was all of its key.
    """

    def run(t: pa.Table) -> pa.Table:
        near = test([np.frombuffer(x.as_buffer(), np.int64) for x in t["payload"]], percent)
        roots, label = t["root"].to_pylist(), _labels(near).tolist()
        least = dict(sorted(zip(label, roots, strict=True), reverse=True))
        edges = sorted({(r, least[k]) for r, k in zip(roots, label, strict=True) if r != least[k]})
        whole = t["nb"][0].as_py() == 1
        return pa.table({"a": pa.array([a for a, _ in edges], pa.binary()), "b": pa.array([b for _, b in edges], pa.binary()), "whole": pa.array([whole] * len(edges), pa.bool_())})

    grouped = met.join(payloads, "fp").select("key", "i", "j", "nb", "root", "payload").groupBy("key", "i", "j")
    return grouped.applyInArrow(run, "a binary, b binary, whole boolean")


def _blocks(n: str, size: str) -> Column:
    return F.expr(f"greatest(({n} + {BLOCK - 1}) div {BLOCK}, ({size} + {BLOCK_BYTES - 1}) div {BLOCK_BYTES})")


def _with_pivots(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Groups of ``entries (key, fp, size)``: of one block whole, of larger ones each block with the pivots, block 0."""
    dealt = entries.join(sizes, "key").withColumn("mine", F.expr("pmod(xxhash64(fp), nb)"))
    one = F.lit(1).cast("long")
    others = F.when((F.col("mine") == 0) & (F.col("nb") > 1), F.sequence(one, F.greatest(F.col("nb") - 1, one))).otherwise(F.array("mine"))
    return dealt.withColumn("j", F.explode(others)).select("key", F.lit(0).cast("long").alias("i"), "j", "nb", "fp", F.col("fp").alias("root"))


def _with_all(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Groups of ``entries (key, fp, size, root)``: blocks of members outside the largest root of a key meet all its blocks."""
    long = lambda v: F.lit(v).cast("long")
    dealt, rest = entries.join(sizes, "key"), F.col("root") != F.col("top")
    mine = F.when(F.col("nb") == 1, long(0)).when(rest, F.expr("pmod(xxhash64(fp), nr)")).otherwise(F.expr("nr + pmod(xxhash64(fp), nc)"))
    others = F.when(F.col("nb") == 1, F.array(long(0))).when(rest, F.sequence(long(0), F.expr("nr + nc - 1"))).otherwise(F.sequence(long(0), F.greatest(F.col("nr") - 1, long(0))))
    met = dealt.withColumn("mine", mine).withColumn("other", F.explode(others))
    return met.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "nb", "fp", "root")


def _rooted(pairs: DataFrame) -> DataFrame:
    """``node, root`` with a row for each root beside those of the other members."""
    members = pairs.where("node <> root")
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())


def _hang_together(entries: DataFrame, payloads: DataFrame, test, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """``node, root``: what pairs of ``payloads (fp, payload)`` that pass ``test`` connect inside the groups of ``entries (key, fp, size, first)``.

    A class has one ``first`` entry. Groups of these meet pivots; after that, groups whose members don't hang together yet
    are opened whole. Tables by key are written before they are joined, so that the engine sees their size and, where it
    has to shuffle them, splits a hot key's rows.
    """
    first = entries.where("first")
    sizes = first.groupBy("key").agg(F.count("*").alias("m"), F.sum("size").alias("bytes")).where("m > 1").select("key", _blocks("m", "bytes").alias("nb"))
    sizes = scratch.write(sizes, f"{name}-sizes")
    edges = scratch.write(_told(_with_pivots(first, sizes), payloads, test, percent), f"{name}-edges")
    some = edges.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if not sizes.where("nb > 1").isEmpty():
        some = some.unionByName(components(edges.where(~F.col("whole")), scratch, f"{name}-some"))
    rooted = entries.join(some.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", "fp", "size", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.write(rooted, f"{name}-rooted")
    per = rooted.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"), F.bool_and("first").alias("first"))
    per = per.groupBy("key").agg(F.sum("m").alias("m"), F.sum("bytes").alias("bytes"), F.max(F.struct("m", "bytes", "root")).alias("t"), F.count("*").alias("roots"), F.bool_and("first").alias("first"))
    apart = per.select("key", F.col("t.root").alias("top"), _blocks("m", "bytes").alias("nb"), _blocks("(m - t.m)", "(bytes - t.bytes)").alias("nr"), _blocks("t.m", "t.bytes").alias("nc"), "roots", "first")
    # a group that was one block of first entries has been told whole
    apart = scratch.write(apart.where("roots > 1 and not (first and nb = 1)").drop("roots", "first"), f"{name}-apart")
    if apart.isEmpty():
        return scratch.write(_rooted(some), f"{name}-whole")
    more = _told(_with_all(rooted.select("key", "fp", "size", "root"), apart), payloads, test, percent)
    more = components(more, scratch, f"{name}-more").select(F.col("node").alias("root"), F.col("root").alias("over"))
    joined = some.where("node <> root").join(more, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    return scratch.write(_rooted(joined.unionByName(more.select(F.col("root").alias("node"), F.col("over").alias("root")))), f"{name}-whole")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, exact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    ``docs`` links where ``100 * shared >= percent * union`` of the sets of ``width``-word shingles, lower-cased in A-Z.
    Texts of fewer words are one shingle. A null or empty text, or one without words, has an empty set, is linked with
    nothing and is kept. ``component_id`` is the least ``doc_id`` of the component (nulls don't count; null if all are
    null, and then the rows are kept). Rows that repeat a ``doc_id`` are judged each by its text; those that hold the
    component's least id are all kept. Texts of any length count whole. An empty table gives an empty result. Other
    columns of ``docs`` are not read. ``exact`` spares the chance named above at the price of whole sets for sketches, which
    travel once for each list that is opened: it is meant for texts of some thousand words.
    """
    return _decided(docs, width, percent, id_col, text_col, exact).drop("mark", "first")


def _decided(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """What ``near_duplicates`` tells, with the ``mark`` of each row's text and the least one, ``first``, of its component (null without words)."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.write(sketches(docs, width, id_col, text_col, None if exact else KEPT), "rows")
    classes = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("mark").alias("mark"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.write(classes, "classes")
    rows = scratch.write(rows.select("doc_id", "mark", "n_shingles", "fp"), "slim")
    scratch.drop("rows")

    listed = _lists(classes, scratch, percent, exact).withColumnRenamed("value", "key")
    if exact:
        listed = listed.join(classes.select("fp", (8 * F.col("n")).alias("size")), "fp")
    else:
        listed = listed.withColumn("size", F.lit(8 * KEPT).cast("long"))
    loose = _hang_together(listed, classes.select("fp", F.col("sketch").alias("payload")), _close if exact else _maybe_close, percent, scratch, "loose")
    scratch.drop("lists")
    roots = loose if exact else _linked(docs, classes, loose, width, percent, id_col, text_col, scratch)

    told = classes.select("fp", "rep", "mark").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", "mark", F.coalesce("root", "fp").alias("root"))
    told = scratch.write(told, "told")
    least = scratch.write(told.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("mark").alias("first")), "least")
    known = scratch.write(told.join(least, "root").select("fp", "component_id", "first"), "known")
    scratch.drop("classes", "told", "least", *(f"{a}-{b}" for a in ("loose", "links") for b in ("sizes", "edges", "rooted", "apart", "whole")))
    out = rows.join(known, "fp", "left").select("doc_id", "mark", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "first")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _linked(docs: DataFrame, classes: DataFrame, loose: DataFrame, width: int, percent: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """``node, root`` of the components inside the loose clusters, by full sets."""
    inside = scratch.write(classes.select("fp", "rep", "n").join(loose.withColumnRenamed("node", "fp"), "fp"), "inside")
    full = scratch.write(_full_sets(docs, inside.select("fp", "rep"), width, id_col, text_col), "full")
    clusters = inside.select(F.col("root").alias("key"), "fp", (8 * F.col("n")).alias("size"), F.lit(True).alias("first"))
    out = _hang_together(clusters, full.withColumnRenamed("full", "payload"), _close, percent, scratch, "links")
    scratch.drop("inside", "full")
    return out


def deduplicated(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those that another row of their component stands for.

    Rows that share an id are judged each by its text; odd rows as in ``near_duplicates``. Of a component without any id one
    row stays, of the text with the least hash; texts without words all stay.
    """
    decided = _decided(docs.select("doc_id", "text"), width, percent)
    again = ~F.col("kept") | (F.col("component_id").isNull() & (F.col("mark") != F.col("first")))
    rest = without_rows(docs, decided.where(again).select("doc_id", "mark"))
    # copies without ids are alike in all that tells rows apart; the scan for them skips groups of rows that all have ids
    alike, name = docs["doc_id"].isNull() & docs["text"].rlike(r"[^\x20\x09-\x0D]"), unused(docs, "_mark")
    one = rest.where(alike).withColumn(name, F.xxhash64(F.col("text").cast("string"))).dropDuplicates([name]).drop(name)
    return rest.where(~F.coalesce(alike, F.lit(False))).unionByName(one)


#: DuckDB SQL for near_duplicates with four-word shingles: all pairs that share a shingle, and what links reach.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, y FROM reach JOIN link ON x = t)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id, d.doc_id IS NOT DISTINCT FROM min(o.doc_id) AS kept
FROM d LEFT JOIN n USING (r) JOIN reach USING (r) JOIN d o ON o.r = t GROUP BY d.r, d.doc_id, n
"""
