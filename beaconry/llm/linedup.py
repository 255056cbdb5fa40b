"""Line deduplication by pairwise alignment.

Documents overlap where they share stretches: successive lines, as few as hold LEAST_WORDS words. Any longer passage is a
union of stretches. Each stretch of a document points to the earliest document that holds it, so a stretch shared by m
documents gives m - 1 pairs, not m * m, and every passage is aligned with documents that hold all of it. A patience diff
aligns the pair, and aligned blocks of at least LEAST_WORDS words go from the later document; so do shared stretches that
the alignment leaves, such as moved ones.

Only hashes of lines travel; texts meet their deletions once, at the end. A stretch that very many documents hold is a hot
key whose owner is broadcast. The followers of an owner are dealt into groups of bounded size, and each group gets the
owner's lines once; of a follower it gets the lines between the first and the last stretch that points to the owner.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, as_bytes, joined_by_key, let

#: Words of a block of aligned lines that make it a repeated passage.
LEAST_WORDS = 8
#: Followers, and lines of all of them, in a group that meets an owner.
GROUP, GROUP_LINES = 500, 50_000


def hashed_lines(text: bytes | None) -> Iterator[tuple[int, bytes, int]]:
    """``place, hash, words`` of the lines with a word; white space around and between words doesn't count."""
    for place, line in enumerate((text or b"").split(b"\n")):
        if words := line.split():
            yield place, xxhash.xxh3_128_digest(b" ".join(words)), len(words)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by the first, whose seconds rise."""
    tops, top_of, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(top_of[at - 1] if at else -1)
        tops[at : at + 1], top_of[at : at + 1] = [j], [k]
    out, k = [], top_of[-1] if top_of else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two sequences, rising in both.

    Elements that occur once in both stretches anchor the alignment; stretches between anchors are aligned alike, after
    their common ends. A stretch without such elements anchors the n-th occurrence of an element on the n-th.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        many_a, many_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        at = {b[k]: k for k in range(j, j_end) if many_b[b[k]] == 1}
        anchors = [(k, at[a[k]]) for k in range(i, i_end) if many_a[a[k]] == 1 and a[k] in at]
        if not anchors:
            seen, at = Counter(), {}
            for k in range(j, j_end):
                at[b[k], seen[b[k]]] = k
                seen[b[k]] += 1
            seen, anchors = Counter(), []
            for k in range(i, i_end):
                if (a[k], seen[a[k]]) in at:
                    anchors.append((k, at[a[k], seen[a[k]]]))
                seen[a[k]] += 1
        anchors = _rising(anchors)
        out += anchors
        edges = [(i - 1, j - 1), *anchors, (i_end, j_end)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)] if anchors else []
    return sorted(out)


def stretches(words: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """``first, end`` (exclusive) of the shortest stretches of at least ``least`` words from each line and up to each line."""

    def up_to_each(words: list[int]) -> Iterator[tuple[int, int]]:
        first, total = 0, 0
        for end, n in enumerate(words, 1):
            total += n
            while total - words[first] >= max(least, 1):
                total, first = total - words[first], first + 1
            if total >= least:
                yield first, end

    n = len(words)
    return sorted({*up_to_each(words), *((n - end, n - first) for first, end in up_to_each(words[::-1]))})


def common_places(early: list[bytes], late: list[bytes], words: list[int], least: int = LEAST_WORDS) -> list[int]:
    """Indices of ``late`` in blocks, successive in both, of at least ``least`` words: aligned ones, then all that are left."""
    out, block, last = [], [], None
    for i, j in [*patience(early, late), (None, None)]:
        if block and (i is None or (i - 1, j - 1) != last):
            if sum(words[k] for k in block) >= least:
                out += block
            block = []
        block, last = [*block, j], (i, j)
    found = set(out)
    left = [(i, j) for i, j in stretches(words, least) if not found.issuperset(range(i, j))] if len(found) < len(late) else []
    there = set(early)
    if left := [(i, j) for i, j in left if there.issuperset(late[i:j])]:
        size = dict(zip(late, words, strict=True))
        held = {b"".join(early[i:j]) for i, j in stretches([size.get(x, least) for x in early], least)}
        found.update(k for i, j in left if b"".join(late[i:j]) in held for k in range(i, j))
    return sorted(found)


def repeated_lines(docs: DataFrame, *, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, places``: for each document that loses lines, their sorted places; ``mark`` is the text's hash.

    A document is a row's id and text: equal rows are one document, rows that share an id but not the text are several.
    They are ordered by id, null last, then by ``mark``. Lines are found in the whole text, however long.
    """
    scratch = Scratch(docs.sparkSession, "lines")

    def make():
        def rows(doc_id: int | None, mark: int, text: bytes | None) -> Iterator[tuple]:
            if found := list(hashed_lines(text)):
                places, lines, words = map(list, zip(*found, strict=True))
                held: dict[bytes, tuple[int, int]] = {}
                for i, j in stretches(words, least):
                    name = xxhash.xxh3_128_digest(b"".join(lines[i:j]))
                    first, end = held.get(name, (i, j))
                    held[name] = min(i, first), max(j, end)
                yield doc_id, mark, places, lines, words, [(name, i, j) for name, (i, j) in held.items()]

        return rows

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), as_bytes(text_col).alias("text"))
    lined = arrow_rows(slim, "doc_id long, mark long, places array<long>, lines array<binary>, words array<long>, stretches array<struct<stretch: binary, i: int, j: int>>", make)
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    lined = scratch.write(lined.withColumn("doc", key).drop("doc_id", "mark"), "lines")

    long = lined.select("doc", F.inline("stretches"))
    shared = scratch.write(long.groupBy("stretch").agg(F.min("doc").alias("owner"), F.count("*").alias("df")).where("df > 1"), "shared")
    total = lined.agg(F.sum(F.size("stretches"))).first()[0] or 0
    met = joined_by_key(long, shared, "stretch", "df", total).where(F.col("doc") > F.col("owner"))
    pairs = scratch.write(met.groupBy("doc", "owner").agg(F.min("i").alias("i"), F.max("j").alias("j")), "pairs")
    owners = scratch.write(pairs.groupBy("owner").agg(F.count("*").alias("many"), F.expr(f"greatest((count(*) + {GROUP - 1}) div {GROUP}, (sum(j - i) + {GROUP_LINES - 1}) div {GROUP_LINES})").alias("groups")), "owners")
    dealt = joined_by_key(pairs, owners, "owner", "many", pairs.count())

    one = lined.dropDuplicates(["doc"])
    cut = lambda c: F.slice(c, F.col("i") + 1, F.col("j") - F.col("i")).alias(c)
    part = F.pmod(F.xxhash64("doc"), F.col("groups")).alias("part")
    late = dealt.join(one.select("doc", "places", "lines", "words"), "doc").select("owner", part, F.col("doc.doc_id").alias("doc_id"), F.col("doc.mark").alias("mark"), *map(cut, ("places", "lines", "words")))
    early = owners.join(one.select(F.col("doc").alias("owner"), F.col("lines").alias("early")), "owner").select("owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), "early")

    def align(early: pa.Table, late: pa.Table) -> pa.Table:
        out, lines = [], early["early"][0].as_py() if early.num_rows else []
        for doc_id, mark, places, own, words in zip(*(late[c].to_pylist() for c in ("doc_id", "mark", "places", "lines", "words")), strict=True):
            if found := common_places(lines, own, words, least):
                out.append((doc_id, mark, [places[k] for k in found]))
        kinds = (("doc_id", pa.int64()), ("mark", pa.int64()), ("places", pa.list_(pa.int64())))
        return pa.table({name: pa.array([row[k] for row in out], kind) for k, (name, kind) in enumerate(kinds)})

    gone = early.groupBy("owner", "part").cogroup(late.groupBy("owner", "part")).applyInArrow(align, "doc_id long, mark long, places array<long>")
    return gone.groupBy("doc_id", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))


def _without(lines: Column, places: Column) -> Column:
    """``lines`` without those at sorted ``places``, as the stretches between them."""

    def rest(held: Column) -> Column:
        first = lambda k: F.when(k == 0, 0).otherwise(F.get(places, k - 1).cast("int") + 1)
        end = lambda k: F.coalesce(F.get(places, k).cast("int"), F.size(held))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), lambda k: F.slice(held, first(k) + 1, end(k) - first(k))))

    return let(lines, rest)


def without_repeated_lines(docs: DataFrame, *, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_deleted`` for each row of ``docs``: its text without passages of earlier documents.

    Null texts stay null, empty ones empty, and both lose nothing; equal rows lose the same lines, and none to each other.
    Of several earlier documents with a passage the least id counts. A text of which every line goes becomes empty. An
    empty table gives an empty result. Other columns are not read.
    """
    gone = repeated_lines(docs, least=least, id_col=id_col, text_col=text_col).withColumnRenamed("doc_id", "_id")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("_mark", F.xxhash64("text"))
    both = slim.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("mark")), "left")
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(_without(F.split("text", "\n", -1), F.col("places")), "\n"))
    return both.select("doc_id", text.alias("text"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_deleted"))
