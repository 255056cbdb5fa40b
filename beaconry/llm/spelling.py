r"""Spelling variants: words that differ by one edit, found by bands of letter-parity masks.

1. A word's mask has a bit for each letter, which tells whether the letter occurs an odd number of times. One edit flips at
   most two bits: a replacement two or none, an insertion or deletion just one.
2. The bits are dealt into three bands. Two near words of equal length agree in a band, as two bits spoil at most two; near
   words of unlike lengths agree in the first or the second band, as one bit spoils at most one.
3. Words meet where a band is equal, the lengths fit, and half of the word: one edit leaves the first or the last half as
   it is. The halves keep groups small whatever the number of words; masks alone have too few values for that.
4. In a group, masks that differ in more than two bits part, and the rest is verified letter by letter. A pair counts in
   the first band and the first half that it shares, once.

A group of more than BLOCK words is dealt into blocks, each two of which meet in a task, so none holds more than two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .resampling import CRC_TABLE, crc_sql

#: Words: letters of a run, the least length of a word, the least number of its occurrences, one of how many runs that lose
#: a letter, and how many times as frequent a form is.
RUN, LEAST, TWICE, LOSES, TIMES = r"[A-Za-zÀ-ÿ]+", 7, 2, 31, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block, bands, bits of a mask, and letters up to which words are compared as rows of one matrix.
BLOCK, BANDS, BITS, WIDE = 2048, 3, 63, 48
#: Rows that a task compares at a time.
ROWS = 20_000


def counted_words(docs: DataFrame, *, least: int = LEAST, twice: int = TWICE, loses: int | None = LOSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: lower-cased runs of letters of at least ``least`` code points that occur at least ``twice``.

    A run whose CRC-32 with its document's id is divisible by ``loses`` loses a letter; ``None`` takes texts as they are.
    """
    doc_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = F.filter(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0)), lambda w: F.length(w) >= least)
    each = docs.select(doc_id.alias("doc_id"), F.explode(runs).alias("run"))
    # lower() would take A to Z alone only where no other capital stands
    low = F.when(F.col("run").rlike(r"[À-Þ]"), F.translate("run", UPPER, LOWER)).otherwise(F.lower("run"))
    each = each.select("doc_id", low.alias("word"))
    if loses:
        h, size = F.crc32(F.concat_ws(":", "doc_id", "word").cast("binary")), F.length("word")
        at = (h % size).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, size))
        each = each.select(F.when(h % loses == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least)
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def mask_of(word: Column) -> Column:
    """The letter-parity mask: a to z have a bit each, letters beyond ASCII share the others."""
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c))
    bit = lambda c: F.when(c < 128, c - 97).otherwise(26 + c % (BITS - 26))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))))


def band_bits(band: int) -> int:
    """Bits dealt in turn, so that frequent letters fall in all bands."""
    return sum(1 << k for k in range(band, BITS, BANDS))


def _entries(words: DataFrame) -> DataFrame:
    """``key, kind, long, word, n`` for each band and half by which a word meets others.

    A word meets those of its own length, and as the longer one those a letter shorter; halves are those of the shorter.
    """
    size, told = F.col("_size"), []
    for band in range(BANDS):
        part = F.col("_mask").bitwiseAND(F.lit(band_bits(band)))
        for longer in (False, True) if band < BANDS - 1 else (False,):
            short = size - int(longer)
            half = F.expr(f"(_size - {int(longer)}) div 2").cast("int")
            for last in (False, True):
                piece = F.substring(F.col("word"), half + 1 + int(longer), size) if last else F.substring(F.col("word"), F.lit(1), half)
                kind = 2 * band + int(last)
                told.append(F.struct(F.xxhash64(F.lit(kind), part, short, piece).alias("key"), F.lit(kind).cast("byte").alias("kind"), F.lit(longer).alias("long")))
    known = words.withColumn("_size", F.length("word").cast("int")).withColumn("_mask", mask_of(F.col("word")))
    return known.select("word", "n", F.explode(F.array(*told)).alias("e")).select("e.key", "e.kind", "e.long", "word", "n")


def _masks(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The masks of rows of letters, padded on the right."""
    bit = np.where(letters < 128, letters - 97, 26 + letters % (BITS - 26)).astype(np.uint64)
    inside = np.arange(letters.shape[1])[None, :] < size[:, None]
    return np.bitwise_xor.reduce(np.where(inside, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), axis=1, initial=np.uint64(0))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two words of single-byte letters differ by one inserted, deleted or replaced letter."""
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


class _Group:
    """Rows sorted by group, and the pairs of near words among them."""

    def __init__(self, key: np.ndarray, kind: np.ndarray, longer: np.ndarray, side: np.ndarray, words: list[bytes], n: np.ndarray) -> None:
        self.key, self.kind, self.longer, self.side, self.words, self.n = key, kind, longer, side, words, n
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(min(WIDE, self.size.max(initial=1)))
        self.left = np.zeros((len(words), width), np.uint8)
        flat = np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in words), np.uint8)
        self.left[:] = flat.reshape(len(words), width)
        self.right = np.frombuffer(b"".join(w[-width:].rjust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        self.mask = _masks(self.left.astype(np.int64), np.minimum(self.size, width))
        for k in np.flatnonzero(self.size > width).tolist():
            self.mask[k] = _masks(np.frombuffer(words[k], np.uint8).astype(np.int64)[None, :], self.size[k : k + 1])[0]
        self.bands = np.array([band_bits(b) for b in range(BANDS)], np.uint64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the near pairs that count here."""
        out_a, out_b = [], []
        at, step = np.arange(len(self.key)), 1
        while len(at := at[at + step < len(self.key)]) and len(at := at[self.key[at] == self.key[at + step]]):
            a, b = at, at + step
            # two longer words meet elsewhere, as words of equal length; two of one of two blocks where it is alone
            fit = ~(self.longer[a] & self.longer[b]) & ((self.side[a] != self.side[b]) | (self.side[a] == 0))
            fit &= (self.kind[a] == self.kind[b]) & (np.abs(self.size[a] - self.size[b]) <= 1)
            a, b = a[fit], b[fit]
            near = np.bitwise_count(self.mask[a] ^ self.mask[b]) <= 2
            a, b = self._first_shared(a[near], b[near])
            keep = self._verified(a, b)
            out_a.append(a[keep])
            out_b.append(b[keep])
            step += 1
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _first_shared(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose first common band, and first common half, are those of their group."""
        apart = (self.mask[a] ^ self.mask[b])[:, None] & self.bands[None, :]
        keep = (apart == 0).argmax(axis=1) == self.kind[a] >> 1
        keep &= (apart == 0).any(axis=1) & ((self.size[a] == self.size[b]) == ~(self.longer[a] | self.longer[b]))
        a, b = a[keep], b[keep]
        half = np.minimum(self.size[a], self.size[b]) // 2
        width = self.left.shape[1]
        first = ((self.left[a] == self.left[b]) | (np.arange(width)[None, :] >= half[:, None])).all(axis=1)
        for k in np.flatnonzero(half > width).tolist():
            first[k] = self.words[a[k]][: half[k]] == self.words[b[k]][: half[k]]
        keep = first == (self.kind[a] % 2 == 0)
        return a[keep], b[keep]

    def _verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        width, small = self.left.shape[1], np.minimum(self.size[a], self.size[b])
        same = self.left[a] == self.left[b]
        head = np.where(same.all(axis=1), width, same.argmin(axis=1))
        back = (self.right[a] == self.right[b])[:, ::-1]
        tail = np.where(back.all(axis=1), width, back.argmin(axis=1))
        even = self.size[a] == self.size[b]
        keep = np.where(even, np.count_nonzero(~same, axis=1) == 1, np.minimum(head, small) + np.minimum(tail, small) >= small)
        for k in np.flatnonzero(np.maximum(self.size[a], self.size[b]) > width).tolist():
            keep[k] = one_edit(self.words[a[k]], self.words[b[k]])
        return keep


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n_near, form, form_n`` of what each row's near words of its groups tell; rows are sorted by group."""

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words = [w.encode("latin-1") for w in rows["word"].to_pylist()]
        n = rows["n"].to_numpy()
        held = _Group(rows["key"].to_numpy(), rows["kind"].to_numpy(), rows["long"].to_numpy(), rows["side"].to_numpy(), words, n)
        a, b = held.pairs()
        if not len(a):
            return
        mine, other = np.concatenate([a, b]), np.concatenate([b, a])
        order = sorted(range(len(mine)), key=lambda k: (mine[k], -n[other[k]], words[other[k]]))
        mine, other = mine[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        many = np.diff(np.concatenate([first, [len(mine)]]))
        show = lambda at: pa.array([words[k].decode("latin-1") for k in at.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([show(mine[first]), pa.array(many.astype(np.int64)), show(other[first]), pa.array(n[other[first]])], names=["word", "n_near", "form", "form_n"])

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        if sum(b.num_rows for b in rest) < ROWS:
            continue
        rows = pa.Table.from_batches(rest)
        key = rows["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))  # the last group may go on in the next batch
        if cut:
            yield from told(rows.slice(0, cut))
            rest = rows.slice(cut).combine_chunks().to_batches()
    if rest:
        yield from told(pa.Table.from_batches(rest))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, n_near, form, form_n`` of each of ``words (word, n)`` with near words; the form is the most frequent, ties to the least."""
    entries = _entries(words)
    sizes = entries.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    large = scratch.write(sizes.select("key", F.expr(f"(m + {BLOCK - 1}) div {BLOCK}").alias("nb")), "large")
    columns = ("key", "kind", "long", "side", "word", "n")
    met = entries.withColumn("side", F.lit(0).cast("byte")).select(*columns)
    if not large.isEmpty():
        both = entries.join(large, "key", "left").withColumn("mine", F.expr("pmod(xxhash64(word), nb)"))
        dealt = both.where("nb is not null").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        # 0: alone with its block; 1 and 2: one of two blocks
        side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("byte")
        blocks = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
        met = both.where("nb is null").withColumn("side", F.lit(0).cast("byte")).select(*columns).unionByName(dealt.withColumn("side", side).withColumn("key", blocks).select(*columns))
    sorted_rows = met.repartition("key").sortWithinPartitions("key")
    found = sorted_rows.mapInArrow(_near, "word string, n_near long, form string, form_n long")
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), F.col("form"))).alias("f")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "f.form", "f.form_n")


def spelling_variants(docs: DataFrame, *, least: int = LEAST, twice: int = TWICE, loses: int | None = LOSES, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``counted_words``.

    ``n_near`` counts the words that differ by exactly one inserted, deleted or replaced code point. ``form`` is the most
    frequent of them, ties to the least in code-point order, if it is at least ``times`` as frequent; else it and its
    ``form_n`` are null. ``root`` follows forms to the last, and is the word itself without one. Null and empty texts have
    no words, a null id counts as an empty one. Texts and words of any length count whole, and repeated rows count each.
    Bytes that aren't UTF-8 part runs. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(counted_words(docs, least=least, twice=twice, loses=loses, id_col=id_col, text_col=text_col), "words")
    near = scratch.write(near_words(words, scratch), "near")
    scratch.drop("large")
    known = words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False)))
    forms = scratch.write(known.where("has").select("word", F.col("form").alias("root")), "roots-0")
    step = 0
    while True:  # a form is ``times`` as frequent, so chains are short, and each step halves what is left of them
        above = forms.select(F.col("word").alias("root"), F.col("root").alias("over"))
        if forms.join(above, "root", "left_semi").isEmpty():
            break
        step += 1
        forms = scratch.write(forms.join(above, "root", "left").select("word", F.coalesce("over", "root").alias("root")), f"roots-{step}")
        scratch.drop(f"roots-{step - 1}")
    told = known.join(forms, "word", "left")
    mine = lambda c: F.when(F.col("has"), F.col(c)).alias(c)
    return told.select("word", mine("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), mine("form_n"))


#: DuckDB SQL for spelling_variants, with the parameters' defaults: near words share what is left without one letter.
ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS w, count(*) AS c FROM runs WHERE length(run) >= {LEAST} GROUP BY 1, 2),
hashed AS (SELECT w, c, {crc_sql("(doc_id || ':' || w)")} AS h FROM low, crc_table),
cut AS (SELECT CASE WHEN h % {LOSES} = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST} GROUP BY 1 HAVING sum(c) >= {TWICE}),
gaps AS (SELECT DISTINCT word, n, i, word[:i] || word[i + 2:] AS g FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM words a JOIN gaps b ON a.word = b.g UNION SELECT b.word, a.word FROM words a JOIN gaps b ON a.word = b.g),
near AS (SELECT p.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS form, max(o.n) AS form_n FROM pairs p JOIN words o ON o.word = p.other GROUP BY 1),
known AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * n THEN form END AS form, CASE WHEN form_n >= {TIMES} * n THEN form_n END AS form_n FROM words LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS root FROM known UNION ALL SELECT c.word, k.form FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN last USING (word)
"""
