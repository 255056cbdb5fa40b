"""Benchmark decontamination: n-gram seeds join passages to test items, local alignment scores what they join.

One pass over the corpus finds every place where three successive words of a text are a seed of an item. Seeds are the
item's n-grams that are rare among the items: those that at most FAN items hold, and where these are fewer than half of its
n-grams, the rarest half. Which of them an edited copy keeps can't be told in advance, so no rare n-gram is left out; a
sentence that very many items share doesn't join a text that quotes it with all of them. Passages with a seed whose words
can reach the threshold in any order are aligned with the item by Smith-Waterman over words, which scores edited and
paraphrased copies too. A copy that keeps no three successive words of its item beside shared sentences isn't found.

Items are taken in blocks of bounded size, the shorter ones first, and only a block is broadcast; the corpus is read once
for each block. Items of more than PIECE words are searched by overlapping pieces, so that no item outgrows a block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes, marked, without_rows

#: Words of an n-gram, words of all items of a block, words of a piece of a long item, items that may share a seed.
WIDTH, BLOCK_WORDS, PIECE, FAN = 3, 500_000, 2_000, 64
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of the score of an exact copy, and least score as matching words, at most those of the item.
THRESHOLD, LEAST_WORDS = 0.5, 8
_marks = bytes(set(range(0x21, 0x7F)) - set(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


def plain_words(text: bytes | None) -> list[bytes]:
    """Words in lower case without ASCII punctuation; words of nothing else vanish."""
    return text.decode("utf-8", "replace").lower().encode().translate(None, _marks).split() if text else []


@dataclass(frozen=True)
class Items:
    """A block of test items: their words as numbers from 1, and their seeds, sorted.

    Items with seed ``g`` are ``holders[starts[g] : starts[g + 1]]``.
    """

    ids: list[int | None]
    words: list[np.ndarray]
    vocabulary: dict[bytes, int]
    grams: np.ndarray
    starts: np.ndarray
    holders: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, list[bytes]]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in item], np.int64) for _, item in rows]
        keys = rare([np.unique(keyed(w)) for w in words])
        grams, at = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_inverse=True)
        order = np.argsort(at, kind="stable")
        holders = np.repeat(np.arange(len(keys)), [len(k) for k in keys])[order]
        return cls([i for i, _ in rows], words, vocabulary, grams, np.searchsorted(at[order], np.arange(len(grams) + 1)), holders)


def rare(keys: list[np.ndarray], fan: int = FAN) -> list[np.ndarray]:
    """Of each item's distinct n-grams those that at most ``fan`` items hold, but no fewer than the rarest half of them."""
    _, at, many = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_inverse=True, return_counts=True)
    out, first = [], 0
    for k in keys:
        held = many[at[first : first + len(k)]]
        first += len(k)
        most = max(fan, int(np.sort(held)[(len(k) - 1) // 2])) if len(k) else fan
        out.append(k[held <= most])
    return out


def pieces(words: list[bytes]) -> Iterator[list[bytes]]:
    """An item, or a long one's stretches of PIECE words, each half over the one before."""
    yield words[:PIECE]
    for end in range(PIECE + PIECE // 2, len(words) + PIECE // 2, PIECE // 2):
        yield words[min(end, len(words)) - PIECE : end]


def keyed(words: np.ndarray) -> np.ndarray:
    """An exact key for each n-gram of word numbers under 2 ** 21; -1 where one is 0 (not an item's word)."""
    n = len(words) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.int64)
    parts = [words[k : k + n] for k in range(WIDTH)]
    out = parts[0].copy()
    for p in parts[1:]:
        out = (out << 21) | p
    out[np.logical_or.reduce([p == 0 for p in parts])] = -1
    return out


def passages(words: list[bytes], items: Items, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``start, numbers, places, n-grams``: stretches of a text with ``reach`` words around each place of an item's n-gram."""
    numbers = np.fromiter(map(items.vocabulary.get, words, repeat(0)), np.int64, len(words))
    keys = keyed(numbers)
    there = np.flatnonzero(keys >= 0)
    at = np.searchsorted(items.grams, keys[there])
    hit = at < len(items.grams)
    hit[hit] = items.grams[at[hit]] == keys[there[hit]]
    there, at = there[hit], at[hit]
    for group in np.split(np.arange(len(there)), np.flatnonzero(np.diff(there) > 2 * reach) + 1) if len(there) else []:
        lo, hi = max(0, int(there[group[0]]) - reach), int(there[group[-1]]) + WIDTH + reach
        yield lo, numbers[lo:hi], there[group], at[group]


def aligned(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Score of the best local alignment, and where it ends in ``text`` and ``item`` (exclusive)."""
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, (0, 0)
    slope = -GAP * np.arange(len(text) + 1)
    for k, word in enumerate(item.tolist()):
        diagonal = row[:-1] + np.where(text == word, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0)
        np.maximum(new[1:], diagonal, out=new[1:])
        row = np.maximum.accumulate(new + slope) - slope
        if (top := int(row.argmax())) and row[top] > best:
            best, end = int(row[top]), (top, k + 1)
    return best, *end


def best_span(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Score and span of the best local alignment in ``text``."""
    score, end, item_end = aligned(text, item)
    _, back, _ = aligned(text[:end][::-1], item[:item_end][::-1])
    return score, end - back, end


def in_common(text: np.ndarray, words: np.ndarray, many: np.ndarray) -> int:
    """How many of an item's ``words``, each as often as ``many`` says, are in ``text``, in any order: no alignment matches more."""
    text = np.sort(text)
    return int(np.minimum(many, np.searchsorted(text, words, "right") - np.searchsorted(text, words)).sum())


def _block(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    reach = 2 * max((len(w) for w in items.words), default=0)
    sent = docs.sparkSession.sparkContext.broadcast((items.ids, items.words, items.vocabulary, items.grams, items.starts, items.holders))  # at most BLOCK_WORDS words

    def align():
        items, bags = Items(*sent.value), {}

        def bag(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in bags:
                bags[k] = np.unique(items.words[k], return_counts=True)
            return bags[k]

        def found(start: int, text: np.ndarray, places: np.ndarray, grams: np.ndarray) -> Iterator[tuple]:
            by_item = defaultdict(list)
            for place, gram in zip((places - start).tolist(), grams.tolist(), strict=True):
                for k in items.holders[items.starts[gram] : items.starts[gram + 1]].tolist():
                    by_item[k].append(place)
            for k, at in sorted(by_item.items()):
                item, last = items.words[k], None
                n, cut = len(item), np.flatnonzero(np.diff(at) > 2 * len(item)) + 1
                enough = lambda score, n=n: score / (MATCH * n) >= threshold and score >= MATCH * min(LEAST_WORDS, n)
                for group in np.split(np.array(at), cut):
                    lo, hi = max(0, int(group[0]) - 2 * n), int(group[-1]) + WIDTH + 2 * n
                    if not enough(MATCH * in_common(text[lo:hi], *bag(k))):
                        continue
                    score, a, z = best_span(text[lo:hi], item)
                    if enough(score) and (last is None or score / (MATCH * n) > last[0]):
                        last = (score / (MATCH * n), start + lo + a, start + lo + z)
                if last:
                    yield items.ids[k], *last

        def rows(doc_id: int | None, mark: int, text: bytes | None) -> Iterator[tuple]:
            for passage in passages(plain_words(text), items, reach):
                for row in found(*passage):
                    yield doc_id, mark, *row

        return rows

    return arrow_rows(docs, "doc_id long, mark long, item_id long, score double, start_word long, end_word long", align)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word``: documents that hold a copy of a test item, exact or edited.

    ``score`` is the alignment's share of an exact copy's; a row appears per document, item and found passage, the first
    of equal ones. A piece of an item of more than PIECE words counts as an item with its id. Null and empty texts hold
    nothing; null, empty and shorter items than an n-gram match nothing; texts of any length are read whole. Repeated items
    and documents give a row each. Empty tables give an empty result. Other columns are not read.
    """
    return _leaks(docs, benchmark, threshold, id_col, text_col).drop("mark")


def _leaks(docs: DataFrame, benchmark: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``contaminated`` tells, with the ``mark`` of each document's text."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), marked(text_col).alias("mark"), as_bytes(text_col).alias("text"))
    block, size, out = [], 0, []

    def flush() -> None:
        nonlocal block, size
        out.append(_block(slim, Items.of(block), threshold))
        block, size = [], 0

    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), as_bytes("text").alias("text")).orderBy(F.length("text"), "item_id", "text").toLocalIterator():
        for words in pieces(plain_words(r["text"])):
            if len(words) < WIDTH:
                continue
            if block and size + len(words) > BLOCK_WORDS:
                flush()
            block.append((r["item_id"], words))
            size += len(words)
    if block or not out:
        flush()
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item; rows that share an id are judged each by its text."""
    return without_rows(docs, _leaks(docs, benchmark, threshold).select("doc_id", "mark"))
