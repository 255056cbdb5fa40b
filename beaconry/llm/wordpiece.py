"""Token counts by a longest-match automaton that is linear in the text.

The vocabulary is a trie with two roots: one for pieces that start a word, one for pieces inside a word. Where a node has
no child for the next byte, its failure link leads to the node that holds what is left after the greedy pieces up to here
are cut off, and its popped count says how many those are. So each byte is read once, no piece is built, and counts add up
to the length of the greedy longest-match word-piece sequence. A word that can't be cut into pieces counts as one token.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes, kept_in_worker, words_of
from .tokenized import byte_alphabet

#: Words whose counts a Python worker remembers, and the bytes from which it doesn't.
REMEMBERED, LONG = 800_000, 64
#: The two roots.
START, INSIDE, NONE = 0, 1, -1


class Automaton:
    def __init__(self, starting: Iterable[bytes], inside: Iterable[bytes]) -> None:
        self.next: dict[int, int] = {}
        self.fail, self.popped = [NONE, NONE], [0, 0]
        accepts, order = {}, [[] for _ in range(2)]
        for root, pieces in ((START, starting), (INSIDE, inside)):
            for piece in sorted(pieces):
                node = root
                for depth, byte in enumerate(piece):
                    child = self.next.get(node << 8 | byte)
                    if child is None:
                        child = self.next[node << 8 | byte] = len(self.fail)
                        self.fail.append(NONE)
                        self.popped.append(0)
                        while len(order) <= depth:
                            order.append([])
                        order[depth].append((node, byte, child))
                    node = child
                if piece:
                    accepts[node] = True
        for level in order:
            for parent, byte, node in level:
                if node in accepts:
                    self.fail[node], self.popped[node] = INSIDE, 1
                    continue
                at, popped = self.fail[parent], self.popped[parent]
                while at != NONE and (at << 8 | byte) not in self.next:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at != NONE:
                    self.fail[node], self.popped[node] = self.next[at << 8 | byte], popped

    def pieces(self, word: bytes) -> int:
        """How many pieces greedy longest match cuts ``word`` into; 1 where it can't."""
        step, fail, popped = self.next, self.fail, self.popped
        node, count = START, 0
        for byte in word:
            while (child := step.get(node << 8 | byte)) is None:
                if (at := fail[node]) == NONE:
                    return 1
                count += popped[node]
                node = at
            node = child
        while node > INSIDE:
            if fail[node] == NONE:
                return 1
            count += popped[node]
            node = fail[node]
        return count


class Counts(dict):
    """Pieces of words, each counted once while it is remembered."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        found = self.automaton.pieces(word)
        if len(word) < LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Starting and inner pieces of a byte-level vocabulary file: those behind a space start words, so do single bytes."""
    back = {c: b for b, c in byte_alphabet().items()}
    tokens = [bytes(back[c] for c in t) for t in json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"] if all(c in back for c in t)]
    starting = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1} | {t for t in tokens if len(t) == 1}
    return sorted(starting), sorted(t for t in tokens if t and not t[:1].isspace())


def token_counts(docs: DataFrame, pieces: tuple[list[bytes], list[bytes]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` for each row of ``docs``; null, empty and blank texts have none, long ones count whole.

    ``pieces`` are the starting and inner pieces, of which each executor gets a copy: a vocabulary, whatever the corpus.
    Repeated rows give equal rows, an empty table an empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    name = xxhash.xxh3_128_digest(b"".join(len(p).to_bytes(4, "little") + p for side in (*pieces[:1], [b""], *pieces[1:]) for p in side))

    def make():
        counts = kept_in_worker(("pieces", name), lambda: Counts(Automaton(*sent.value)))

        def rows(doc_id: int | None, text: bytes | None) -> Iterator[tuple]:
            words = words_of(text)
            yield doc_id, len(words), sum(map(counts.__getitem__, words))

        return rows

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return arrow_rows(slim, "doc_id long, n_words long, n_tokens long", make)
