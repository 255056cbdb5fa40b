"""Byte-level BPE by dynamic programming over byte prefixes.

The encoding of a text's first ``n`` bytes ends in exactly one token, whatever follows. A token may end a prefix if it fits
behind the last token of what it leaves: if merging the bytes of the two gives just these two tokens. So one pass over a
piece stores each prefix's last token, and the ids are read backwards from it. Appending bytes leaves what is stored as it
is, and an edit leaves all prefixes before it.

A text is cut into pieces by the vocabulary's pattern first, and each piece is encoded on its own.
"""

from __future__ import annotations

import base64
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, valid_text
from .tokenized import PATTERN, Encoder

#: Pairs of tokens whose fit a Python worker remembers.
PAIRS = 300_000
#: Stretches, words and lines whose ids it remembers each, and rows that are decoded at a time.
REMEMBERED, ROWS = 250_000, 500
#: A character of each class of the pattern, which stands for one that Python's tables don't know.
STAND_INS = {"letter": "a", "number": "1", "other": "$"}


def ranks_of(file: bytes) -> dict[bytes, int]:
    """Tokens and their ranks from a rank file's lines ``base64 rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}


def tokens_of(ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens by rank."""
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class Merges:
    """A vocabulary as tables: each token's parts, and a trie of the tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks, self.tokens = ranks, tokens_of(ranks)
        self.size = size = len(self.tokens)
        #: When a token is made: single bytes are there from the start, merges follow by rank.
        self.made = [0] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[int, int] = {}
        self.remembered: dict[int, bool] = {}
        reachable = {rank for token, rank in ranks.items() if len(token) == 1}
        for token, rank in sorted(((t, r) for t, r in ranks.items() if len(t) > 1), key=lambda x: x[1]):
            self.made[rank] = rank + 1
            for at in range(1, len(token)):  # the last merge joins the two tokens that are left by the earlier ones
                a, b = ranks.get(token[:at]), ranks.get(token[at:])
                if a in reachable and b in reachable and a < rank > b and self._apart(a, b):
                    self.left[rank], self.right[rank], self.merged[a * size + b] = a, b, rank
                    reachable.add(rank)
                    break
        self.remembered.clear()
        self.longest = max(map(len, ranks))
        self.length = [len(t) for t in self.tokens]
        self._automaton(reachable)

    def _automaton(self, reachable: set[int]) -> None:
        """A trie of the tokens' bytes with failure links, which tells the longest token that ends at each byte of a text.

        ``step[node << 8 | byte]`` is the next node, ``fail[node]`` the node of its longest proper suffix in the trie,
        ``ends[node]`` the longest token that its bytes end in, and ``shorter[token]`` the next shorter one that the token
        ends in. A token that merging never reaches isn't told.
        """
        self.step: dict[int, int] = {}
        self.fail, self.ends, self.shorter = [0], [-1], [-1] * self.size
        level = {0: [t for t in self.ranks.items() if t[0]]}
        depth = 0
        while level:
            below: dict[int, list] = {}
            for node, held in level.items():
                by: dict[int, list] = {}
                for told in held:
                    by.setdefault(told[0][depth], []).append(told)
                for byte, rest in by.items():
                    back = self._next(self.fail[node], byte) if node else 0
                    child = self.step[node << 8 | byte] = len(self.fail)
                    own = next((rank for token, rank in rest if len(token) == depth + 1 and rank in reachable), -1)
                    if own >= 0:
                        self.shorter[own] = self.ends[back]
                    self.fail.append(back)
                    self.ends.append(own if own >= 0 else self.ends[back])
                    if longer := [t for t in rest if len(t[0]) > depth + 1]:
                        below[child] = longer
            level, depth = below, depth + 1

    def _next(self, node: int, byte: int) -> int:
        """The node of the longest suffix that is in the trie, one byte further."""
        while (after := self.step.get(node << 8 | byte)) is None:
            if not node:
                return 0
            node = self.fail[node]
        return after

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` side by side leaves these two tokens.

        Merges are undone, the later one first. If the parts at the border had merged before what was undone, merging
        would have gone another way. Of equal merges the one further left comes first.
        """
        made, left, right, size, below = self.made, self.left, self.right, self.size, self.size + 1
        while True:
            joined = self.merged.get(a * size + b)
            if joined is not None and joined < below:
                return False
            if made[a] > made[b]:
                below, a = a, right[a]
            elif made[b]:
                below, b = b + 1, left[b]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        key = a * self.size + b
        found = self.remembered.get(key)
        if found is None:
            if len(self.remembered) >= PAIRS:
                self.remembered.clear()
            found = self.remembered[key] = self._apart(a, b)
        return found

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """``last[n]``: the token that ends the first ``n`` bytes of ``piece``; ``known`` is such a list of a shorter prefix.

        The automaton tells the tokens that end at a byte, the longest first; the first one that fits behind the last token
        of what it leaves is the only one that does. What ``known`` says is kept. Time is linear in the bytes behind it.
        """
        last, done = [*known] if known else [-1], len(known) - 1 if known else 0
        step, fail, ends, shorter, length, size = self.step, self.fail, self.ends, self.shorter, self.length, self.size
        remembered, node = self.remembered, 0
        for byte in piece[max(0, done - self.longest) : done]:
            node = self._next(node, byte)
        for end, byte in enumerate(piece[done:], done + 1):
            while (after := step.get(node << 8 | byte)) is None and node:
                node = fail[node]
            node = after or 0
            token = ends[node]
            while start := end - length[token]:
                fit = remembered.get(last[start] * size + token)
                if fit or (fit is None and self.fits(last[start], token)):
                    break
                token = shorter[token]
            last.append(token)
        return last

    def ids(self, last: list[int]) -> list[int]:
        """The tokens of a piece from its ``last_tokens``."""
        out, at, tokens = [], len(last) - 1, self.tokens
        while at:
            out.append(last[at])
            at -= len(tokens[last[at]])
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token stays one, as rank-file encoders do."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.ids(self.last_tokens(piece))


class PrefixEncoder(Encoder):
    """Ids of texts by ``Merges``; each distinct piece is encoded once, words are looked up as in ``Encoder``."""

    most = REMEMBERED

    def __init__(self, file: bytes, pattern: str = PATTERN) -> None:
        """``file``: a rank file's bytes. ``pattern``: how texts are cut; only the default is looked up by words."""
        import regex

        self.merges = Merges(ranks_of(file))
        self.plain, self.special, self.dtype = pattern == PATTERN, [], np.dtype("<u4")
        self.cuts = regex.compile(pattern)
        self.find, self.pattern = self.cuts.findall, pattern
        self.alphabet, self.space = {}, " "  # pieces stay latin-1 here
        self.far = regex.compile(r"[^\x00-ɏ]").search
        self.classes: dict[str, str | None] = {}
        self._forget()

    def _cut(self, shown: str) -> bytes:
        return self._packed(self.merges.encode(shown.encode("latin-1")))

    def _class_of(self, c: str) -> str | None:
        """What stands for a character that Python's tables don't know, by the library's own tables; null for others."""
        if c not in self.classes:
            import tiktoken

            def joins(first: str) -> bool:
                whole = (first + c).encode()
                ranks = {bytes([b]): b for b in range(256)} | {whole[:k]: 254 + k for k in range(2, len(whole) + 1)}
                return len(tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(first + c)) == 1

            unknown = unicodedata.category(c) == "Cn"
            self.classes[c] = next((v for v in STAND_INS.values() if joins(v)), None) if unknown else None
        return self.classes[c]

    def shown(self, text: str) -> str:
        """``text`` as it is cut: characters newer than Python's tables are replaced by others of their class."""
        if not self.far(text):
            return text
        odd = {ord(c): new for c in set(text) if (new := self._class_of(c))}
        return text.translate(odd) if odd else text

    def pieces(self, text: str, at: int = 0) -> Iterator[tuple[int, int]]:
        """Where the pattern cuts ``text`` from ``at`` on, as start and end."""
        for m in self.cuts.finditer(self.shown(text), at):
            yield m.span()

    def _stretch(self, text: str) -> bytes:
        if (shown := self.shown(text)) is text:
            return b"".join(map(self._piece, self.find(text)))
        return b"".join(self._piece(text[a:z]) for a, z in self.pieces(text))

    def _entire(self, text: str) -> bytes:
        return self._stretch(text)


class Encoded:
    """A text, its pieces, and the last tokens of their prefixes, which appends and edits continue."""

    def __init__(self, coder: PrefixEncoder, text: str) -> None:
        self.coder, self.text, self.starts, self.lasts = coder, "", [], []
        #: Prefixes that the last change took over, and those that it computed.
        self.reused = self.computed = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), 0, more)

    def replace(self, at: int, removed: int, new: str) -> None:
        """Put ``new`` in place of ``removed`` characters from ``at`` on.

        A cut depends on two characters behind it at most, so the pattern starts again two pieces before the change, and
        stops where its cuts fall together with earlier ones behind it. In the pieces between, prefixes that a piece at
        the same place had before are taken over.
        """
        if not 0 <= at <= at + removed <= len(self.text):
            raise ValueError("the change lies outside the text")
        text = self.text[:at] + new + self.text[at + removed :]
        shift, merges = len(new) - removed, self.coder.merges
        first = max(0, bisect_right(self.starts, at) - 3)
        begin = self.starts[first] if first < len(self.starts) else 0
        starts, lasts, rest = [], [], len(self.starts)
        self.reused, self.computed = 0, 0
        for a, z in self.coder.pieces(text, begin):
            if a >= at + len(new):
                k = bisect_left(self.starts, a - shift)
                if k < len(self.starts) and self.starts[k] == a - shift and a - shift >= at + removed:
                    rest = k
                    break
            piece, known = text[a:z].encode(), None
            k = bisect_left(self.starts, a)
            if a <= at and k < len(self.starts) and self.starts[k] == a:
                old = self.text[a : self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)].encode()
                same = next((i for i, (x, y) in enumerate(zip(old, piece, strict=False)) if x != y), min(len(old), len(piece)))
                known = self.lasts[k][: same + 1]
            self.reused += len(known) - 1 if known else 0
            self.computed += len(piece) - (len(known) - 1 if known else 0)
            starts.append(a)
            lasts.append(merges.last_tokens(piece, known))
        tail = self.starts[rest:]
        self.reused += sum(len(x) - 1 for x in self.lasts[:first]) + sum(len(x) - 1 for x in self.lasts[rest:])
        self.starts = self.starts[:first] + starts + [s + shift for s in tail]
        self.lasts = self.lasts[:first] + lasts + self.lasts[rest:]
        self.text = text

    def ids(self) -> list[int]:
        merges, out = self.coder.merges, []
        ends = [*self.starts[1:], len(self.text)] if self.starts else []
        for a, z, last in zip(self.starts, ends, self.lasts, strict=True):
            whole = merges.ranks.get(self.text[a:z].encode()) if len(last) <= merges.longest + 1 else None
            out += [whole] if whole is not None else merges.ids(last)
        return out


def rank_file(path: str) -> bytes:
    return Path(path).read_bytes()


def _kept(docs: DataFrame, ranks: str, kind: str, make: Callable[[bytes], object]) -> Callable[[], object]:
    """A function that gives what a worker made of the vocabulary's file, which is broadcast: a few MB whatever the corpus."""
    file = rank_file(ranks)
    sent, key = docs.sparkSession.sparkContext.broadcast(file), zlib.crc32(file)
    return lambda: kept_in_worker((kind, key), lambda: make(sent.value))


def bpe_ids(docs: DataFrame, ranks: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for each row of ``docs``: the ids of the whole text as little-endian unsigned 32-bit integers.

    ``ranks`` is the path of a rank file on the driver. No text is special. A null or empty text has no ids; bytes that
    aren't UTF-8 are read as U+FFFD. Texts of any length are encoded whole. Every row counts by itself, so repeated rows
    give equal rows, and null ids stay null. An empty table gives an empty result. Other columns are not read.
    """
    coder = _kept(docs, ranks, "prefix encoder", PrefixEncoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(coder().encode_all(part.column(1))), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), valid_text(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def bpe_texts(encoded: DataFrame, ranks: str, *, ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the bytes that ids of ``bpe_ids`` stand for; null ids give null bytes."""
    tokens = _kept(encoded, ranks, "tokens", lambda file: tokens_of(ranks_of(file)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens().__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column(part.schema.get_field_index(ids_col))
                texts = [b"".join(map(token, np.frombuffer(x.as_buffer(), "<u4").tolist())) if x.is_valid else None for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    if "decoded" in {c.lower() for c in encoded.columns}:
        raise ValueError("there is a column decoded already")
    return encoded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded binary")


def re_encoded(docs: DataFrame, edits: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, text, ids, n_reused, n_computed`` of each row of ``docs (doc_id, text)`` after its edits.

    ``edits (doc_id, seq, at, removed, inserted)`` are applied by ``seq``, those of one document in turn: ``removed``
    characters from ``at`` on give way to ``inserted`` (null: nothing); an append has the text's length as ``at`` or a null
    one. Only pieces near a change are encoded again; ``n_reused`` and ``n_computed`` count the bytes' prefixes that the
    changes kept and computed. Documents without edits are encoded as they are, edits of unknown documents and of null ids
    change nothing, and each row of a repeated id takes the edits. An edit outside its text is an error.
    """
    coder = _kept(docs, ranks, "prefix encoder", PrefixEncoder)
    told = F.struct("seq", "at", "removed", "inserted")
    listed = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(told)).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, changes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, reused, computed = Encoded(coder(), text or ""), 0, 0
                for x in changes or []:
                    held.replace(len(held.text) if x["at"] is None else x["at"], x["removed"] or 0, x["inserted"] or "")
                    reused, computed = reused + held.reused, computed + held.computed
                rows.append((doc_id, held.text, np.array(held.ids(), "<u4").tobytes(), reused, computed))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "text", "ids", "n_reused", "n_computed"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text("text").alias("text"))
    both = slim.join(listed, "doc_id", "left").select("doc_id", "text", "edits")
    return both.mapInArrow(run, "doc_id long, text string, ids binary, n_reused long, n_computed long")


def bpe_digests(docs: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, from ``bpe_ids`` and ``bpe_texts``; rows as in these."""
    both = bpe_texts(bpe_ids(docs, ranks), ranks)
    return both.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
