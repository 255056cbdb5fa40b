"""Texts to token ids with the tokenizers library, spending its time once per distinct piece.

A byte-level BPE merges only inside the pieces that its pattern cuts. Where it cuts in any case is seen in the bytes: before
a space with something visible behind it, before a line break behind something visible, between a letter or digit and a
mark. Texts are cut there in NumPy, and Arrow looks the stretches up among those that were seen before. The library encodes
each new one; texts with a special token or with white space beside a space go to it whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches whose ids a Python worker remembers, parts of odd ones, and the bytes from which it doesn't.
REMEMBERED, PARTS, LONG = 250_000, 20_000, 64
#: Bytes of the texts whose stretches are looked up together.
STRETCH = 4 << 20
#: White space, and where a space has some beside it (one that ends a text: before it), as Arrow's patterns.
BLANK = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
AWKWARD = rf" {BLANK}|{BLANK} \z"
#: Kinds of bytes: letters and digits, marks but the apostrophe, which may begin a piece with letters, and what follows 0xC3 in letters.
ALNUM, MARK, APOSTROPHE, SPACE, BREAK, LATIN = range(1, 7)
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = [ALNUM if chr(b).isalnum() else APOSTROPHE if chr(b) == "'" else MARK for b in range(0x21, 0x7F)]
KINDS[0x80:0xC0] = [LATIN if chr(b + 0x40).isalpha() else 0 for b in range(0x80, 0xC0)]
KINDS[[0x20, 0x0A]] = SPACE, BREAK
#: The pattern by which a byte-level BPE of this family cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def as_text(texts: pa.Array) -> pa.Array:
    """Bytes as text; those that aren't UTF-8 become U+FFFD."""
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def _bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts and the last one ends, and the bytes of all."""
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return edges - edges[0], np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where stretches start in UTF-8 without awkward spaces: at ``starts`` and where the pattern cuts whatever else stands there."""
    kind = KINDS[data]
    letter = kind == ALNUM
    letter[1:] |= (kind[1:] == LATIN) & (data[:-1] == 0xC3)
    visible = letter | (kind == MARK) | (kind == APOSTROPHE)
    cut = kind == SPACE
    cut[1:] |= ((kind[1:] == MARK) & letter[:-1]) | ((kind[1:] == BREAK) & visible[:-1])
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts, as little-endian bytes of ``dtype``."""

    most = REMEMBERED

    def __init__(self, file: str) -> None:
        """``file``: the text of a tokenizers JSON file with a byte-level BPE."""
        import regex
        from tokenizers import Tokenizer

        self.all = Tokenizer.from_str(file)
        told = json.loads(file)
        cut = told["pre_tokenizer"]
        self.plain = told["model"]["type"] == "BPE" and told["normalizer"] is None and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        self.special = [x["content"] for x in told["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.all.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.alphabet = self.all.model, byte_alphabet()
        self.find = regex.compile(PATTERN).findall
        self.far = re.compile(r"[^\x00-ɏ]").search
        self.space = self.alphabet[0x20]
        width = self.dtype.itemsize
        self.each = [k.to_bytes(width, "little") for k in range(max(self.all.get_vocab(with_added_tokens=True).values(), default=0) + 1)]
        self._forget()

    def _forget(self) -> None:
        #: Parts of odd stretches by themselves; stretches, how many ids each has, and all these ids.
        self.known: dict[str, bytes] = {}
        self.words, self.sizes, self.flat = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, self.dtype)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _cut(self, shown: str) -> bytes:
        """Ids of a piece in the byte alphabet."""
        each = self.each
        return b"".join([each[x.id] for x in self.model.tokenize(shown)])

    def _shown(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.alphabet)

    def _piece(self, piece: str) -> bytes:
        """A piece as the pattern cuts it."""
        if (found := self.known.get(piece)) is None:
            found = self._cut(self._shown(piece))
            if len(self.known) < PARTS and len(piece) < LONG:
                self.known[piece] = found
        return found

    def _stretch(self, text: str) -> bytes:
        """``text`` starts at a cut and ends before the next one."""
        if self.far(text):  # the library's own tables of letters and numbers decide
            return b"".join([self._cut(p) for p, _ in self.all.pre_tokenizer.pre_tokenize_str(text)])
        return b"".join(map(self._piece, self.find(text)))

    def _new(self, text: str) -> bytes:
        """Ids of a stretch that isn't remembered; letters, or letters behind a space or line break, need no pattern."""
        first, rest = text[0], text[1:]
        if first == " " and rest.isascii() and rest.isalpha():
            return self._cut(self.space + rest)
        if not (rest.isalpha() or not rest) or self.far(text):
            return self._stretch(text)
        if first == "\n" and rest:
            return self._piece(first) + self._cut(self._shown(rest))
        return self._cut(self._shown(text)) if first == " " or first.isalpha() else self._stretch(text)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))

    def _entire(self, text: str) -> bytes:
        """Ids of a text that isn't cut into stretches."""
        return self._packed(self.all.encode(text, add_special_tokens=False).ids)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a string array, null as empty.

        Texts of at most STRETCH bytes, or one of more, are cut into stretches, each distinct one is looked up or encoded
        once, and its ids are gathered where it stands.
        """
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + STRETCH, "right")))
            yield from self._encoded(texts.slice(at, end - at).cast(pa.string()))
            at = end

    def _encoded(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of texts whose stretches are looked up together; those that go to the library whole leave none."""
        whole = np.zeros(len(texts), bool) | (not self.plain)
        for found in (pc.match_substring_regex(texts, AWKWARD), *(pc.match_substring(texts, x) for x in self.special)):
            whole |= found.to_numpy(zero_copy_only=False)
        alone = {k: self._entire(texts[k].as_py()) for k in np.flatnonzero(whole).tolist()}
        edges, data = _bytes_of(pc.if_else(pa.array(whole), "", texts) if alone else texts)
        at = _cuts(data, edges)
        stretches = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
        codes, size, flat = self._told(stretches)
        own = size[codes]
        ends = np.concatenate([[0], np.cumsum(own)])
        shift = (np.cumsum(size) - size)[codes] - ends[:-1]
        ids = flat[np.arange(ends[-1], dtype=np.int32) + np.repeat(shift.astype(np.int32), own)]
        cuts = ends[np.searchsorted(at, edges)].tolist()
        return [alone[k] if k in alone else ids[a:z].tobytes() for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def _told(self, stretches: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A code for each stretch, how many ids each code stands for, and the ids of all codes in a row."""
        held = pc.index_in(stretches, value_set=self.words)
        if not held.null_count:
            return held.to_numpy(), self.sizes, self.flat
        missing = held.is_null()
        new = stretches.filter(missing).dictionary_encode()
        found = list(map(self._new, new.dictionary.to_pylist()))
        codes = held.fill_null(0).to_numpy().copy()
        codes[missing.to_numpy(zero_copy_only=False)] = new.indices.to_numpy() + len(self.words)
        more = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        size, flat = np.concatenate([self.sizes, more]), np.concatenate([self.flat, np.frombuffer(b"".join(found), self.dtype)])
        if (room := self.most - len(self.words)) > 0:
            kept = np.flatnonzero(pc.binary_length(new.dictionary).to_numpy() < LONG)[:room]
            self.words = pa.concat_arrays([self.words, new.dictionary.take(pa.array(kept))])
            self.sizes = np.concatenate([self.sizes, more[kept]])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join([found[k] for k in kept.tolist()]), self.dtype)])
        return codes, size, flat
