"""Prefix BPE against the rank-file library: encoding, decoding, appends and edits."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from beaconry.llm.prefixbpe import Encoded, PrefixEncoder, bpe_digests, bpe_ids, bpe_texts, rank_file, ranks_of, re_encoded
from beaconry.llm.queries import RANKS

PARTS = ["a", "b", "e", "t", "h", " ", "  ", "\n", "'", "'s", "re", "ll", ".", "!!", "1", "23", "\t", "　", "é", "ж", "中", "\U00010940", "\U00011de0", "ing", "\xa0", "\x00", "🙂", "==", "----", " the"]


@pytest.fixture(scope="module")
def coder():
    return PrefixEncoder(rank_file(RANKS))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(rank_file(RANKS)), special_tokens={})


def texts(seed, n, most=30):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(most))) for _ in range(n)]


def test_equals_the_library(coder, library):
    for text in [*texts(1, 3000), "", "a" * 5000, " " * 5000, "x y" * 2000, "<|endoftext|>"]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_every_prefix_has_its_last_token(coder, library):
    merges, rnd = coder.merges, random.Random(5)
    for _ in range(300):
        piece = "".join(rnd.choice("abcdeinrst") for _ in range(rnd.randrange(1, 20))).encode()
        last = merges.last_tokens(piece)
        for n in range(1, len(piece) + 1):
            assert merges.ids(last[: n + 1]) == library.encode_ordinary(piece[:n].decode())
        cut = rnd.randrange(len(piece))
        assert merges.last_tokens(piece, last[: cut + 1]) == last


def test_a_vocabulary_with_ties_and_unreachable_tokens():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258, b"bab": 259, b"aab": 260}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    from beaconry.llm.prefixbpe import Merges

    merges, rnd = Merges(ranks), random.Random(2)
    for _ in range(3000):
        piece = "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 12)))
        assert merges.encode(piece.encode()) == own.encode_ordinary(piece), piece


def test_appends_and_edits(coder, library):
    rnd = random.Random(3)
    for text in texts(4, 800):
        held = Encoded(coder, text)
        for _ in range(4):
            at = rnd.randrange(len(held.text) + 1)
            held.replace(at, rnd.randrange(min(4, len(held.text) - at) + 1), "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(4))))
            held.append(rnd.choice(PARTS))
            assert held.ids() == library.encode_ordinary(held.text), held.text
    with pytest.raises(ValueError, match="outside"):
        held.replace(len(held.text) + 1, 0, "x")


def test_an_edit_computes_only_what_is_near(coder):
    held = Encoded(coder, "the quick brown fox jumps over the lazy dog " * 2000)
    held.replace(40_000, 1, "X")
    assert held.computed < 60 and held.reused > 80_000
    held.append("again")
    assert held.computed < 60


def test_rows(spark, library):
    long = "word " * 50_000
    rows = [(1, "one two"), (2, None), (3, ""), (None, "no id"), (1, "one two"), (5, long), (6, "中文 ÄÖ <|endoftext|>")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = bpe_digests(docs, RANKS).collect()
    want = sorted((str(d), len(i := library.encode_ordinary(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert bpe_digests(docs.limit(0), RANKS).count() == 0
    broken = spark.sql("select 1L doc_id, cast(x'61ff20fe62' as string) text")
    assert bytes(bpe_texts(bpe_ids(broken, RANKS), RANKS).first()["decoded"]).decode() == b"a\xff \xfeb".decode("utf-8", "replace")


def test_edited_rows(spark, library):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "it'"), (3, None), (4, "same"), (None, "none")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 5, "omega"), (1, 1, None, 0, " delta"), (2, 1, None, None, "ll"), (3, 1, None, 0, "new"), (9, 1, 0, 0, "x"), (None, 1, 0, 0, "x")], "doc_id long, seq int, at int, removed int, inserted string")
    got = {r["doc_id"]: r for r in re_encoded(docs, edits, RANKS).collect()}
    assert {k: r["text"] for k, r in got.items()} == {1: "omega beta gamma delta", 2: "it'll", 3: "new", 4: "same", None: "none"}
    for r in got.values():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"])
    assert re_encoded(docs, edits.limit(0), RANKS).count() == 5
