import itertools
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from beaconry.llm import common, rans, tokenized
from beaconry.llm.tokenized import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return Encoder(rans.tokenizer_file(PATH)), Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 70_000, 400_000])
def test_block_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.01, n), 49_000).astype(np.uint32)
    counts = np.bincount(ids, minlength=50_257)
    freq, bits = rans.quantised(counts)
    assert n == 0 or (freq.sum() == 1 << bits and (freq[counts > 0] > 0).all())
    table = rans.Table(freq, bits)
    lengths = [n // 3, n - n // 3]
    data = rans.encode(ids, [5, None], lengths, table)
    block = rans.Block(data, table)
    assert (block.ids() == ids).all() and block.doc_ids == [5, None] and block.lengths.tolist() == lengths
    for k in reversed(range(len(block.places))):
        lo = k * rans.STEPS * block.lanes
        assert (block.part(k) == ids[lo : lo + rans.STEPS * block.lanes]).all()
    spoilt = bytearray(data)
    spoilt[-1] ^= 1
    with pytest.raises(ValueError):
        rans.Block(bytes(spoilt), table)


def test_many_rare_ids():
    counts = np.ones(50_257, np.int64)
    counts[7] = 10**12
    freq, bits = rans.quantised(counts)
    assert freq.sum() == 1 << bits and freq.min() == 1


def test_line_breaks_and_marks(coder, monkeypatch):
    """Words joined by line breaks, odd white space beside them, marks behind letters, digits and other marks, often repeated."""
    r = random.Random(1)
    parts = ["a", "Zb", "é", "漢", "1", "½", " ", "  ", "\n", " \n", ",", ".", "'s", "'", "<|endoftext|>", "\t", "\u2028", "\xa0", "!?", "x)", "(", "\x1c", "²", "ʼ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(8000)] + ["", " ", "a ", "!?,\xa0\n\xa0\u2028(²'s", " !?,\xa0\n\xa0\u2028(²'s"]
    want = [np.array(coder[1].encode(t, add_special_tokens=False).ids, coder[0].dtype).tobytes() for t in texts]
    for _ in range(2):
        assert [coder[0].encode(t) for t in texts] == want
        for most in (8 << 20, 200, 3):
            monkeypatch.setattr(tokenized, "STRETCH", most)
            assert list(coder[0].encode_all(pa.array([*texts, None]))) == [*want, b""]
    assert list(coder[0].encode_all(pa.array([], pa.string()))) == []


def test_work_follows_distinct_stretches(coder):
    """Words that marks, spaces and line breaks join anew are looked up one by one: no Python call for each combination."""
    own, calls = Encoder(rans.tokenizer_file(PATH)), [0]
    words = ["".join(w) for w in itertools.product("bkmt", "aeioué", "lnrs")]
    own.encode(" ".join([f"{w}. {w}," for w in words]) + "".join([f"\n{w}" for w in words]))
    texts = [f"{a}. {a}, {a}{mark}\n{b}" for a, b in itertools.product(words, words[:40]) for mark in ".,"]
    sys.setprofile(lambda frame, event, _: calls.__setitem__(0, calls[0] + (event == "call" and frame.f_code.co_filename == tokenized.__file__)))
    try:
        got = list(own.encode_all(pa.array([" ".join(texts[k::100]) for k in range(100)])))
    finally:
        sys.setprofile(None)
    assert calls[0] < 1000 < len(texts)
    assert got == [np.array(coder[1].encode(" ".join(texts[k::100]), add_special_tokens=False).ids, own.dtype).tobytes() for k in range(100)]


def test_cuts_beside_odd_bytes(coder):
    """Every three of these side by side, and at the ends of texts that lie behind one another."""
    parts = ["a", "é", "×", "÷", "ª", "ŀ", "漢", " ", "\n", "\r", "\t", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2014", "\u2028", "\u205f", "\u3000", "\u3042", ".", "'", "'s", "\x7f", "7"]
    texts = ["".join(x) for x in itertools.product(parts, repeat=3)]
    theirs = [np.array(x.ids, coder[0].dtype).tobytes() for x in coder[1].encode_batch(texts, add_special_tokens=False)]
    assert [t for t, x, y in zip(texts, coder[0].encode_all(pa.array(texts)), theirs, strict=True) if x != y] == []
    assert list(coder[0].encode_all(pa.array(["skipped", *texts], pa.large_string()).slice(1))) == theirs


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r 'sdtabé漢٣²1.,!-"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_are_the_librarys(coder, text):
    ours, theirs = coder
    assert np.frombuffer(ours.encode(text), ours.dtype).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark, odd, odd_rows, empty, coder, tmp_path):
    rows = sorted(((i, (theirs := coder[1].encode(t or "", add_special_tokens=False).ids) + [2]) for i, t, *_ in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    at, want = 0, []
    for i, ids in rows:
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rans.token_ids(odd, PATH, end_id=2).collect()), key=lambda r: r[1])
    assert got == want and theirs is not None
    assert rans.token_ids(empty, PATH, end_id=2).count() == 0
    rans.write_token_ids(odd.where("doc_id = 8"), str(tmp_path / "out"), PATH)
    assert rans.read_token_ids(spark, str(tmp_path / "out")).first()["ids"] == coder[1].encode("one").ids


def test_tasks_without_an_encoder_let_it_go(monkeypatch):
    """What an encoder remembers isn't held beside documents that are packed, nor any longer than the next thing kept."""
    released = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: released.append(1)})())

    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802  Spark's name
            return run

    common.kept_in_worker("encoder", object)
    batch = pa.RecordBatch.from_pylist([{"part": 0, "doc_id": 1, "ids": b"ab"}, {"part": 0, "doc_id": 2, "ids": b"cdef"}])
    packs = list(rans._packs(Frame(), 2)(iter([batch])))
    assert not common._held() and released
    assert [p.to_pylist() for p in packs] == [[{"part": 0, "block": 0, "doc_ids": [1, 2], "lengths": [1, 2], "ids": b"abcdef"}]]
