"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from beaconry.llm import spelling as S


def counted(docs, loses=31):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if loses and h % loses == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    found = {w: [v for v in words if v != w and near(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in found.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(found[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def vocabulary(seed, n, letters="abcdeéß"):
    """Words with families of near ones and steep counts."""
    rnd, out = random.Random(seed), {}
    while len(out) < n:
        w = "".join(rnd.choice(letters) for _ in range(rnd.choice([7, 7, 8, 9, 12, 60])))
        for _ in range(rnd.randrange(1, 6)):
            out[w] = rnd.choice([2, 3, 25, 40, 500])
            k = rnd.randrange(len(w))
            w = rnd.choice([w[:k] + rnd.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rnd.choice(letters) + w[k + 1 :]])
    return {w: c for w, c in out.items() if len(w) >= 7}


def test_one_edit():
    rnd = random.Random(1)
    for _ in range(5000):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randrange(6))) for _ in range(2))
        assert S.one_edit(a.encode(), b.encode()) == near(a, b), (a, b)


@pytest.mark.parametrize(("block", "rows"), [(2048, 20_000), (2, 7)])
def test_near_words(spark, monkeypatch, block, rows):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "ROWS", rows)
    words = vocabulary(3, 500) | {"a" * 9: 5, "a" * 8: 50, "a" * 10: 6, "b" + "a" * 8: 7, "a" * 8 + "b": 9, "a" * 7: 600}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in S.near_words(df, S.Scratch(spark, "test")).collect()}
    found = {w: [v for v in words if near(w, v)] for w in words}
    want = {w: (len(vs), f := min(vs, key=lambda v: (-words[v], v)), words[f]) for w, vs in found.items() if vs}
    assert got == want


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    words = vocabulary(6, 120, "abcdeÉß")
    docs = []
    for k in range(60):
        picked = [w.title() if rnd.random() < 0.2 else w for w in words for _ in range(min(words[w] // 20 + 1, 6)) if rnd.random() < 0.5]
        docs.append((k, " ".join(picked) + ", short x"))
    got = S.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(counted(docs))
    assert {tuple(r) for r in got} == want and len(got) == len(want) and any(r[1] for r in want) and any(r[4] for r in want)


def test_roots_follow_chains(spark):
    chain = [("abcdefg", 2), ("abcdefh", 20), ("abcdeih", 200), ("abcdjih", 2000), ("abckjih", 20000)]
    docs = spark.createDataFrame([(k, f"{w} " * n) for k, (w, n) in enumerate(chain)], "doc_id long, text string")
    got = {r["word"]: r["root"] for r in S.spelling_variants(docs, loses=None).collect()}
    assert got == {w: "abckjih" for w, _ in chain}


def test_odd_rows(spark, odd, odd_rows, empty):
    rows = [(1, "Straße Straßen STRASSEN strassen"), (None, "strassen strassen"), (2, None), (3, ""), (4, "straßen" + " wörterbuch" * 40 + " worterbuch worterbuch"), (4, "straßen" + "ý" * 5000), (5, "straßen" + "ý" * 5000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")
    assert {tuple(r) for r in S.spelling_variants(docs).collect()} == brute(counted(rows))
    words = counted([(r[0], r[1]) for r in odd_rows])
    assert {tuple(r) for r in S.spelling_variants(odd).collect()} == brute(words)
    assert S.spelling_variants(empty).count() == 0
    assert S.spelling_variants(spark.sql("select 1L doc_id, cast(x'616263646566676868ff616263646566676868' as string) text"), loses=None).first()["word"] == "abcdefghh"
