"""Importance resampling against a brute-force version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from beaconry.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return [zlib.crc32(x.encode()) % 10_000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]], len(words)


def brute(docs, target, percent=25, least=20, seed=7):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[0])
    for text in target:
        t.update(features(text)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        found, n = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    eligible = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def documents(n, seed=1):
    rnd = random.Random(seed)
    return [(k, " ".join(rnd.choice("alpha Beta gamma délta x1 Zeta-eta 中文 foo.bar".split()) for _ in range(rnd.randrange(60)))) for k in range(n)]


def test_features_of_odd_texts():
    rnd = random.Random(2)
    for _ in range(200):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choice(["a", "B", "é", "Z9", " ", ".", "\n", "\x00", "x" * 70, "中", "-"]) for _ in range(rnd.randrange(20))) for _ in range(rnd.randrange(1, 6))]
        buckets, n_words = R.features([t if t is None else t.encode() for t in texts])
        want = [features(t) for t in texts]
        assert n_words.tolist() == [n for _, n in want] and buckets.tolist() == [b for f, _ in want for b in f]


def test_tournament():
    rnd = random.Random(3)
    for k in (0, 1, 2, 3, 7, 8, 33):
        runs = [sorted((rnd.randrange(20), j) for j in range(rnd.randrange(9))) for _ in range(k)]
        assert list(R.Tournament(map(iter, runs))) == sorted(x for run in runs for x in run)


@pytest.mark.parametrize("ranges", [1, 9])
def test_equals_brute_force(spark, monkeypatch, ranges):
    docs = documents(600)
    monkeypatch.setattr(R, "RANGE_ROWS", 600 // ranges)
    monkeypatch.setattr(R, "SLICE", 50)
    target = ["alpha alpha foo bar", None, "gamma délta " * 20]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    out = R.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got(out) == brute(docs, target)
    assert got(R.resampled(df.repartition(3), spark.createDataFrame([(t,) for t in target], "text string"))) == brute(docs, target)


def test_equal_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 20)
    docs = [(5, "same text here again " * 6)] * 300 + [(None, "other words now " * 8)] * 40 + documents(30, 4)
    target = ["same text"]
    out = R.resampled(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), percent=60)
    assert got(out) == brute(docs, target, 60)


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty):
    benchmark = spark.createDataFrame([("w1 w2 w3 " * 9,), (None,)], "text string")
    docs = [(r[0], r[1]) for r in odd_rows]
    assert got(R.resampled(odd, benchmark)) == brute(docs, ["w1 w2 w3 " * 9, None])
    assert got(R.resampled(odd, benchmark.limit(0))) == brute(docs, [])
    assert R.resampled(empty, benchmark).count() == 0
    assert R.resampled(spark.sql("select 1L doc_id, cast(x'61ff20fe62' as string) text"), benchmark).first()["n_features"] == 3
