"""Sparse neighbours against dense ones, and the nearest-in-time join."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.operators import sparse
from beaconry.operators.sequences import nearest_in_time
from beaconry.operators.shaping import group_number
from beaconry.operators.sparse import SparseIndex


def scans(seed, n, start=0, keys=40, hot=True):
    """Scans of few transmitters near each other; one transmitter that most scans have."""
    rnd, out = random.Random(seed), {}
    for k in range(n):
        place = rnd.randrange(keys)
        seen = {f"t{(place + d) % keys}": float(rnd.randrange(1, 30)) for d in range(rnd.randrange(1, 5))}
        if hot and rnd.random() < 0.7:
            seen["everywhere"] = float(rnd.randrange(1, 6))
        out[start + k] = seen
    return out


def frame(spark, told):
    return spark.createDataFrame([(i, k, v) for i, m in told.items() for k, v in m.items()], "sample_id long, key string, value double")


def brute(asked, refs, k):
    keys = sorted({x for m in [*asked.values(), *refs.values()] for x in m})
    dense = {i: np.array([m.get(x, 0.0) for x in keys]) for i, m in [*asked.items(), *refs.items()]}
    out = []
    for q in asked:
        near = sorted((round(float(np.sqrt(((dense[q] - dense[r]) ** 2).sum())), 9), r) for r in refs)[:k]
        out += [(q, n + 1, r, d) for n, (d, r) in enumerate(near)]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["reference_id"], round(r["distance"], 9)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 4])
def test_equals_dense(spark, monkeypatch, k):
    monkeypatch.setattr(sparse, "SCANS", 16)
    refs = scans(1, 400, 1000) | {5000: {"lonely": 0.5}, 5001: {"lonely": 0.5}, 5002: {"everywhere": 1.0}}
    asked = scans(2, 30) | {900: {"never seen": 3.0}, 901: dict(refs[1003])}
    index = SparseIndex(frame(spark, refs))
    assert rows(index.neighbours(frame(spark, asked), k)) == brute(asked, refs, k)
    met, every = index.met(frame(spark, asked), k)
    assert met < every / 2, (met, every)


def test_odd_readings(spark):
    refs = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (2, None, 1.0), (3, "b", None), (None, "a", 1.0), (4, "c", 0.0), (5, "b", float("nan")), (6, "b", 1.0)], "sample_id long, key string, value double")
    assert rows(SparseIndex(refs).neighbours(refs, 5)) == [(1, 1, 1, 0.0), (1, 2, 6, round(10**0.5, 9)), (6, 1, 6, 0.0), (6, 2, 1, round(10**0.5, 9))]
    assert SparseIndex(refs.limit(0)).neighbours(refs, 2).count() == 0 and SparseIndex(refs).neighbours(refs.limit(0), 2).count() == 0
    with pytest.raises(Exception, match="below 0"):
        SparseIndex(spark.createDataFrame([(1, "a", -1.0)], refs.schema)).neighbours(refs, 1).collect()


@pytest.mark.parametrize("spans", [1, 64])
def test_nearest_in_time(spark, spans):
    rnd = random.Random(4)
    left = [(k, rnd.choice([1, 2, None]), rnd.choice([None, rnd.randrange(-400, 400) / 4])) for k in range(150)]
    right = [(rnd.choice([1, 1, 1, 3, None]), rnd.choice([None, rnd.randrange(-400, 400) / 4]), k) for k in range(60)]
    a = spark.createDataFrame(left, "row int, key int, t double")
    b = spark.createDataFrame(right, "key int, t double, told int")
    got = sorted((r["row"], r["told"], r["gap"]) for r in nearest_in_time(a, b, ("told",), key="key", time="t", tolerance=5.0, spans=spans).collect())
    want = []
    for n, key, t in left:
        may = [(abs(at - t), at, told) for k, at, told in right if k == key and key is not None and None not in (t, at) and abs(at - t) <= 5.0]
        gap, _, told = min(may, default=(None, None, None))
        want.append((n, told, gap))
    assert got == sorted(want) and any(w[1] is not None for w in want) and any(w[1] is None for w in want)
    assert nearest_in_time(a, b.limit(0), ("told",), key="key", time="t", tolerance=5.0).where("told is not null").count() == 0


def test_groups_of_null_keys_are_numbered(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), (None, 4), ("a", 5)], "k string, n int")
    assert {r["n"]: (r["k"], r["group_id"]) for r in group_number(df, ["k"]).collect()} == {1: ("a", 1), 2: (None, 0), 3: ("b", 2), 4: (None, 0), 5: ("a", 1)}
    assert group_number(df.withColumn("m", F.lit(None).cast("int")), ["k", "m"]).count() == 5


def test_bounds_keep_queries_from_blocks(spark, monkeypatch):
    """Transmitters that every block has don't make a query meet all blocks; no row is written for those that it doesn't meet."""
    monkeypatch.setattr(sparse, "SCANS", 8)
    monkeypatch.setattr(sparse, "PAGE", 5)
    rnd = random.Random(3)
    refs = {k: {f"t{t}": float(rnd.randrange(24, 74)) for t in rnd.sample(range(12), rnd.randrange(1, 6))} for k in range(900)}
    refs |= {2000 + k: dict(refs[k % 7]) for k in range(60)}  # copies fill blocks of their own
    asked = {k: refs[k] for k in range(0, 900, 30)}
    index = SparseIndex(frame(spark, refs))
    assert rows(index.neighbours(frame(spark, asked), 5)) == brute(asked, refs, 5)
    met, every = index.met(frame(spark, asked), 5)
    assert met < every * 0.7, (met, every)


def test_copies_are_met_once(spark, monkeypatch):
    """Of equal references only k are compared, and equal queries are asked once, yet each has its own rows."""
    monkeypatch.setattr(sparse, "SCANS", 128)
    some = list(scans(5, 20).values())
    refs = {1000 + n: dict(some[n % 20]) for n in range(800)}
    asked = {n: dict(some[n % 5]) for n in range(60)} | {900: {"never seen": 3.0}}
    index = SparseIndex(frame(spark, refs))
    assert rows(index.neighbours(frame(spark, asked), 3)) == brute(asked, refs, 3)
    met, every = index.met(frame(spark, asked), 3)
    assert met < every / 50, (met, every)


def test_pairs_leave_no_reference_out():
    """Whatever lacks places of a query worth at most the limit, and has one of its places, has one of the pairs."""
    rnd = random.Random(6)
    for _ in range(300):
        squares = sorted((rnd.randrange(1, 50) ** 2 for _ in range(rnd.randrange(1, 7))), reverse=True)
        limit = rnd.choice([0.0, float("inf"), rnd.random() * sum(squares)])
        pairs = sparse.signature([float(x) for x in squares], limit)
        for mask in range(1, 1 << len(squares)):
            has = {n for n in range(len(squares)) if mask >> n & 1}
            if sum(x for n, x in enumerate(squares) if n not in has) <= limit:
                assert any(a in has and (b < 0 or b in has) for a, b in pairs), (squares, limit, has, pairs)
