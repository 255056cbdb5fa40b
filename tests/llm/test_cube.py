import random
from collections import Counter

import numpy as np
import pytest

from beaconry.llm import cube

from .conftest import prose


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by taking out, source by source, what would exceed its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left = {}, share * sum(sizes.values())
    while open_ := [s for s in order if s not in target]:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        target[over[0]] = most * sizes[over[0]]
        left -= target[over[0]]
    return target


def test_targets(spark, monkeypatch):
    t = filled({"a": 10, "b": 100, None: 50})
    assert t["a"] == 20 and sum(t.values()) == pytest.approx(240)
    r = random.Random(5)
    for n in (0, 1, 2, 7, 60):
        names = [None, *{"".join(r.choice("aZé漢🙂\uffff") for _ in range(3)) for _ in range(n)}][:n]
        sizes = {s: r.choice((0, 1, 5, 50, 500, 5000)) for s in names}
        docs = [(k, " ".join(["w"] * m), s) for k, (s, m) in enumerate(sizes.items())]
        df = spark.createDataFrame(docs, "doc_id long, text string, source string")
        for limit in (20_000, 0):
            monkeypatch.setattr(cube, "BROADCAST", limit)
            got = {names[x["doc_id"]]: (x["source_size"], x["target"]) for x in cube.cube_mix(df).collect()}
            want = filled(sizes)
            assert set(got) == set(want) and all(got[s] == (sizes[s], pytest.approx(want[s])) for s in want)


def test_ids_stay_exact(spark):
    """Ids above 2 ** 53 beside null ones, in one block."""
    ids = [None, *(2**53 + 1 + 2 * k for k in range(20))]
    mix = cube.cube_mix(spark.createDataFrame([(i, prose(k, 20), "s") for k, i in enumerate(ids)], "doc_id long, text string, source string"))
    assert sorted(x["doc_id"] or 0 for x in mix.collect()) == sorted(i or 0 for i in ids)


def test_documents_by_row(spark):
    """Rows that share an id, or have none, are taken each as its own text is; equal rows share what they take."""
    rows = [(k % 40 if k % 7 else None, prose(k % 97, 5 + k % 50), f"s{k % 3}", k) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int")
    want, got = Counter(), Counter()
    for x in cube.cube_mix(df).collect():
        want[x["doc_id"], x["size"]] += x["copies"]
    out = cube.mixed_documents(df)
    assert out.columns == df.columns
    each = Counter()
    for x in out.collect():
        got[x["doc_id"], len(x["text"].split())] += 1
        each[x["_copies"]] += 1
    assert +want == +got and max(each.values()) <= 2


def test_walk_keeps_totals_and_probabilities():
    r = np.random.default_rng(3)
    sizes = np.sort(r.integers(1, 5000, 60))[::-1].astype(float)
    p = np.full(60, 0.3)
    hits = np.zeros(60)
    for k in range(1500):
        draw = cube._uniform("t", k)
        q = np.array(cube.flight(sizes.tolist(), cube.walk_large(sizes, p, draw, 20).tolist(), draw))
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert q.sum() == pytest.approx(18) and (q * sizes).sum() == pytest.approx((p * sizes).sum())
        done = np.array(cube.landing(q.tolist(), draw))
        assert set(done) <= {0, 1} and abs(done.sum() - 18) < 1
        hits += done
    assert abs(hits / 1500 - 0.3).max() < 0.06


def test_levels_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(cube, "BLOCK", 40)
    monkeypatch.setattr(cube, "FAN", 3)
    rows = [(k, " ".join(["w"] * (1 + k * 7919 % 301)), "hot" if k % 3 else f"s{k % 4}") for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = cube.cube_mix(df)
    got = sorted(map(tuple, mix.collect()))
    assert got == sorted(map(tuple, cube.cube_mix(df.repartition(5)).collect()))
    assert len(got) == 1500 and all(r["taken"] <= 2 * r["size"] for r in mix.collect())
    source = {r[0]: r[2] for r in rows}
    taken, target = {}, {}
    for r in mix.collect():
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(taken[s] == pytest.approx(target[s], rel=0.02) for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(len(r[1].split()) for r in rows))


def test_odd_rows(odd, odd_rows, empty):
    mix = cube.cube_mix(odd).collect()
    assert len(mix) == len(odd_rows)
    assert sorted(r["size"] for r in mix) == sorted(len((t or "").encode().split()) for _, t, *_ in odd_rows)
    assert cube.cube_mix(empty).count() == 0
    assert cube.mixed_documents(odd).columns == odd.columns
    assert cube.mixed_documents(empty).count() == 0
