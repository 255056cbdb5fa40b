import random

import pyarrow as pa
import pytest

from beaconry.llm import common


@pytest.mark.parametrize("most", [250_000, 20, 4])
def test_components(spark, monkeypatch, most):
    """Paths, stars, cycles, repeated and turned edges, loops: roots in one task and in levels of many."""
    monkeypatch.setattr(common, "PER_TASK", most)
    r, edges = random.Random(2), [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (9, 8), (8, 9), (9, 8)]
    edges += [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(90)]
    r.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    made = common.components(spark.createDataFrame(edges, "a long, b long").repartition(1 if most > 100 else 9), common.Scratch(spark, "t"), "c")
    assert sorted(map(tuple, made.select("node", "root").collect())) == sorted((x, top(x)) for x in linked)
    none = spark.createDataFrame([], "a binary, b binary")
    assert common.components(none, common.Scratch(spark, "t"), "c").count() == 0


def test_stars_in_bounded_memory(monkeypatch):
    """A task that holds few nodes tells them in several stars, which connect the same."""
    monkeypatch.setattr(common, "HELD", 5)
    edges = [(k, k + 1) for k in range(40)]
    batches = [pa.RecordBatch.from_pylist([{"u": a, "v": b} for a, b in edges[at : at + 3]]) for at in range(0, 40, 3)]
    told = [(n, r) for b in common._stars(iter(batches)) for n, r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert {n for n, _ in told} == set(range(41)) and len(told) > 41
    again = next(common._stars(iter([pa.RecordBatch.from_pylist([{"u": n, "v": r} for n, r in told])])))
    assert set(again.column(1).to_pylist()) == {0}
