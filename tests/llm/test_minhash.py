import random

import numpy as np
import pytest

from beaconry.llm import common, minhash

from .conftest import WORDS, prose


def sets(rows, width):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w)} if 0 < len(w) < width else set(zip(*(w[k:] for k in range(width)), strict=False))))
    return out


def brute(rows, width, percent=80):
    """``doc_id, size, component, kept`` per row by comparing all pairs."""
    told = sets(rows, width)
    root = list(range(len(told)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(told)):
        for b in range(a):
            x, y = told[a][1], told[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(told):
        if i is not None and s:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), c := least.get(find(k)) if s else i, i == c) for k, (i, s) in enumerate(told)), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def test_odd_rows(odd, odd_rows, empty):
    for width in (4, 5):
        assert got(minhash.near_duplicates(odd, width=width)) == brute([r[:2] for r in odd_rows], width)
    assert minhash.near_duplicates(empty).count() == 0
    left = minhash.deduplicated(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"]) == [1, 5, 6, 7, 8, 9, 11, 12, 13, 14]


@pytest.mark.parametrize(("block", "size", "exact", "edges"), [(8, 1 << 24, False, 250_000), (8, 1 << 24, False, 6), (512, 1 << 24, False, 6), (512, 4000, False, 250_000), (8, 4000, True, 6), (512, 1 << 24, True, 250_000)])
def test_chains_and_groups(spark, monkeypatch, block, size, exact, edges):
    """Near copies of near copies, and one passage in many documents, in lists larger than a block in members or bytes, and
    components whose edges are dealt to several tasks."""
    monkeypatch.setattr(common, "PER_TASK", edges)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
    r, rows, passage = random.Random(5), [], prose(9, 40)
    for g in range(6):
        words = prose(100 + g, 80).split()
        for _ in range(15):
            words = list(words)
            words[r.randrange(80)] = r.choice(WORDS) + "x"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + k, passage + " " + prose(500 + k, 20)) for k in range(40)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(df, width=4, exact=exact)) == brute(rows, 4)


def test_templates_around_the_threshold(spark, monkeypatch):
    """One long passage in many documents beside more or less of their own, so that some link, some don't, and chains do."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    template, r = prose(1, 100), random.Random(4)
    rows = [(k, f"{template} {prose(100 + k, r.choice((6, 9, 11, 12, 13, 14, 20, 40)))}") for k in range(150)]
    rows += [(1000 + k, f"{template} {prose(300 + k // 3, 20)} {prose(400 + k, 4)}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4)
    assert 3 < len({c for _, _, c, _ in want}) < 200
    assert got(minhash.near_duplicates(df, width=4)) == want == got(minhash.near_duplicates(df, width=4, exact=True))


def test_long_texts_of_one_cluster(spark, monkeypatch):
    """Sets whose bytes fill a block each are dealt one by one."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 100_000)
    words = [f"u{k}" for k in range(30_000)]
    rows = []
    for k in range(6):
        own = list(words)
        own[k::40] = [f"{w}x{k}" for w in own[k::40]]
        rows.append((k, " ".join(own)))
    rows.append((9, " ".join(words[:20_000])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(df, width=4)) == brute(rows, 4)


def test_links_through_rows_without_an_id(spark):
    """A text that only rows without an id hold links, and chains go through it."""
    rows, words = [], prose(31, 80).split()
    for i in (None, 4, None, 9, None):
        words = [*words[5:], *prose(900 + len(rows), 5).split()]
        rows.append((i, " ".join(words)))
    rows.append((None, prose(32, 50)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {c for i, _, c, _ in got(minhash.near_duplicates(df, width=4)) if i} == {4}
    assert got(minhash.near_duplicates(df, width=4)) == brute(rows, 4)


def test_estimates():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.sort(r.choice(300, r.integers(1, 64), replace=False)).astype(np.int64) for _ in range(2))
        pad = lambda v: np.concatenate([v, np.full(minhash.KEPT - len(v), minhash.END)])[None, :]
        union = np.union1d(a, b)[: minhash.KEPT]
        want = np.isin(union, np.intersect1d(a, b)).sum() / len(union)
        assert minhash._estimates(pad(a), pad(b))[0] == pytest.approx(want)


def test_shared_counts_in_column_blocks(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    r = np.random.default_rng(1)
    values = [np.unique(r.integers(0, 60, 40)) for _ in range(12)]
    assert (minhash._shared(values) * (1 - np.eye(12)) == [[len(np.intersect1d(a, b)) * (i != j) for j, b in enumerate(values)] for i, a in enumerate(values)]).all()
