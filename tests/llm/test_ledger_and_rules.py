import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.llm import ledger, rulefit

from .conftest import prose


def brute_repeats(words):
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    return len({k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)})


def test_repeats():
    r = np.random.default_rng(0)
    for n in (0, 3, 5, 6, 40, 200):
        for kinds in (1, 2, 5):
            words = [b"%d" % k for k in r.integers(0, kinds, n)]
            assert ledger.repeated_words(words) == brute_repeats(words)


def test_measures():
    assert ledger.measures("éa b#\n\nb# $\nb#\nb#".encode())[:5] == (6, 11, 5, 4, 1)
    assert ledger.measures(None) == ledger.measures(b"") == (0,) * 9


def test_odd_rows(odd, odd_rows, empty):
    out = ledger.quality_verdicts(odd)
    assert out.count() == len(odd_rows)
    assert {r["doc_id"] for r in out.where("base_failed").collect()} >= {5, 6, 7, 8, 9}
    assert {r["doc_id"] for r in out.where("kept").collect()} >= {1, 2, 3}
    assert ledger.quality_verdicts(empty).count() == 0


def test_policies_and_ablations(spark):
    rows = [(1, prose(1, 50)), (2, "few"), (3, "a b c d e " * 10), (4, " ".join("WORDS ARE SHOUTED HERE BUT NONE REPEATS AS FAR AS ANY WINDOW GOES".split())), (5, "##$ x" * 12)]
    kept = ledger.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in kept.where(ledger.passes(("base", 1))).orderBy("doc_id").collect()][:1] == [1]
    for mask_of in (("web", 1), ("web", 2)):
        bits = [r["failed_bits"] & ledger.POLICIES[mask_of] for r in kept.collect()]
        for r in ledger.ablations(kept, mask_of).collect():
            bit = 1 << next(x.bit for x in ledger.RULES if x.name == r["rule"])
            assert (r["failed"], r["only_this"]) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits))


def test_ablations_by_sql(spark):
    rows = [(k, " ".join([prose(k, k % 23), "LOUD WORDS " * (k % 4), "#$ " * (k % 7), "x" * 31 * (k % 2), "a b c d e " * (k % 3)])) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with duckdb.connect() as con:
        con.register("documents", df.toPandas())
        want = sorted(con.execute(f"SELECT rule, failed, only_this FROM ({ledger.ABLATIONS})").fetchall())
    assert sorted(map(tuple, ledger.ablations(ledger.ledger(df)).select("rule", "failed", "only_this").collect())) == want


def plain_statistics(text):
    """The statistics by their definitions, word by word."""
    words = (text or "").split(" ")
    words = [w for x in words for w in re.split("[\t\n\x0b\x0c\r]", x) if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    n, many = max(1, len(words)), max(1, len(lines))
    letters = [w for w in words if any(c.isalpha() for c in w)]
    return (
        math.log(1 + len(words)), sum(map(len, words)) / n, sum(c in "#*$%&|<>" for c in text or "") / n, (len(lines) - len(set(lines))) / many, brute_repeats(words) / n,
        len(letters) / n, sum(w == w.upper() != w.lower() and len(w) > 1 for w in letters) / n, len(words) / many, len(set(words)) / n, max(map(words.count, words), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(c in "0123456789" for c in text or "") / n, sum(c in ".,;:!?\"'()-" for c in text or "") / n,
    )


def test_statistics():
    r = np.random.default_rng(4)
    some = ["a", "Wörter", "LOUD", "x1", "9", "#$", "re-do,", "\n", "\n\n", "\t", "same same", "漢字", "\x0b"]
    for n in (0, 1, 7, 30, 90):
        for _ in range(20):
            text = " ".join(some[k] for k in r.integers(0, len(some), n))
            assert rulefit.statistics(text.encode()) == pytest.approx(plain_statistics(text)), text
    assert rulefit.statistics(None) == plain_statistics(None)


def test_scores_by_hand(spark):
    """The query's scores are the rules' weights, added up by reading each rule, through the logistic function."""
    junk = lambda k: " ".join(f"{w}###" for w in prose(k, 60).split()) if k % 3 == 0 else prose(k, 60) + "." * (k % 5)
    rows = [(k, junk(k)) for k in range(200)] + [(200, None), (201, ""), (202, prose(5, 30_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0 if k % 3 == 0 else 1) for k in range(200)], "doc_id long, quality int")
    model = rulefit.train(docs, labels)
    assert model.rules
    got = {x["doc_id"]: x["score"] for x in rulefit.quality_scores(docs, labels).collect()}
    for k, text in rows[:202]:
        s, total = plain_statistics(text), model.bias
        for rule in model.rules:
            total += rule.weight * all((s[i] > at) == above for i, above, at in rule.terms)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-total)))
    assert 0 <= got[202] <= 1


def test_rules_compile_to_the_same_scores(spark):
    r = np.random.default_rng(0)
    x = r.random((400, len(rulefit.STATISTICS)))
    y = ((x[:, 2] > 0.6) | ((x[:, 4] > 0.5) & (x[:, 0] < 0.3))).astype(float)
    model = rulefit.fit(x, y)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.97
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "k int, v array<double>").select("k", F.struct(*(F.get("v", F.lit(k)).alias(s) for k, s in enumerate(rulefit.STATISTICS))).alias("s"))
    got = [row["p"] for row in df.select("k", model.score("s").alias("p")).orderBy("k").collect()]
    assert got == pytest.approx(model.scores(x).tolist())


def test_constant_without_both_labels():
    assert rulefit.fit(np.zeros((0, 13)), np.zeros(0)).scores(np.zeros((1, 13)))[0] == 0.5
    assert rulefit.fit(np.zeros((9, 13)), np.ones(9)).scores(np.zeros((1, 13)))[0] > 0.9


def test_classifier(spark, odd, odd_rows, empty):
    junk = lambda k: " ".join(f"{w}###" for w in prose(k, 60).split()) if k % 3 == 0 else prose(k, 60)
    docs = spark.createDataFrame([(k, junk(k)) for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0 if k % 3 == 0 else 1) for k in range(0, 600, 2)] + [(None, 1), (1, None)], "doc_id long, quality int")
    out = rulefit.quality_scores(docs, labels)
    held = out.where("held_out").collect()
    assert 60 < len(held) < 180
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in held]) > 0.98
    assert rulefit.quality_scores(odd, labels).where("score between 0 and 1").count() == len(odd_rows)
    assert rulefit.quality_scores(empty, labels.limit(0)).count() == 0
    assert rulefit.accepted(odd, labels).columns == odd.columns
