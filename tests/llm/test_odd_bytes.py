"""Bytes that aren't UTF-8, tables without ids and ids that fill several parts."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from beaconry.llm import rans
from beaconry.llm.ledger import quality_verdicts
from beaconry.llm.minhash import deduplicated
from beaconry.llm.rulefit import quality_scores

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def broken(spark):
    return spark.sql("select 1L doc_id, cast(x'61ff20fe62' as string) text union all select 2L, 'plain words of a text'")


def test_rules_and_scores(spark, broken):
    told = {r["doc_id"]: r for r in quality_verdicts(broken).collect()}
    assert told[1]["n_words"] == 2 and told[1]["word_chars"] == 4
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in quality_scores(broken, labels).collect()} == {1, 2}


def test_token_ids(spark, broken):
    library = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r["n_tokens"] for r in rans.token_ids(broken, PATH, end_id=2).collect()}
    assert got[1] == len(library.encode("a� �b", add_special_tokens=False).ids) + 1


def test_parts_of_hot_ids():
    parts = rans.Parts([3, 5, 5, 5, 9], nulls=40, n=60, parts=6)
    assert {parts.of(None, t) for t in range(9)} == {0, 1, 2, 3}
    hot, after = {parts.of(5, t) for t in range(9)}, {parts.of(6, t) for t in range(9)}
    assert len(hot) == 3 and len(after) == 1 and max(hot) < min(after) and parts.of(4, 1) < min(hot) and parts.of(9, 0) == parts.count - 1
    order = [parts.of(d, 0) for d in (None, -5, 3, 4, 5, 6, 9, 100)]
    assert order == sorted(order)
    assert rans.Parts([], 0, 0, 4).of(7, 3) == 1


def test_a_table_without_ids_fills_several_parts(spark, tmp_path):
    r = random.Random(1)
    docs = spark.createDataFrame([(None if k % 2 else 7 if k % 3 else k, " ".join(r.choice("abc") for _ in range(20))) for k in range(400)], "doc_id long, text string").repartition(3)
    rans.write_token_ids(docs, str(tmp_path / "out"), PATH, end_id=2)
    blocks = spark.read.parquet(str(tmp_path / "out/blocks"))
    assert blocks.select("part").distinct().count() > 4
    rows = sorted(rans.read_token_ids(spark, str(tmp_path / "out")).collect(), key=lambda x: x["start"])
    assert len(rows) == 400 and [x["start"] for x in rows] == [sum(y["n_tokens"] for y in rows[:k]) for k in range(400)]
    keys = [(x["doc_id"] is not None, x["doc_id"] or 0) for x in rows]
    assert keys == sorted(keys)


def test_copies_without_ids_leave_one(spark):
    text, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    near = text.replace("w59", "changed")
    rows = [(None, text, "a"), (None, text, "a"), (None, near, "b"), (None, text.upper(), "c"), (None, None, "d"), (None, None, "d"), (None, "", "e"), (None, "", "e"), (None, " \n", "e"), (1, other, "f"), (None, other, "g"), (2, other, "h")]
    kept = [tuple(r) for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string, _mark string")).collect()]
    assert len(kept) == 7 and (1, other, "f") in kept
    assert sum(k[2] in ("a", "b", "c") for k in kept) == 1 and sum(k[2] in ("d", "e") for k in kept) == 5
