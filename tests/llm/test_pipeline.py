import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from beaconry.llm import decontaminate, minhash, rulefit
from beaconry.llm.queries import TOKENIZER

from .conftest import prose
from .test_cube import filled
from .test_minhash import brute
from .test_text_operators import plain_score


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean and junk documents, near copies, leaks, nulls and odd texts."""
    at = tmp_path_factory.mktemp("sf")
    docs = []
    for k in range(400):
        text = prose(k, 30 + k * 37 % 120)
        if k % 10 == 3:
            text = " ".join(f"{w}###" for w in text.split())
        if k % 10 == 4:
            text = prose(k - 3, 30 + (k - 3) * 37 % 120) + " tail"
        if k % 20 == 7:
            text += " " + prose(9000 + k % 3, 25)
        docs.append((k, text, "xx", None if k % 11 == 0 else f"s{k % 4}", len(text)))
    docs += [(900, None, None, None, None), (901, "", "xx", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 0 if k % 10 == 3 else 1, 0) for k in range(0, 400, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(k, prose(9000 + k, 25)) for k in range(3)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "benchmark decontamination", "mixing", "token ids"]


def test_run_against_brute_force(spark, folder):
    at, docs = folder
    model = rulefit.train(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    scores = model.scores(np.array([rulefit.statistics(t.encode() if t else None) for _, t, *_ in docs]))
    rows = [d for d, s in zip(docs, scores, strict=True) if s >= rulefit.THRESHOLD]
    assert {d[0] for d in rows if d[0] < 400} == {k for k in range(400) if k % 10 != 3}
    kept = {r[0] for r in brute([d[:2] for d in rows], 5) if r[3]}
    rows = [d for d in rows if d[0] in kept]
    assert not any(d[0] % 10 == 4 for d in rows if d[0] < 400)
    items = [prose(9000 + k, 25).split() for k in range(3)]
    words = lambda t: [w.decode() for w in decontaminate.plain_words((t or "").encode())]
    rows = [d for d in rows if all(plain_score(words(d[1]), i) < decontaminate.THRESHOLD * 2 * len(i) for i in items)]
    assert not any(d[0] % 20 == 7 for d in rows)

    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, at).collect()))
    copies = Counter(g[1] for g in got)
    texts, source = {d[0]: d[1] for d in rows}, {d[0]: d[3] for d in rows}
    size = {i: len((t or "").encode().split()) for i, t in texts.items()}
    assert set(copies) <= set(texts) and max(copies.values()) <= 2
    per = Counter()
    for i in texts:
        per[source[i]] += size[i]
    for s, target in filled(dict(per)).items():
        assert sum(copies[i] * size[i] for i in texts if source[i] == s) == pytest.approx(target, rel=0.05)
    library, begun = Tokenizer.from_file(TOKENIZER), 0
    assert [g[1] for g in got] == sorted(g[1] for g in got)
    for start, i, n, crc in got:
        ids = np.array(library.encode(texts[i] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (start, n, crc) == (begun, len(ids), zlib.crc32(ids.tobytes()))
        begun += n


def test_only_the_rows_concerned_go(spark):
    """Rows without an id, and rows that repeat one, are judged each by its text."""
    clean, again, copied, item = prose(1, 60), prose(2, 60), prose(3, 60), prose(4, 30)
    leak = f"{prose(5, 20)} {item}"
    docs = [(1, copied), (None, copied), (None, clean), (None, again), (None, None), (7, copied), (7, prose(6, 60)), (8, leak), (8, prose(7, 60)), (None, f"{prose(9, 60)} {item}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = sorted(((r["doc_id"], r["text"]) for r in minhash.deduplicated(df).collect()), key=repr)
    assert left == sorted((d for k, d in enumerate(docs) if k not in (1, 5)), key=repr)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = sorted(((r["doc_id"], r["text"]) for r in decontaminate.decontaminated(df, bench).collect()), key=repr)
    assert left == sorted((d for k, d in enumerate(docs) if k not in (7, 9)), key=repr)
