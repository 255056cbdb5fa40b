import random
import re

import numpy as np
import public_tokenizers
import pytest

from beaconry.llm import decontaminate, linedup, pseudonyms, wordpiece

from .conftest import prose

IDS = "doc_id long, text string"


def test_permutations_are_one_to_one():
    net = pseudonyms.Feistel(b"k")
    for n in (1, 2, 3, 10, 100, 1000):
        assert sorted(net.permuted(v, n, "t") for v in range(n)) == list(range(n))
    assert [pseudonyms.Feistel(b"l").permuted(v, 1000, "t") for v in range(9)] != [net.permuted(v, 1000, "t") for v in range(9)]


@pytest.mark.parametrize(
    ("found", "shape", "valid"),
    [
        ("4111 1111 1111 1111", r"\d{4} \d{4} \d{4} \d{4}", lambda v: pseudonyms.luhn(v.replace(" ", ""))),
        ("4929348385146306", r"\d{16}", pseudonyms.luhn),
        ("97.51.17.173", r"\d+(\.\d+){3}", lambda v: all(int(x) < 256 for x in v.split("."))),
        ("1999-02-28", r"(19|20)\d\d-\d\d-\d\d", lambda v: 1 <= int(v[5:7]) <= 12),
        ("28/02/1999", r"\d\d/\d\d/(19|20)\d\d", lambda v: 1 <= int(v[3:5]) <= 12),
        ("+1 (017) 555-7713", r"\+1 \(\d{3}\) \d{3}-\d{4}", bool),
        ("GB82 WEST 1234 5698 7654 32", r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", lambda v: pseudonyms._mod97(v.replace(" ", "")) == 1),
        ("123-45-6789", r"\d{3}-\d{2}-\d{4}", lambda v: v[:3] not in ("000", "666") and v[0] != "9"),
        ("ann.o7@mail.example.com", r"[a-z]{3}\.[a-z]\d@mail\.example\.com", bool),
    ],
)
def test_formats(found, shape, valid):
    names = pseudonyms.Pseudonyms(b"k")
    new, counts = names.rewritten(f"a {found}, {found}### b")
    one, two = re.fullmatch(r"a (.*), (.*)### b", new).groups()
    assert one == two != found and re.fullmatch(shape, one) and valid(one) and sum(counts.values()) == 2


def test_what_is_not_valid_stays():
    text = "4111111111111112 999.1.1.1 1.2.3.4.5 2001-02-30 000-12-3456 GB00 WEST 1234 5698 7654 32 4.0. x@y"
    assert pseudonyms.Pseudonyms(b"k").rewritten(text)[0] == text


def test_pseudonyms_of_odd_rows(spark, odd, odd_rows, empty):
    out = pseudonyms.pseudonymised(odd, b"k").collect()
    assert sorted((r["text"] or "", r["n_replaced"]) for r in out) == sorted((t or "", 0) for _, t, *_ in odd_rows)
    assert sum(r["text"] is None for r in out) == 2 and pseudonyms.pseudonymised(empty, b"k").count() == 0


def plain_score(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_alignment():
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 20))] for _ in range(2))
        score, start, end = decontaminate.best_span(np.array(a), np.array(b))
        assert score == plain_score(a, b)
        assert not score or plain_score(a[start:end], b) == score


def test_contamination(spark, odd, empty):
    item = prose(77, 30)
    edited = item.split()
    for k in (4, 13, 22):
        edited[k] = "other"
    del edited[17]
    docs = [(1, prose(5, 300) + " " + item + " " + prose(6, 50)), (2, prose(7, 90) + " " + " ".join(edited).upper() + "!"), (3, prose(8, 500)), (4, " ".join(item.split()[:8])), (5, item.replace(" ", ",\n"))]
    docs += [(k, prose(9, 40) + " " + item) for k in range(100, 140)]
    bench = spark.createDataFrame([(1, item), (2, prose(78, 12)), (None, None), (3, ""), (4, "a b"), (5, item)], "item_id long, text string")
    df = spark.createDataFrame(docs, IDS)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(df, bench).collect()}
    want = {1, 2, 5, *range(100, 140)}
    assert {d for d, _ in got} == want and {i for _, i in got} == {1, 5}
    assert (got[1, 1]["score"], got[1, 1]["start_word"], got[1, 1]["end_word"]) == (1, 300, 330)
    left = decontaminate.decontaminated(df, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4]
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(odd, bench).count() == odd.count()


def test_edited_copies(spark):
    """Copies with dead n-grams in every part of the item, alone in the corpus or beside copies that have them all."""
    r, items, docs = random.Random(6), [(k, prose(300 + k, 40)) for k in range(24)], []
    for k, item in items:
        words = item.split()
        start = r.randrange(3, 6)
        for at in range(start, 40, 6 if k % 2 else 5):
            words[at] = f"edit{at}"
        docs.append((k, prose(400 + k, 60) + " " + " ".join(words) + " " + prose(500 + k, 60)))
        if k % 3 == 0:
            docs += [(1000 + 10 * k + j, prose(600 + j, 9) + " " + item) for j in range(3)]
    want = {(d, i) for d, t in docs for i, item in items if plain_score(t.split(), item.split()) >= decontaminate.THRESHOLD * 2 * 40}
    assert {(k, k) for k, _ in items} <= want
    got = decontaminate.contaminated(spark.createDataFrame(docs, IDS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 25)
    items = [(k, prose(200 + k, 20)) for k in range(4)]
    df = spark.createDataFrame([(k, prose(k, 50) + " " + t) for k, t in items], IDS)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()) == [(k, k) for k in range(4)]


def test_pieces(spark):
    for n in (0, 5, 2000, 2001, 2999, 3000, 3001, 7777):
        words = list(range(n))
        got = list(decontaminate.pieces(words))
        assert {w for p in got for w in p} == set(words) and all(len(p) == min(n, decontaminate.PIECE) for p in got)
        assert len(got) <= 1 + max(0, 2 * n // decontaminate.PIECE)
    long = prose(900, 6000).split()
    docs = [(1, prose(901, 50) + " " + " ".join(long[1500:4500])), (2, prose(902, 400)), (3, " ".join(long))]
    got = decontaminate.contaminated(spark.createDataFrame(docs, IDS), spark.createDataFrame([(7, " ".join(long))], "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(1, 7), (3, 7)}


def test_items_that_share_a_sentence(spark, monkeypatch):
    """All of it against brute force: texts that quote the sentence aren't joined with every item, copies are found."""
    sentence, r = prose(700, 12), random.Random(1)
    items = [(k, f"{sentence} {prose(710 + k, 18)}") for k in range(150)]
    docs = [(k, f"{prose(2000 + k, 30)} {sentence} {prose(3000 + k, 30)}") for k in range(60)]
    for k in range(60):
        words = items[2 * k][1].split()
        for at in r.sample(range(30), k % 9):
            words[at] = f"x{at}"
        docs.append((100 + k, f"{prose(4000 + k, 20)} {' '.join(words)} {prose(5000 + k, 20)}"))
    want = {(d, i) for d, t in docs for i, item in items if plain_score(t.split(), item.split()) >= decontaminate.THRESHOLD * 2 * 30}
    assert {(100 + k, 2 * k) for k in range(60) if k % 9 < 4} <= want and not any(d < 100 for d, _ in want)
    got = decontaminate.contaminated(spark.createDataFrame(docs, IDS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    held = decontaminate.Items.of([(i, decontaminate.plain_words(t.encode())) for i, t in items])
    number = held.vocabulary
    shared = decontaminate.keyed(np.array([number[w] for w in sentence.encode().split()]))
    assert not set(shared.tolist()) & set(held.grams.tolist())


def test_patience():
    r = random.Random(2)
    assert linedup.patience(list("abcdef"), list("xbcyef")) == [(1, 1), (2, 2), (4, 4), (5, 5)]
    for _ in range(500):
        a, b = ([r.randrange(6) for _ in range(r.randrange(12))] for _ in range(2))
        pairs = linedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and x < y for (p, x), (q, y) in zip(pairs, pairs[1:], strict=False))
        assert linedup.patience(a, a) == [(k, k) for k in range(len(a))]


def test_line_dedup(spark, odd, odd_rows, empty):
    p, q, line = prose(1, 30), prose(2, 30), prose(3, 12)
    docs = [(1, f"{p}\n{q}\nmine"), (2, f"own start\n{p}\n{q}\nown end"), (3, f"{line}\nthird"), (4, f"fourth\n{line}"), (5, f"short\n{q}  "), (6, "short\nother"), (7, None), (8, f"{p}\n{q}\nmine")]
    docs += [(k, f"{line}\n{prose(k, 15)}") for k in range(100, 130)]
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in linedup.without_repeated_lines(spark.createDataFrame(docs, IDS)).collect()}
    assert got[1] == (docs[0][1], 0) and got[2] == ("own start\nown end", 2) and got[3] == (docs[2][1], 0)
    assert got[4] == ("fourth", 1) and got[5] == ("short", 1) and got[6] == ("short\nother", 0) and got[7] == (None, 0) and got[8] == ("", 3)
    assert all(got[k] == (prose(k, 15), 1) for k in range(100, 130))
    assert linedup.without_repeated_lines(odd).count() == len(odd_rows) and linedup.without_repeated_lines(empty).count() == 0


def held_earlier(docs, least=8):
    """Per document, the places of all successive lines with ``least`` words or more that an earlier one holds, by comparing all."""
    lines = [[(p, tuple(x.split())) for p, x in enumerate(t.split("\n")) if x.split()] for _, t in docs]
    out = []
    for k, late in enumerate(lines):
        gone = set()
        for early in lines[:k]:
            for i in range(len(late)):
                for j in range(len(early)):
                    n = 0
                    while i + n < len(late) and j + n < len(early) and late[i + n][1] == early[j + n][1]:
                        n += 1
                    if sum(len(w) for _, w in late[i : i + n]) >= least:
                        gone |= {p for p, _ in late[i : i + n]}
        out.append(gone)
    return out


def test_line_dedup_beside_lines_of_others(spark):
    """Passages whose neighbours have other owners, moved ones, and passages of short lines with an owner each."""
    p = [prose(40 + k, 10) for k in range(6)]
    s = [prose(60 + k, 3) for k in range(4)]
    docs = [(1, f"{p[0]}\n{p[1]}\n{p[2]}"), (2, f"start\n{p[3]}\nend"), (3, f"{p[0]}\n{p[3]}\n{p[1]}\n{p[2]}"), (4, f"{p[2]}\n{p[0]}\nmore\n{p[1]}")]
    docs += [(10 + k, x) for k, x in enumerate(s)] + [(20, "\n".join(s)), (21, "own\n" + "\n".join(s) + "\nend")]
    docs += [(k, f"{p[3]}\n{prose(k, 15)}") for k in range(100, 110)]
    r = random.Random(8)
    lines = s + p[4:] + [prose(80 + k, 1 + k) for k in range(7)]
    docs += [(200 + k, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 9)))) for k in range(60)]
    want = held_earlier(docs)
    got = {x["doc_id"]: x for x in linedup.without_repeated_lines(spark.createDataFrame(docs, IDS)).collect()}
    assert got[3]["n_deleted"] == 4 and got[4]["text"] == "more" and got[21]["text"] == "own\nend"
    for (i, t), gone in zip(docs, want, strict=True):
        assert (got[i]["n_deleted"], got[i]["text"]) == (len(gone), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)), i


def greedy(word, starting, inside):
    at, n = 0, 0
    while at < len(word):
        known = inside if at else starting
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton():
    r = random.Random(4)
    some = lambda n: {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 6))) for _ in range(n)}
    for _ in range(2000):
        starting, inside = some(r.randrange(9)), some(r.randrange(9))
        a = wordpiece.Automaton(starting, inside)
        for word in some(8):
            assert a.pieces(word) == greedy(word, starting, inside)


def test_token_counts(spark, odd, odd_rows, empty):
    pieces = wordpiece.byte_level_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    starting, inside = map(set, pieces)
    want = sorted(sum(greedy(w, starting, inside) for w in (t or "").encode().split()) for _, t, *_ in odd_rows if len(t or "") < 9999)
    small = odd.where("text is null or length(text) < 9999")
    assert sorted(r["n_tokens"] for r in wordpiece.token_counts(small, pieces).collect()) == want
    assert wordpiece.token_counts(odd, pieces).count() == len(odd_rows) and wordpiece.token_counts(empty, pieces).count() == 0
