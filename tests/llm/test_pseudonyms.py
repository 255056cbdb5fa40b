import datetime as dt
import ipaddress
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconry.llm import pseudonyms

NAMES = pseudonyms.Pseudonyms(b"k")
local = st.text(st.one_of(st.sampled_from("abzAZ019.+-_"), st.characters(categories=["Lu", "Ll", "Lo", "Nd", "Lt", "No"])), min_size=1, max_size=64)


def test_widths():
    """Long formats: any value comes back inside its range, and different values stay different."""
    net = pseudonyms.Feistel(b"k")
    for size in (26**55, 26**64, 128**64, 10**400):
        values = [0, 1, size // 3, size - 2, size - 1, *range(1000, 1020)]
        out = [net.permuted(v, size, "t") for v in values]
        assert len(set(out)) == len(values) and 0 <= min(out) and max(out) < size
        assert len({v >> (size.bit_length() - 20) for v in out}) > len(values) // 2  # the high bits move too


@settings(deadline=None, max_examples=300)
@given(local, local)
def test_every_name_survives_and_different_ones_stay_apart(a, b):
    one, two = (NAMES._email(f"{x}@x.com") for x in (a, b))
    assert one.endswith("@x.com") and len(one) == len(a) + 6 and (a == b) == (one == two)
    kinds = [pseudonyms._kind(c) for c in a]
    assert [pseudonyms._kind(c) for c in one[: len(a)]] == kinds and all(k or x == y for k, x, y in zip(kinds, a, one, strict=False))


def test_alphabets_are_permuted_whole():
    for letters in ("abcdefghijklmnopqrstuvwxyz", "0123456789", "".join(chr(c) for c in range(0x430, 0x450))):
        out = {NAMES._email(f"{c}@x.com")[0] for c in letters}
        assert len(out) == len(letters) and all(pseudonyms._kind(c) == pseudonyms._kind(letters[0]) for c in out)


def test_long_names(spark):
    texts = ["z" * 60 + "@x.com", "é@x.com", "g@x.com", "z" * 65 + "@x.com", "Ж" * 64 + "@x.com und so", "4111 1111 1111 1111 " * 4000]
    out = [r["text"] for r in pseudonyms.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b"k").orderBy("doc_id").collect()]
    assert len(set(out)) == 6 and out[3] == texts[3] and all(a != b for k, (a, b) in enumerate(zip(out, texts, strict=True)) if k != 3)
    assert len(set(out[5].replace(" ", "|").split("||||"))) == 1 and out[5].count(out[5][:20]) == 4000


@pytest.mark.parametrize("tail", ["ABCD", "HELLO WORLD", "1234", "4111 1111 1111 1111", "A", "ABC DEF GHI", "BE68 5390 0754 7034"])
def test_ibans_before_other_words(tail):
    new, counts = NAMES.rewritten(f"to BE68 5390 0754 7034 {tail}.")
    m = re.match(r"to (BE\d\d( \d{4}){3}) (.*)\.$", new)
    assert m and m[1] != "BE68 5390 0754 7034" and pseudonyms._mod97(m[1].replace(" ", "")) == 1
    assert counts["iban"] == 1 + tail.startswith("BE") and counts["card"] == tail.startswith("4111") and (m[3] == tail) == (len(tail) < 15)


def test_a_value_behind_one_that_is_not_valid():
    new, counts = NAMES.rewritten("AB12 4111 1111 1111 1111 and 99/99/2001 10/10/2001")
    assert counts["card"] == 1 and counts["date"] == 1 and new.startswith("AB12 ") and " 99/99/2001 " in new


def valid_spans(text):
    """Spans of valid cards, addresses, dates and SSNs, by trying every substring between places where none can go on."""

    def card(v):
        if not re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", v):
            return False
        d = [int(c) for c in v if c.isdigit()][::-1]
        return len(set(d)) > 1 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0

    def ip(v):
        try:
            return ipaddress.IPv4Address(".".join(str(int(x)) for x in v.split("."))) is not None and all(len(x) < 4 for x in v.split("."))
        except ValueError:
            return False

    def date(v):
        for shape in ("%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%d-%m-%Y", "%d/%m/%Y", "%d.%m.%Y", "%m-%d-%Y", "%m/%d/%Y", "%m.%d.%Y", "%Y-%d-%m", "%Y/%d/%m", "%Y.%d.%m"):
            try:
                if 1900 <= dt.datetime.strptime(v, shape).year < 2100 and (len(v) == 10 or shape[1] != "Y"):
                    return True
            except ValueError:
                pass
        return False

    def ssn(v):
        return bool(re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", v))

    found = set()
    for m in re.finditer(r"\S+( [0-9]\S*)*", text):
        for word in (m[0], *m[0].split(" ")):
            kind = next((n for n, f in (("card", card), ("ip", ip), ("date", date), ("ssn", ssn)) if f(word)), None)
            if kind:
                found.add((kind, word))
    return found


def test_against_brute_force():
    """Every valid value between blanks goes, the same value to the same one, and nothing else changes."""
    r = random.Random(9)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    made = [
        lambda: digits(r.choice((13, 16, 19))), lambda: " ".join(digits(4) for _ in range(4)), lambda: ".".join(str(r.randrange(300)) for _ in range(4)),
        lambda: f"{r.randrange(1890, 2110)}-{r.randrange(1, 14):02}-{r.randrange(1, 33):02}", lambda: f"{r.randrange(1, 33)}/{r.randrange(1, 14)}/{r.randrange(1950, 2020)}",
        lambda: f"{r.choice(('000', '666', '901', '123', '078'))}-{r.randrange(3):02}-{digits(4)}", lambda: "word", lambda: f"{digits(5)}x",
    ]
    hits, gone = 0, {}
    for _ in range(1500):
        parts = [r.choice(made)() for _ in range(r.randrange(1, 6))]
        text = " ; ".join(parts)
        new, counts = NAMES.rewritten(text)
        want = [next((k for k, w in valid_spans(p) if w == p), None) for p in parts]
        out = new.split(" ; ")
        assert len(out) == len(parts) and sum(counts.values()) == sum(k is not None for k in want), text
        for p, q, k in zip(parts, out, want, strict=True):
            if k is None:
                assert p == q
                continue
            hits += 1
            assert (k, q) in valid_spans(q) and gone.setdefault((k, re.sub(r"\D", "", p) if k == "card" else p), re.sub(r"\D", "", q) if k == "card" else q) == (re.sub(r"\D", "", q) if k == "card" else q)
    assert hits > 500


def test_spellings_of_one_phone_number_are_linked():
    names = pseudonyms.Pseudonyms(b"k")
    for code, rest in (("49", "301234567"), ("1", "2025550123"), ("421", "212345678"), ("7", "4951234567")):
        shapes = [f"+{code}{rest}", f"+{code} {rest[:3]} {rest[3:6]} {rest[6:]}", f"+{code}-{rest[:3]}-{rest[3:6]}-{rest[6:]}", f"+{code} ({rest[:3]}) {rest[3:6]}{rest[6:]}", f"+{code}.{rest[:3]}.{rest[3:6]}.{rest[6:]}"]
        new = [names.rewritten(f"call {x} now")[0][5:-4] for x in shapes]
        assert all(a != b for a, b in zip(new, shapes, strict=True)), new
        digits = {"".join(c for c in x if c.isdigit()) for x in new}
        assert len(digits) == 1 and digits.pop().startswith(code)
        assert [re.sub(r"\d", "0", x) for x in new] == [re.sub(r"\d", "0", x) for x in shapes]


def test_domains_of_other_scripts():
    text, counts = pseudonyms.Pseudonyms(b"k").rewritten("mail jo@exämple.com or anna@почта.рф")
    assert counts["email"] == 2 and "@exämple.com" in text and "@почта.рф" in text and "jo@" not in text


def test_bytes_that_are_not_utf8(spark):
    row = pseudonyms.pseudonymised(spark.sql("select 1L doc_id, cast(x'ff20313932' as string) text"), b"k").first()
    assert row["text"] == "� 192" and row["n_replaced"] == 0
