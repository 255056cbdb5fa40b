import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, fp string, _gone long, _copies int, places string"
WORDS = [f"w{k}" for k in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and blank texts, a very long one, ties, repeated rows, near copies, and clashing columns."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, base.upper()), (None, base), (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "one two three"),
        (10, "one two three"), (11, prose(2, 60_000)), (None, None), (12, prose(3, 200) + "\n" + base), (13, "é ö ß 漢字 🙂 " + prose(4, 30)), (14, "<|endoftext|>  a   b\n\n c"),
    ]
    return [(i, t, None, None if k % 5 == 0 else f"s{k % 3}", None, None, None, "x", None, 7, None) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
