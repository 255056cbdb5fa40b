"""Secrets in texts, with DataFrame functions only.

Three patterns give base spans: assignments to telling names, access keys, long hex strings. Beside them, any long string
of key characters is a candidate, if a base span doesn't overlap it and no allow-list entry explains it. A window slides
over a candidate; the window's sum of c * log2(c) over its counts of characters changes only by the character that enters
and the one that leaves. The highest Shannon entropy of any window is held against the limit of the candidate's character
class.

Positions count code points, ends exclusive. Matches and the stretches between them have known lengths, so positions are
running sums of lengths; what overlaps is found in one pass over the spans in order. Running values are taken in two
levels, so work grows with the length of a text and the number of its matches, however many, and never with their square.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Greedy and leftmost, so equal to runs of any length of which those under 24 are dropped.
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: Characters of the sliding window, and per class a pattern for the whole candidate and the least entropy in bits.
WINDOW = 20
CLASSES = (
    ("hex", r"^[0-9A-Fa-f]+$", 2.8), ("alnum", r"^(?=.*[A-Za-z])[A-Za-z0-9]+$", 3.7), ("base64", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+={0,2}$", 3.7),
    ("parts", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]+={0,2}$", 3.7),
)
#: What a candidate may be without being a secret: no digit, digits only, an identifier of words, a path of words and
#: numbers, a UUID, a counting run.
ALLOWED = (
    r"^[^0-9]*$", r"^[0-9_/+-]+=*$", r"^(?:[A-Za-z]+[_/+-]+)+[A-Za-z]*[0-9]{0,4}$", r"^(?:(?:[a-z]+|[0-9]+)[_/+-]+)+[a-z0-9]{0,8}$",
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"0123456789|abcdefghij|ABCDEFGHIJ",
)


def _before(values: Column, zero: Column, joined: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """For each element, ``joined`` over all earlier ones, from ``zero``."""
    push = lambda a, v: F.array_append(a, joined(F.element_at(a, -1), v))

    def running(x: Column) -> Column:
        part = lambda k: F.slice(x, k * chunk + 1, F.lit(chunk))
        chunks = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / chunk).cast("int"))
        bases = F.aggregate(F.transform(chunks, lambda k: F.aggregate(part(k), zero, joined)), F.array(zero), push)
        return let(bases, lambda b: F.flatten(F.transform(chunks, lambda k: F.slice(F.aggregate(part(k), F.array(F.get(b, k)), push), F.lit(1), F.size(part(k))))))

    return let(values, running)


def _sums(lengths: Column) -> Column:
    return _before(lengths, F.lit(0), lambda a, v: a + v)


def _matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """``array<struct<start, end, value>>`` of a pattern's matches; ``value`` is a group's text."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(m: Column) -> Column:
        def at(g: Column) -> Column:
            lengths = F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x))
            spans = lambda v: let(_sums(lengths), lambda b: F.transform(m, lambda x, i: F.struct((F.get(b, i) + F.length(F.get(g, i))).alias("start"), (F.get(b, i) + F.length(F.get(g, i)) + F.length(x)).alias("end"), F.get(v, i).alias("value"))))
            return spans(m) if group is None else let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), spans)

        return let(gaps, at)

    return let(found, placed)


def entropy_peak(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of ``window`` successive ASCII characters; 0 for shorter values.

    A character that enters a window with c like it adds (c + 1) * log2(c + 1) - c * log2(c) to the sum, and one that
    leaves takes the same away for the count that it leaves behind. Counts are taken inside the window alone.
    """
    gain = F.array(*(F.lit((c + 1) * math.log2(c + 1) - c * math.log2(c) if c else 0.0) for c in range(window)))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def steps(codes: Column) -> Column:
        near = lambda first, n, x: F.size(F.filter(F.slice(codes, first + 1, n), lambda c: c == x))

        def step(x: Column, i: Column) -> Column:
            first, out = F.greatest(i - window + 1, F.lit(0)), F.get(codes, F.greatest(i - window, F.lit(0)))
            left = F.when(i >= window, F.get(gain, near(first, F.lit(window - 1), out))).otherwise(0.0)
            return F.struct((F.get(gain, near(first, i - first, x)) - left).alias("by"), (i >= window - 1).alias("full"))

        return F.transform(codes, step)

    def moved(state: Column, step: Column) -> Column:
        total = state["sum"] + step["by"]
        bits = F.when(step["full"], F.lit(math.log2(window)) - total / window).otherwise(0.0)
        return F.struct(total.alias("sum"), F.greatest(state["best"], bits).alias("best"))

    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    return let(codes, lambda c: F.aggregate(steps(c), start, moved, lambda s: s["best"]))


def _iterative(pattern: str) -> str:
    """``pattern`` for the JVM, whose repeated groups take a stack frame a turn unless they are possessive.

    No turn of these groups can end elsewhere than where it does, so nothing else changes.
    """
    return pattern.replace("]+)", "]++)").replace("]+|", "]++|").replace(")+", ")++")


def _suspicious(value: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.regexp_like(value, F.lit(_iterative(pattern)))
    limit = F.lit(99.0)
    for _, pattern, bits in reversed(CLASSES):
        limit = F.when(F.regexp_like(value, F.lit(pattern)), F.lit(bits)).otherwise(limit)
    return F.when(allowed, F.lit(False)).otherwise(F.when(limit < 9, entropy_peak(value) >= limit).otherwise(F.lit(False)))


def _apart(spans: Column, taken: Column) -> Column:
    """The ``spans`` that overlap none of ``taken``: none that starts before them ends in them, the next starts behind them."""
    fields = lambda s, own: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["value"].alias("value"))
    far = F.lit((1 << 31) - 1)

    def kept(every: Column) -> Column:
        ends = _before(F.transform(every, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(0)), F.lit(0), lambda a, v: F.greatest(a, v))
        starts = F.reverse(_before(F.reverse(F.transform(every, lambda s: F.when(s["own"] == 0, s["start"]).otherwise(far))), far, lambda a, v: F.least(a, v)))
        pick = lambda e, n: F.filter(every, lambda s, i: (s["own"] == 1) & (F.get(e, i) <= s["start"]) & (F.get(n, i) >= s["end"]))
        return let(ends, lambda e: let(starts, lambda n: pick(e, n)))

    both = F.array_sort(F.concat(F.transform(taken, lambda s: fields(s, 0)), F.transform(spans, lambda s: fields(s, 1))))
    return F.transform(let(both, kept), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


_NONE = "cast(array() as array<struct<start:int,end:int,value:string>>)"


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    none, t = F.expr(_NONE), F.col("text")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    assign = F.filter(_matches(t, ASSIGN, 2), lambda m: F.length(m["value"]) >= LEAST_VALUE)
    access = F.filter(_matches(t, ACCESS), lambda m: F.length(m["value"]) >= LEAST_ACCESS)
    base = slim.select(
        "doc_id",
        F.when(F.regexp_like(t, F.lit(CANDIDATE)), t).alias("long"),  # an alias "text" would stand for the text inside lambdas
        F.when(F.regexp_like(t, F.lit(ASSIGN)), assign).otherwise(none).alias("assign"),
        F.when(t.contains("AKIA"), access).otherwise(none).alias("access"),
        F.when(F.regexp_like(t, F.lit(HEX)), _matches(t, HEX)).otherwise(none).alias("hex"),
    )
    taken = F.concat("assign", "access", "hex")
    more = let(F.filter(_matches(F.col("long"), CANDIDATE), lambda m: _suspicious(m["value"])), lambda found: F.when((F.size(found) == 0) | (F.size(taken) == 0), found).otherwise(_apart(found, taken)))
    return base.withColumn("entropy", F.when(F.col("long").isNotNull(), more).otherwise(none)).drop("long")


def _told(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the kinds' spans, by start, then kind as listed."""

    def numbered(n: int, kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), m["end"].alias("end")))

    every, name = F.concat(*(numbered(n, k) for n, k in enumerate(kinds))), F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat(F.get(name, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans`` for each row of ``docs``.

    A null text counts as empty: no spans, and the checksum of the empty string. Texts, candidates and numbers of matches
    may be of any size. Spans that start alike are told by kind, then by end. Repeated rows give repeated rows, an empty
    table an empty result. Other columns are not read.
    """
    found = _found(docs, id_col, text_col)
    counts = (F.size(k).cast("long").alias(f"n_{k}") for k in KINDS)
    return found.select("doc_id", *counts, F.sha2(_told(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), _told(KINDS).alias("spans"))


def masked(docs: DataFrame, mark: str = "[secret]", *, text_col: str = "text") -> DataFrame:
    """``docs`` with each base secret's value in ``text_col`` replaced by ``mark``."""
    out = F.regexp_replace(F.col(text_col), r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]{6,}""", "$1" + mark)
    out = F.regexp_replace(F.regexp_replace(out, r"AKIA[A-Z0-9]{16,}", mark), HEX, mark)
    return docs.withColumn(text_col, out)


def _duck(kind: int, pattern: str, keep: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return rf"""
  SELECT r, {kind} AS k, s AS a, s + len(x) AS z, x FROM (
    SELECT r, m[i] AS x, v[i] AS y, coalesce(list_sum(list_transform(g[1:i], lambda q: len(q))), 0)::BIGINT
           + coalesce(list_sum(list_transform(m[1:i - 1], lambda q: len(q))), 0)::BIGINT AS s FROM (
      SELECT r, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v,
               string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')))) WHERE {keep}"""


def _duck_class(value: str) -> str:
    cases = []
    for _, pattern, bits in CLASSES:
        parts = [rf"regexp_matches({value}, '{x}')" for x in _lookaheads(pattern)]
        cases.append(f"WHEN {' AND '.join(parts)} THEN {bits}")
    return f"CASE {' '.join(cases)} ELSE 99 END"


def _lookaheads(pattern: str) -> list[str]:
    """A pattern whose leading look-aheads stand apart, for an engine that has none."""
    out = []
    while pattern.startswith("^(?="):
        ahead, _, rest = pattern[4:].partition(")")
        out.append(f"^{ahead}")
        pattern = f"^{rest}"
    return [*out, pattern]


#: DuckDB SQL for secret_spans.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_duck(0, ASSIGN, "len(y) >= 6", 2)} UNION ALL {_duck(1, ACCESS, "len(x) >= 20")} UNION ALL {_duck(2, HEX, "true")}),
candidate AS ({_duck(3, CANDIDATE, " AND ".join(f"NOT regexp_matches(x, '{p}')" for p in ALLOWED))}),
more AS (
  SELECT * FROM candidate c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.a < c.z AND c.a < b.z)
    AND list_max(list_transform(range(1, len(x) - {WINDOW - 2}), lambda i:
        list_aggregate(list_transform(range(i, i + {WINDOW}), lambda j: x[j]), 'entropy'))) >= {_duck_class("x")}
), every AS (SELECT r, k, a, z FROM base UNION ALL SELECT r, k, a, z FROM more),
told AS (
  SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3,
         string_agg(s, ',' ORDER BY a, k, z) FILTER (k < 3) AS b, string_agg(s, ',' ORDER BY a, k, z) AS e
  FROM (SELECT *, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || a || ':' || z AS s FROM every) GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, coalesce(n3, 0) AS n_entropy,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(e, '') AS spans FROM d LEFT JOIN told USING (r)
"""
