"""Quality rules as a ledger: every rule runs once per document and leaves a failure bit beside the measurements.

Policies are versioned masks over those bits, so a stored ledger answers any policy, and what each rule alone removes,
through bitwise filters and one aggregation by bit pattern.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, valid_text, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_shouted_words", "n_long_words")
#: Words of a window whose recurrence counts as repetition.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # a SQL condition over MEASURES


#: A rule keeps its bit for good; a changed rule gets a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule(5, "letterless_words", "100 * n_letter_words < 60 * n_words"),
    Rule(6, "shouting", "100 * n_shouted_words > 50 * n_words"),
    Rule(7, "long_words", "100 * n_long_words > 20 * n_words"),
)
#: Masks by name and version. ``base`` is the part that any policy contains.
POLICIES = {("base", 1): 0b11, ("web", 1): 0b1111111, ("web", 2): 0b11111111}
CURRENT = ("web", 2)

_not_symbols = bytes(set(range(256)) - set(b"#*$%&|<>"))
_continuations = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    if len(words) <= window:
        return 0
    windows = list(zip(*(words[k:] for k in range(window)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, reach = 0, 0
    for at, found in enumerate(windows):
        if counts[found] > 1:
            covered += at + window - max(reach, at)
            reach = at + window
    return covered


def measures(text: bytes | None) -> tuple[int, ...]:
    """The values of MEASURES. Characters are code points; a null text measures as an empty one."""
    words = words_of(text)
    if not words:
        return (0, 0, len((text or b"").translate(None, _not_symbols)), *[0] * 6)
    joined = b"".join(words)
    chars = len(joined.translate(None, _continuations))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    seen = set(lines)
    shouted = letters = long = 0
    for word, n in Counter(words).items():
        shown = word.decode()
        if shown.isalpha() or any(map(str.isalpha, shown)):
            letters += n
            shouted += n * (shown.isupper() and len(shown) > 1)
        long += n * (len(shown) > 30)
    return len(words), chars, len(joined.translate(None, _not_symbols)), len(lines), len(lines) - len(seen), repeated_words(words), letters, shouted, long


def ledger(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, MEASURES and ``failed_bits`` for each row of ``docs``.

    Null and empty texts have no words and fail ``few_words``; bytes that aren't UTF-8 count as U+FFFD; texts of any length are measured whole. A measure that
    equals a rule's limit passes it. Every row counts by itself, so repeated rows give repeated rows. An empty table gives
    an empty ledger. Other columns are not read.
    """

    def make():
        def rows(doc_id: int | None, text: bytes | None) -> Iterator[tuple]:
            yield doc_id, *measures(text)

        return rows

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), valid_text(text_col).cast("binary").alias("text"))
    return judged(arrow_rows(slim, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES), make), rules)


def judged(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``failed_bits``; each rule's condition is evaluated here and nowhere else."""
    return measured.withColumn("failed_bits", F.expr(" | ".join(f"if({r.fails}, {1 << r.bit}L, 0L)" for r in rules) or "0L"))


def passes(policy: tuple[str, int] = CURRENT, bits: str = "failed_bits") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(kept_ledger: DataFrame, policy: tuple[str, int] = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects (kept if it were left out)."""
    mask = POLICIES[policy]
    patterns = kept_ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    used = [r for r in rules if mask >> r.bit & 1]
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in used)))
    long = patterns.withColumn("r", each).select("bits", "n", "r.rule", "r.bit")
    hit, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    return long.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only_this"))


def quality_verdicts(docs: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_bits``; rows as in ``ledger``."""
    out = ledger(docs).withColumn("base_failed", ~passes(("base", 1))).withColumn("kept", ~F.col("base_failed") & passes(policy))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


#: DuckDB SQL for quality_verdicts.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), pos AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM pos) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (
    SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), words AS (
  SELECT r, sum(length(x)) AS chars, count(*) FILTER (regexp_matches(x, '\p{L}')) AS letters,
         count(*) FILTER (length(x) > 1 AND x = upper(x) AND x <> lower(x)) AS shouted,
         count(*) FILTER (length(x) > 30) AS long FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         coalesce(letters, 0) AS n_letter_words, coalesce(shouted, 0) AS n_shouted_words, coalesce(long, 0) AS n_long_words
  FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r) LEFT JOIN words USING (r)
), f AS (
  SELECT *, (BITS)::BIGINT AS failed_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits FROM f
""".replace("BITS", " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES))

#: DuckDB SQL for the ablations of the current policy over the ledger.
ABLATIONS = f"""
WITH verdicts AS ({ORACLE}), rules AS (SELECT * FROM (VALUES {", ".join(f"('{r.name}', {1 << r.bit})" for r in RULES if POLICIES[CURRENT] >> r.bit & 1)}) AS t(rule, bit))
SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS failed, count(*) FILTER (failed_bits & {POLICIES[CURRENT]} = bit) AS only_this
FROM rules, verdicts GROUP BY rule
"""
